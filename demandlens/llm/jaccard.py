"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word shingles as 64-bit hashes.  Sizes are cut into
intervals whose bounds have at least the wanted similarity, so linked sets lie in the same or
neighbouring intervals, and every set takes part in the two bands that join its interval to a
neighbour.  Within a band the symmetric difference of linked sets is at most k.  PartEnum
divides the hash domain into n1 groups, one of which differs in at most k2 = k / n1 features;
each group is divided into n2 parts, and each choice of n2 - k2 of these gives a signature:
linked sets share at least one.  Two groups more than needed (and one in 16) let a set leave
out its empty parts; where it has more of them than that, it keeps them.

Work in steps: identical sets are one class from the start (by size and 128 hash bits);
signatures are dealt by hash in packed Arrow rows.  First, a bucket's members are compared with
one hub only, the member that is in the most buckets; components are formed.  Then members of
one bucket that are still in different components are compared, first each with its nearest of every other
component, and after new components are formed, all that are left.  A pair is a candidate only if the
parity sketches of the two sets allow it: a sketch is the set hashed into bits by exclusive or, and two
sketches differ in no more bits than the sets differ in features, so no link is lost.
Sketches are compared inside tasks, in tiles of a bucket, and only surviving pairs become rows; their
sets are then intersected.

Edge cases: a null or empty text or one without words has an empty set and links with nothing;
texts with fewer words than a shingle are one feature; very long texts are used whole; rows
that repeat an id and text count as one; an id that comes with several texts is reported
once for each size, with the links of all its texts; rows with a null id are documents by their text (known by a hash
as wide as the room below the smallest id, at most 62 bits), are kept, and count as smaller than any other id's
documents, so a component with one has the id null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm import textpack as tp
from demandlens.llm.stage import by_part, components, partitions, small_batches, staged, unused

U64 = np.uint64
NO_ID = -(1 << 63)
MAX_BROADCAST_IDS = 1_000_000
SKETCH_BITS = 512   # at least; a sketch has two to four bits for each feature
TILE = 2048         # members of a bucket that are compared in one task with as many others
BLOCK_PAIRS = 200_000


def bands(max_size: int, percent: int) -> list[tuple[int, int]]:
    """Size intervals (lowest, highest) up to max_size."""
    out, lo = [], 1
    while lo <= max_size:
        hi = 100 * lo // percent
        out.append((lo, hi))
        lo = hi + 1
    return out


@lru_cache(maxsize=None)
def scheme(top: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) of the band whose largest size is top."""
    k = 2 * top * (100 - percent) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    if k <= 2:
        return 1, k + 2, k, 0
    need = k // 2 + 1
    spare = 2 + need // 16
    # Two parts a group and one of them a signature, or three and two of them where the smallest
    # set of the band would have fewer than four features in a part.
    smallest = top * percent * percent // 10_000
    return need + spare, 2 if smallest >= 4 * (k + 1) else 3, 1, spare


def sketch_level(n: int) -> int:
    """Doublings of SKETCH_BITS that a set of n features needs."""
    return max(0, (2 * int(n) - 1).bit_length() - (SKETCH_BITS.bit_length() - 1))


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, longer ones folded to ``size`` bytes."""
    out = np.empty((len(sketches), size // 8), U64)
    for i, x in enumerate(sketches):
        w = np.frombuffer(x, U64)
        out[i] = np.bitwise_xor.reduce(w.reshape(-1, size // 8), axis=0)
    return out


class Sets:
    """Distinct shingle hashes of the rows of a chunk, sorted by row and hash."""

    def __init__(self, buf, offs, n: int):
        w = tp.Words(buf, offs, tp.space_table(lower=True))
        count = np.diff(w.bounds)
        rows = np.arange(len(offs) - 1)
        full = count >= n
        at = tp.segment_ranges(w.bounds[:-1][full], count[full] - n + 1)
        pre = tp.sequence_prefix(w.hash)
        h = tp.range_hash(pre, at, at + n)
        few = (count > 0) & ~full
        row = np.concatenate([np.repeat(rows[full], count[full] - n + 1), rows[few]])
        h = np.concatenate([h, tp.range_hash(pre, w.bounds[:-1][few], w.bounds[1:][few])])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        self.row, self.hash = row[keep], h[keep]
        self.bounds = np.searchsorted(self.row, np.arange(len(offs)))
        self.size = np.diff(self.bounds)
        self.sums = [self._sums(tp.mix(self.hash)), self._sums(tp.mix(self.hash ^ U64(0x5851F42D4C957F2D)))]
        self.key = [tp.mix(s[self.bounds[1:]] - s[self.bounds[:-1]] + self.size.astype(U64)) for s in self.sums]

    @staticmethod
    def _sums(x):
        return np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])

    def sketches(self) -> list[bytes]:
        """Parity sketch of every row."""
        level = np.array([sketch_level(n) for n in self.size])
        bits = SKETCH_BITS << level
        at = np.cumsum(bits) - bits
        flip = at[self.row] + (tp.mix(self.hash ^ U64(0xA0761D6478BD642F)) & (bits[self.row] - 1).astype(U64)).astype(np.int64)
        odd = np.bincount(flip, minlength=int(bits.sum())) & 1
        packed = np.packbits(odd.astype(np.uint8))
        return [packed[a // 8:(a + b) // 8].tobytes() for a, b in zip(at, bits)]

    def signatures(self, pick: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) of the picked rows."""
        if not len(pick):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        table = bands(int(self.size[pick].max()), percent)
        table.append((table[-1][1] + 1, 100 * (table[-1][1] + 1) // percent))
        own = np.searchsorted([lo for lo, _ in table], self.size[pick], "right") - 1
        sigs, rows = [], []
        for shift in (0, 1):
            band = own + shift
            params = np.array([scheme(table[j][1], percent) for j in band])
            for s, r in (self._parts(pick, band, params), self._subsets(pick, band, params)):
                sigs.append(s)
                rows.append(r)
        return np.concatenate(sigs), np.concatenate(rows)

    def _part_sums(self, rows, parts):
        """Per row its parts' feature counts and sums, parts concatenated."""
        at = tp.segment_ranges(self.bounds[rows], self.size[rows])
        m = np.repeat(parts, self.size[rows]).astype(U64)
        base = np.cumsum(parts) - parts
        part = ((self.hash[at] >> U64(32)) * m >> U64(32)).astype(np.int64) + np.repeat(base, self.size[rows])
        count = np.bincount(part, minlength=int(parts.sum()))
        ends = np.cumsum(count)
        s = np.concatenate([np.zeros(1, U64), np.cumsum(tp.mix(self.hash[at]), dtype=U64)])
        return count, s[ends] - s[ends - count], base

    def _parts(self, pick, band, params):
        """Bands with several groups: all parts of a group but one make a signature."""
        sigs, found = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for n2 in (2, 3):
            use = (params[:, 0] > 1) & (params[:, 1] == n2)
            if not use.any():
                continue
            rows, own, spare = pick[use], band[use], params[use, 3]
            parts = params[use, 0] * n2
            count, sums, base = self._part_sums(rows, parts)
            which = np.repeat(np.arange(len(rows)), parts)
            # signature i of a group leaves out its part i
            group = lambda x: (x.reshape(-1, n2).sum(axis=1, keepdims=True, dtype=x.dtype) - x.reshape(-1, n2)).ravel()
            count, sums = group(count), group(sums)
            empty = np.add.reduceat((count == 0).astype(np.int64), base)
            keep = (count > 0) | (empty > spare)[which]
            number = np.arange(len(which)) - base[which]
            sig = tp.mix(sums + tp.mix((own[which] * 1_000_003 + 17).astype(U64) + (number.astype(U64) << U64(32))))
            sigs.append(sig[keep])
            found.append(rows[which[keep]])
        return np.concatenate(sigs), np.concatenate(found)

    def _subsets(self, pick, band, params):
        """Bands with one group: every choice of n2 - k2 of its n2 parts."""
        sigs, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for n2, k2 in ((1, 0), (3, 1), (4, 2)):
            use = (params[:, 0] == 1) & (params[:, 1] == n2) & (params[:, 2] == k2)
            if not use.any():
                continue
            r = pick[use]
            _, sums, _ = self._part_sums(r, np.full(len(r), n2))
            sums = sums.reshape(-1, n2)
            for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
                salt = tp.mix((band[use] * 1_000_003 + 17).astype(U64) + U64((i + 1) << 32))
                sigs.append(tp.mix(sums[:, list(chosen)].sum(axis=1, dtype=U64) + salt))
                rows.append(r)
        return np.concatenate(sigs), np.concatenate(rows)


def _classes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, k1, k2, sketch) of every row."""
    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tp.chunks(b.column(1)):
                s = Sets(buf, offs, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(s.size), *(pa.array(k.view(np.int64)) for k in s.key),
                     pa.array(s.sketches(), pa.binary())], ["doc_id", "n", "k1", "k2", "sketch"])
    return docs.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, sketch binary")


def _buckets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(bucket, k1): members of every signature that several sets have."""
    count = partitions(docs.sparkSession)
    deal = U64(2 * count)

    def emit(batches):
        for b in batches:
            for _, _, buf, offs in tp.chunks(b.column(0)):
                s = Sets(buf, offs, n)
                _, first = np.unique(s.key[0], return_index=True)  # a chunk's copies speak once
                sig, row = s.signatures(np.sort(first[s.size[first] > 0]), percent)
                part = ((sig >> U64(32)) * deal >> U64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                part, sig, row = part[order], sig[order], row[order]
                cut = np.searchsorted(part, np.arange(int(deal) + 1))
                used = np.flatnonzero(np.diff(cut))
                pack = lambda a: pa.array([a[cut[p]:cut[p + 1]].tobytes() for p in used], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pack(sig), pack(s.key[0][row])], ["part", "sig", "k1"])

    def meet(batches):
        for rows in by_part(batches):
            yield from met([(np.frombuffer(sig, U64), np.frombuffer(k1, np.int64)) for sig, k1 in rows])
            del rows
            tp.released()

    def met(got):
        sig, k1 = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(sig, kind="stable")
        sig, k1 = sig[order], k1[order]
        start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        many = np.diff(np.append(start, len(sig))) > 1
        low, high = np.minimum.reduceat(k1, start), np.maximum.reduceat(k1, start)
        many &= low < high
        group = np.cumsum(np.append(True, sig[1:] != sig[:-1])) - 1
        at = np.flatnonzero(many[group])
        at = at[np.lexsort((k1[at], group[at]))]
        new = np.ones(len(at), bool)
        new[1:] = (group[at][1:] != group[at][:-1]) | (k1[at][1:] != k1[at][:-1])
        at = at[new]
        for i in range(0, len(at), 100_000):
            x = at[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(sig[x].view(np.int64)), pa.array(k1[x])], ["bucket", "k1"])

    packed = docs.select("text").mapInArrow(emit, "part int, sig binary, k1 binary")
    return packed.repartition(count, "part").sortWithinPartitions("part").mapInArrow(meet, "bucket bigint, k1 bigint")


def _allowed(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m whose sketches differ in ``apart`` bits can be linked."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (apart <= (n + m) * (100 - percent) // (100 + percent))


def _sketched(pairs: DataFrame, name: DataFrame, percent: int) -> DataFrame:
    """Pairs (k1, k) of set keys as pairs (a, b) of representatives that their sketches allow."""
    def run(batches):
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            x, y = b.column(3).to_pylist(), b.column(5).to_pylist()
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            for i in np.flatnonzero(ok):
                size = min(len(x[i]), len(y[i]))
                u, v = folded([x[i], y[i]], size)
                ok[i] = _allowed(n[i], m[i], np.bitwise_count(u ^ v).sum(dtype=np.int64), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    other = name.select(F.col("k1").alias("k"), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    both = (pairs.join(name, "k1").join(other, "k").filter("rep <> other")
            .select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"), "n", F.col("sketch").alias("x"), "m", "y"))
    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _across(members: DataFrame, name: DataFrame, groups: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of representatives that share a bucket but no component and that their sketches
    allow; with nearest only each one's nearest in every other component."""
    label = name.join(groups, F.col("rep") == F.col("id"), "left").select("k1", "rep", "n", "sketch", F.coalesce("component", "rep").alias("c"))
    label = staged(label, "label")
    seen = members.join(label.select("k1", "rep", "c"), "k1")
    # Of buckets with the same members (count and 128 bits of their keys) one is enough, and the one pair of
    # a bucket of two was compared as hub and member.
    print_ = [F.bit_xor(F.xxhash64(F.lit(i), "k1")).alias(f"p{i}") for i in (1, 2)]
    open_ = (seen.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), *print_)
             .filter("lo <> hi and size > 2").groupBy("size", "p1", "p2").agg(F.min("bucket").alias("bucket")))
    open_ = staged(open_.select("bucket", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")), "open")
    block = F.pmod(F.xxhash64("k1"), "blocks").cast("int")
    tiles = (members.join(open_, "bucket").withColumn("block", block)
             .select("bucket", "k1", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
             .select("k1", "block", F.concat_ws(":", "bucket", F.least("block", "with"), F.greatest("block", "with")).alias("tile"),
                     (F.col("block") != F.col("with")).alias("cross")))
    rows = tiles.join(label, "k1").select("tile", "cross", "block", "rep", "n", "c", "sketch")

    def compare(batches):
        got = list(batches)
        if not got or not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        tile, cross, block, rep_, n, c = (t.column(i).to_numpy() for i in range(6))
        data, offs = tp.buffers(t.column(6).cast(pa.large_binary()).combine_chunks())
        words, begin, count = data.view(U64), offs[:-1] // 8, np.diff(offs) // 8
        code = np.unique(tile, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        cuts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            x = order[lo:hi]
            if len(x) < 2 or (c[x] == c[x[0]]).all():
                continue
            if (count[x] == count[x[0]]).all():
                bits = words[begin[x][:, None] + np.arange(count[x[0]])]
            else:
                bits = folded([words[begin[r]:begin[r] + count[r]].tobytes() for r in x], 8 * int(count[x].min()))
            out = [[], [], []]
            step = max(1, BLOCK_PAIRS // (len(x) * bits.shape[1]))
            for i0 in range(0, len(x), step):
                left = slice(i0, i0 + step)
                apart = np.bitwise_count(bits[left, None] ^ bits[None, i0:]).sum(axis=2, dtype=np.int64)
                ok = _allowed(n[x][left, None], n[x][None, i0:], apart, percent) & (c[x][left, None] != c[x][None, i0:])
                if cross[x[0]]:
                    ok &= block[x][left, None] != block[x][None, i0:]
                i, j = np.nonzero(np.triu(ok, 1))
                for o, v in zip(out, (i + i0, j + i0, apart[i, j])):
                    o.append(v)
            i, j, apart = (np.concatenate(o) for o in out)
            if nearest:
                best = np.lexsort((apart, c[x][j], i))
                i, j = i[best], j[best]
                first = np.append(True, (i[1:] != i[:-1]) | (c[x][j][1:] != c[x][j][:-1])) if len(i) else np.zeros(0, bool)
                i, j = i[first], j[first]
            a, b_ = rep_[x][i], rep_[x][j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b_)), pa.array(np.maximum(a, b_))], ["a", "b"])

    return rows.repartition(2 * partitions(members.sparkSession), "tile").mapInArrow(compare, "a bigint, b bigint").filter("a <> b").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of document ids whose sets are similar enough."""
    spark = docs.sparkSession
    ids = staged(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    few = ids.count() <= MAX_BROADCAST_IDS  # else the documents are shuffled to the wanted ids
    wanted = docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def sets(batches):
        for b in batches:
            for lo, hi, buf, offs in tp.chunks(b.column(1)):
                s = Sets(buf, offs, n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.array([s.hash[s.bounds[r]:s.bounds[r + 1]].tobytes() for r in range(hi - lo)], pa.binary())], ["id", "set"])

    def test(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok))

    have = staged(wanted.mapInArrow(sets, "id bigint, set binary"), "sets")
    joined = (pairs.join(have.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
              .join(have.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y"))
    return joined.mapInArrow(test, "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >=
    percent * union of their shingle sets; component_id is the smallest id reachable."""
    small_batches(docs.sparkSession)
    lowest = docs.agg(F.min(F.col(id_col).cast("long"))).first()[0]
    room = max(1, min(1 << 62, (0 if lowest is None else lowest) - NO_ID))  # null ids get a node below all others by their text
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text_col), F.lit(room))).alias("doc_id"),
                       F.col(text_col).alias("text"))
    rows = staged(_classes(docs, shingle), "classes")
    full = rows.filter("n > 0")
    name = staged(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")), "reps")
    members = staged(_buckets(docs, shingle, percent), "buckets")
    degree = members.groupBy("k1").agg(F.count(F.lit(1)).alias("degree"))
    ranked = staged(members.join(degree, "k1"), "degrees")
    hubs = staged(ranked.groupBy("bucket").agg(F.max(F.struct("degree", "k1")).alias("hub")).select("bucket", F.col("hub.k1").alias("k")), "hubs")
    first = members.join(hubs, "bucket").filter("k1 <> k").select("k1", "k").distinct()
    tested = staged(_sketched(first, name, percent), "pairs")
    links = staged(_verified(docs, tested, shingle, percent), "links")
    final = staged(components(links), "groups")
    for nearest in (True, False):
        more = staged(_across(members, name, final, percent, nearest).join(tested, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        new = staged(_verified(docs, more, shingle, percent), "links")
        tested = tested.unionAll(more)
        if not new.isEmpty():  # else the components are as they were
            links = links.unionAll(new)
            final = staged(components(links), "groups")
    keyed = full.drop("sketch").join(name.drop("sketch"), ["n", "k1", "k2"])
    found = keyed.join(final, F.col("rep") == F.col("id"), "left").select("doc_id", "n", F.coalesce("component", "rep").alias("c"))
    out = found.unionAll(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("c")))
    back = lambda c: F.when(F.col(c) >= NO_ID + room, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("c").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
             max_broadcast_ids: int = MAX_BROADCAST_IDS) -> DataFrame:
    """The rows of docs (all columns) that are the smallest id of their component; of rows that
    repeat an id and text one stays.  Rows without words and rows with a null id always stay; the
    other rows of a component with a null id go.  Further columns pass, whatever their names."""
    left, twice = unused(docs, "_gone", "_again")
    found = staged(jaccard_components(docs, shingle, percent, id_col, text_col), "components")
    gone = staged(found.filter("doc_id is not null and not doc_id <=> component_id").select(F.col("doc_id").alias(left)).distinct(), "gone")
    again = staged(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice)), "again")

    def sized(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= max_broadcast_ids else ids

    kept = docs.join(sized(gone), F.col(id_col) == F.col(left), "left_anti")
    if again.isEmpty():
        return kept
    again = sized(again)
    once = kept.join(again, F.col(id_col) == F.col(twice), "left_anti")
    return once.unionAll(kept.join(again, F.col(id_col) == F.col(twice), "left_semi").dropDuplicates([id_col, text_col]))


def oracle(table: str = "documents", shingle: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for jaccard_components() (ids are unique)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    window = " || ' ' || ".join(["x", *(f"lead(x, {i}) OVER v" for i in range(1, shingle))])
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
v AS (SELECT doc_id, {window} AS x, lead(x, {shingle - 1}) OVER v IS NOT NULL AS whole FROM t WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
u AS (SELECT DISTINCT doc_id, x FROM v WHERE whole
      UNION ALL SELECT doc_id, 'few ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {shingle - 1}),
n AS (SELECT d.doc_id, count(u.x) AS n FROM d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= {percent} * (na.n + nb.n - inter)),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY ALL"""
