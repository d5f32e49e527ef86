"""Stupid-backoff language-model scores, computed relationally.

The corpus is the input itself.  Counts of all n-grams up to ``order`` form one table
partitioned by n-gram hash; the documents' n-grams are joined to it, and their log scores are
summed per document.  A document's own occurrences are taken off the counts first, so a text
is scored by the others, and the model does back off:

    S(w | h) = c(h w) / c(h)          if c(h w) > 0
             = alpha * S(w | h')      otherwise, h' without its first word
    S(w)     = max(c(w), 1/2) / N

with c and N counted over the other documents.  Words are lower-cased runs of letters, digits
and non-ASCII characters.

To keep the shuffle small, n-grams travel packed:

1. Documents are dealt into chunks of about ``chunk_bytes`` by the smallest hash of their three-word runs, so
   near copies mostly share a chunk and their n-grams travel once.  A chunk over 1.5 times that size is dealt
   over several (packages of rows by their place in the input, so repeated rows spread too; the input's rows
   must come in the same order when a lost task is repeated, as they do from a written table).
2. A chunk sends each part of the pair table the sorted fingerprints of its distinct word pairs and is told which of
   them another chunk has (one bit).  An n-gram can only be elsewhere if all its pairs are, so the rest has its counts
   at home.  A fingerprint has 6 bits more than the number of words takes; a false "elsewhere" costs bytes, never a count.
3. Of single words and of n-grams that may be elsewhere it sends each part of the count table the sorted hashes with their
   counts, as one row with byte-packed differences (of the counts only those above 1); the part adds the counts up and
   answers each row with what the other chunks have, in the same order.
4. The chunk's texts (dealt out once, compressed) meet the answers in a cogroup by chunk.

A frequent n-gram is one entry for each chunk.  An n-gram is known by two
hashes over its words, 64 and 32 bits at every size: of n distinct n-grams n ** 2 / 2 ** 97 pairs share
a count (5e9 of them: 1.6e-10).  Words enter by their 64-bit hash, so two words of one hash would be one word
(among 1e8 words with a chance of 3e-4).  Should an n-gram get more counts than its history all the
same, it counts as often as its history.

Edge cases: null or empty texts and texts without words have 0 words and score 0; very long
texts are scored whole (a chunk then holds one of them); repeated rows are documents of their
own, null ids too; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm import textpack as tp
from demandlens.llm.stage import partitions, staged

U64 = np.uint64
BITS = (64, 32)
CHUNK_BYTES = 4 << 20
PART_BYTES = 32 << 20  # of text for each part of the tables, where the session has fewer partitions
ROW_BYTES = 16  # what a row without text counts
PIECES = 1 << 24
ZSTD_LEVEL = 1
SECOND = U64(0x9E3779B97F4A7C15)
FACTORS = U64(0xD1342543DE82EF95), U64(0xAF251AF3B0F025B5)


def pack(a: np.ndarray, width: int = 0) -> tuple[int, bytes]:
    """(bytes per value, values cut to that many low bytes); as many as the largest needs unless given."""
    width = width or (max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1)
    return width, np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def pack_sparse(a: np.ndarray) -> list[tuple[int, bytes]]:
    """Non-zero values with the distances between them."""
    at = np.flatnonzero(a)
    return [pack(np.diff(at, prepend=0)), pack(a[at])]


def unpack_sparse(cells: list[tuple[int, bytes]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[np.cumsum(unpack(*cells[0]).astype(np.int64))] = unpack(*cells[1])
    return out


def pack_patched(a: np.ndarray) -> list[tuple[int, bytes]]:
    """Values in the width that takes least room, the high parts of the few larger ones apart."""
    bits = np.bincount((np.frexp(np.maximum(a, 1).astype(np.float64))[1] + 7) // 8, minlength=10)
    larger = len(a) - np.cumsum(bits)  # values of more than w bytes
    width = 1 + int(np.argmin([len(a) * w + 12 * larger[w] for w in range(1, 9)]))
    high = a >> U64(8 * width) if width < 8 else np.zeros(len(a), U64)
    return [pack(a, width), *pack_sparse(high)]


def unpack_patched(cells: list[tuple[int, bytes]]) -> np.ndarray:
    low = unpack(*cells[0])
    if cells[0][0] == 8:
        return low
    return low + (unpack_sparse(cells[1:], len(low)).astype(U64) << U64(8 * cells[0][0]))


def squeeze(cells: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Cells compressed one by one, each with its length before it."""
    return [(w, len(d).to_bytes(8, "little") + pa.Codec("zstd", ZSTD_LEVEL).compress(d, asbytes=True)) for w, d in cells]


def unsqueeze(cells: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    return [(w, pa.Codec("zstd").decompress(d[8:], int.from_bytes(d[:8], "little"), asbytes=True)) for w, d in cells]


def in_order(high: np.ndarray, low: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order by both hashes, where another n-gram begins in it); kind as in np.argsort."""
    by = np.argsort(high, kind=kind)
    same, step = high[by][1:] == high[by][:-1], low[by]
    if np.any(same & (step[1:] < step[:-1])):  # one first hash, several second ones: rare
        by = np.lexsort((low, high))
        same, step = high[by][1:] == high[by][:-1], low[by]
    return by, np.flatnonzero(np.append(True, ~same | (step[1:] != step[:-1]))) if len(by) else np.zeros(0, np.int64)


class Grams:
    """n-grams of a chunk's texts, order by order: both hashes and position of the last word."""

    def __init__(self, col: pa.Array, order: int, bits: tuple[int, int]):
        data, offs = tp.buffers(col)
        w = tp.Words(data[offs[0]:offs[-1]], offs - offs[0], tp.letter_table())
        self.words, self.row = np.diff(w.bounds), w.row
        place = np.arange(len(w.row)) - w.bounds[:-1][w.row]  # of a word in its text
        keep = U64((1 << 64) - (1 << (64 - bits[0])))
        # polynomials over the words' hashes: those of an order are one step from those of the order before
        other = tp.mix(w.hash ^ SECOND) if bits[1] else None
        first, second = w.hash, other
        self.at, self.high, self.low = [], [], []
        for n in range(1, order + 1):
            if n > 1:
                first = np.append(U64(0), first[:-1]) * FACTORS[0] + w.hash if len(first) else first
                second = np.append(U64(0), second[:-1]) * FACTORS[1] + other if bits[1] and len(first) else second
            at = np.flatnonzero(place >= n - 1)
            self.at.append(at)
            self.high.append(tp.mix(first[at] + U64(n)) & keep)
            self.low.append((second[at] >> U64(32) >> U64(32 - bits[1])).astype(np.uint32) if bits[1] else np.zeros(len(at), np.uint32))

    def pairs(self, shift: int) -> np.ndarray:
        """Sorted distinct fingerprints of the word pairs: first hashes without their last ``shift`` bits."""
        if len(self.high) < 2 or not len(self.high[1]):
            return np.zeros(0, U64)
        f = np.sort(self.high[1] >> U64(shift))
        return f[np.append(True, f[1:] != f[:-1])]

    def elsewhere(self, pairs: np.ndarray, marks: np.ndarray, shift: int) -> list[np.ndarray]:
        """For each order which n-grams may be in another chunk: single words, marked pairs, and longer ones of marked pairs.
        Pairs are looked up by their fingerprints' last bits, in a table 64 times as long as the marked ones."""
        out = [np.ones(len(self.at[0]), bool)]
        marked = pairs[marks]
        last = U64((1 << (64 * len(marked)).bit_length()) - 1)
        table = np.zeros(int(last) + 1, bool)
        table[marked & last] = True
        for n in range(1, len(self.at)):
            if n == 1:
                out.append(table[(self.high[1] >> U64(shift)) & last])
                continue
            ends = np.zeros(len(self.row), bool)
            ends[self.at[n - 1]] = out[-1]
            out.append(ends[self.at[n]] & ends[self.at[n] - 1])
        return out

    def distinct(self, keep: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Both hashes of the distinct n-grams of all orders (of those to keep), sorted, their counts, and for each
        order which of them its n-grams are."""
        highs, lows = self.high, self.low
        if keep is not None:
            highs, lows = ([x[k] for x, k in zip(y, keep)] for y in (highs, lows))
        high, low = np.concatenate(highs), np.concatenate(lows)
        by, first = in_order(high, low)
        counts = np.diff(np.append(first, len(by)))
        which = np.empty(len(by), np.int64)
        which[by] = np.repeat(np.arange(len(first)), counts)
        return high[by][first], low[by][first], counts, np.split(which, np.cumsum([len(x) for x in highs])[:-1])


def homes(w: tp.Words, chunks: int) -> np.ndarray:
    """Chunk of every text: the smallest hash of its runs of three words (shorter texts: of all their words)."""
    h, n = w.hash, np.diff(w.bounds)
    out = np.zeros(len(n), U64)
    runs = h.copy()
    if len(h) > 2:
        three = w.row[:-2] == w.row[2:]
        runs[:-2] = np.where(three, tp.mix(h[:-2] + (h[1:-1] << U64(1)) + h[2:] * SECOND), h[:-2])
        long = n > 2
        last = np.concatenate([w.bounds[1:][long] - 2, w.bounds[1:][long] - 1])
        runs[last] = U64((1 << 64) - 1)
    some = n > 0
    if some.any():
        out[some] = np.minimum.reduceat(runs, w.bounds[:-1][some])
    return ((tp.mix(out) >> U64(32)) * U64(chunks) >> U64(32)).astype(np.int64)


def part_bounds(distinct: np.ndarray, number: int) -> np.ndarray:
    """Bounds of the table's parts in sorted first hashes."""
    part = (distinct >> U64(32)) * U64(number) >> U64(32)
    return np.searchsorted(part, np.arange(number + 1).astype(U64))


def score_chunk(g: Grams, which: list[np.ndarray], total: np.ndarray, n_total: int, alpha: float) -> np.ndarray:
    """Sum of log scores per text; total: corpus counts of the distinct n-grams."""
    def others(n: int) -> np.ndarray:  # corpus count less the text's own, per n-gram of this order
        at = which[n]
        key = g.row[g.at[n]] * len(total) + at
        order = np.argsort(key)
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        own = np.empty(len(key), np.int64)
        own[order] = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        return (total[at] - own).astype(np.float64)

    if not len(g.row):
        return np.zeros(len(g.words))
    lower = others(0)
    best = np.log(np.maximum(lower, 0.5) / np.maximum(n_total - g.words, 1)[g.row])
    for n in range(1, len(g.at)):
        if not len(g.at[n]):
            break
        # the history of an n-gram that ends at word i is the n-gram of one order less that ends at i - 1
        last = g.at[n]
        history = np.zeros(len(g.row))
        history[g.at[n - 1]] = lower
        history = history[last - 1]
        counts = np.minimum(others(n), history)
        seen = counts > 0
        best[last] += np.log(alpha)
        best[last[seen]] = np.log(counts[seen]) - np.log(history[seen])
        lower = counts
    return np.bincount(g.row, best, len(g.words))


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, id_col: str = "doc_id", text_col: str = "text",
              chunk_bytes: int = CHUNK_BYTES, bits: tuple[int, int] = BITS) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) for every row; bits: widths of an n-gram's two hashes."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    size = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    number = max(2 * partitions(docs.sparkSession), size // PART_BYTES)

    def placed(col):
        """Chunk, words and bytes of every text, a slice of the column at a time."""
        for _, _, buf, offs in tp.chunks(col):
            w = tp.Words(buf, offs, tp.letter_table())
            yield homes(w, chunks), np.diff(w.bounds), np.diff(offs) + ROW_BYTES

    def measure(batches):
        for b in batches:
            for chunk, n, nbytes in placed(b.column(0)):
                at, inverse = np.unique(chunk, return_inverse=True)
                sums = [np.bincount(inverse, x).astype(np.int64) for x in (n, nbytes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *sums)], ["home", "n", "size"])

    sizes = staged(rows.select("text").mapInArrow(measure, "home bigint, n bigint, size bigint")
                   .groupBy("home").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "lm")
    n_total = sizes.agg(F.sum("n")).first()[0] or 0
    shift = max(0, 64 - 6 - n_total.bit_length())
    large = sizes.filter(F.col("size") > int(1.5 * chunk_bytes)).select("home", F.ceil(F.col("size") / chunk_bytes).alias("pieces"))

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            chunk, _, nbytes = (np.concatenate(x) for x in zip(*placed(b.column(1))))
            by = np.argsort(chunk, kind="stable")
            before = np.cumsum(nbytes[by]) - nbytes[by]
            first = np.flatnonzero(np.append(True, chunk[by][1:] != chunk[by][:-1]))
            inside = before - np.repeat(before[first], np.diff(np.append(first, len(by))))
            package = inside // max(1, chunk_bytes // 8)  # a large chunk is dealt out in packages
            cut = np.flatnonzero(np.append(True, (chunk[by][1:] != chunk[by][:-1]) | (package[1:] != package[:-1])))
            out = []
            for lo, hi in zip(cut, np.append(cut[1:], len(by))):
                sink = pa.BufferOutputStream()
                own = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["doc_id", "text"]).take(pa.array(by[lo:hi]))
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(own)
                out.append((int(chunk[by[lo]]), sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())],
                                             ["home", "rows"])

    def texts(table: pa.Table) -> pa.Table:
        return pa.concat_tables(pa.ipc.open_stream(d.as_py()).read_all() for d in table["rows"]).combine_chunks()

    def column(table: pa.Table) -> pa.Array:
        col = table["text"].cast(pa.large_string()).combine_chunks()
        return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col

    def grams(table: pa.Table, orders: int = order, widths: tuple[int, int] = bits) -> Grams:
        return Grams(column(texts(table)), orders, widths)

    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary())
    names = ["part", "chunk", "widths", "cells", "marks"]
    form = "part bigint, chunk bigint, widths array<int>, cells array<binary>, marks binary"

    def packed_rows(out: list[tuple]) -> pa.Table:
        cols = [[p, c, [w for w, _ in cells], [d for _, d in cells], m] for p, c, cells, m in out]
        cols = list(zip(*cols)) if out else [[]] * 5
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds)], names)

    def cells_of(table: pa.Table) -> list[list[tuple[int, bytes]]]:
        return [list(zip(w, d)) for w, d in zip(table["widths"].to_pylist(), table["cells"].to_pylist())]

    def ask(table: pa.Table) -> pa.Table:
        """A chunk's distinct pair fingerprints for each part."""
        pairs = grams(table, min(order, 2), (bits[0], 0)).pairs(shift)
        cut, chunk = part_bounds(pairs << U64(shift), number), table["chunk"][0].as_py()
        return packed_rows([(int(p), chunk, pack_patched(np.diff(pairs[cut[p]:cut[p + 1]], prepend=U64(0))), None)
                            for p in np.flatnonzero(np.diff(cut))])

    def mark(table: pa.Table) -> pa.Table:
        """Which fingerprints several chunks have."""
        part, chunk = table["part"][0].as_py(), table["chunk"].to_pylist()
        f = [np.cumsum(unpack_patched(x), dtype=U64) for x in cells_of(table)]
        every = np.sort(np.concatenate(f))
        several = np.append(every[1:][every[1:] == every[:-1]], U64((1 << 64) - 1))  # the last: an end, in no search's way
        out = [(part, c, [], np.packbits(several[np.searchsorted(several[:-1], x)] == x).tobytes()) for c, x in zip(chunk, f)]
        return packed_rows(out)

    def send(table: pa.Table, marked: pa.Table) -> pa.Table:
        """Words and the n-grams that may be elsewhere, for each part; the first row carries the pairs' marks."""
        g = grams(table)
        pairs = g.pairs(shift)
        cut, marks = part_bounds(pairs << U64(shift), number), np.zeros(len(pairs), bool)
        for p, m in zip(marked["part"].to_pylist(), marked["marks"].to_pylist()):
            marks[cut[p]:cut[p + 1]] = np.unpackbits(np.frombuffer(m, np.uint8), count=cut[p + 1] - cut[p])
        h, low, c, _ = g.distinct(g.elsewhere(pairs, marks, shift))
        del g
        cut, chunk, out = part_bounds(h, number), table["chunk"][0].as_py(), []
        for p in np.flatnonzero(np.diff(cut)):
            x = h[cut[p]:cut[p + 1]]
            cells = [*pack_patched(np.diff(x, prepend=U64(0))), *pack_sparse(c[cut[p]:cut[p + 1]] - 1), pack(low[cut[p]:cut[p + 1]], -(-bits[1] // 8) or 1)]
            out.append((int(p), chunk, cells, None if out else np.packbits(marks).tobytes()))
        return packed_rows(out)

    def add_up(table: pa.Table) -> pa.Table:
        part, chunk, marks = table["part"][0].as_py(), table["chunk"].to_pylist(), table["marks"].to_pylist()
        cells = cells_of(table)
        h = [np.cumsum(unpack_patched(x[:3]), dtype=U64) for x in cells]
        c = [1 + unpack_sparse(x[3:5], len(y)) for x, y in zip(cells, h)]
        low = np.concatenate([unpack(*x[5]).astype(np.uint32) for x in cells])
        del cells
        every, counts = np.concatenate(h), np.concatenate(c)
        by, first = in_order(every, low, "stable")
        total = np.add.reduceat(counts[by], first)
        answer = np.empty(len(every), np.int64)
        answer[by] = np.repeat(total, np.diff(np.append(first, len(every))))
        answer -= counts  # what the other chunks have
        cuts = np.cumsum([0, *map(len, h)])
        return packed_rows([(part, k, squeeze(pack_patched(answer[a:b].astype(U64))), m) for k, a, b, m in zip(chunk, cuts, cuts[1:], marks)])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = texts(table)
        g = Grams(column(own), order, bits)
        _, _, total, which = g.distinct()
        a = answers.sort_by("part")
        others = [unpack_patched(unsqueeze(x)).astype(np.int64) for x in cells_of(a)]
        if others:
            pairs = g.pairs(shift)
            marks = next((m for m in a["marks"].to_pylist() if m is not None), b"")
            marks = np.unpackbits(np.frombuffer(marks, np.uint8), count=len(pairs)).astype(bool)
            sent = np.zeros(len(total), bool)
            for w, k in zip(which, g.elsewhere(pairs, marks, shift)):
                sent[w[k]] = True
            total[sent] += np.concatenate(others)
        s = score_chunk(g, which, total, n_total, alpha)
        return pa.table([own["doc_id"], pa.array(g.words.astype(np.int64)), pa.array(s)], ["doc_id", "n_words", "log_score"])

    packages = rows.mapInArrow(deal, "home bigint, rows binary").withColumn("place", F.monotonically_increasing_id())
    piece = F.pmod(F.xxhash64("place"), F.coalesce("pieces", F.lit(1)))
    dealt = packages.join(large, "home", "left").select((F.col("home") * PIECES + piece).alias("chunk"), "rows")
    marked = dealt.groupBy("chunk").applyInArrow(ask, form).groupBy("part").applyInArrow(mark, form)
    sent = dealt.groupBy("chunk").cogroup(marked.groupBy("chunk")).applyInArrow(send, form)
    answers = sent.groupBy("part").applyInArrow(add_up, form)
    scored = (dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
              .applyInArrow(finish, f"doc_id {kind}, n_words bigint, log_score double"))
    return scored.withColumn("mean_log_score", F.coalesce(F.try_divide("log_score", "n_words"), F.lit(0.0)))


def oracle(table: str = "documents", alpha: float = 0.4) -> str:
    """DuckDB SQL for lm_scores() with order 3, scores rounded to 4 digits."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table}),
t AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
g AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS b, CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS c FROM t),
p AS (SELECT r, i, a AS x FROM g UNION ALL SELECT r, i, b FROM g WHERE b IS NOT NULL UNION ALL SELECT r, i, c FROM g WHERE c IS NOT NULL),
o AS (SELECT r, x, count(*) AS n FROM p GROUP BY r, x),
a AS (SELECT x, sum(n) AS n FROM o GROUP BY x),
k AS (SELECT o.r, o.x, (a.n - o.n)::DOUBLE AS n FROM o JOIN a USING (x)),
s AS (SELECT g.r, g.i, ka.n AS na, kb.n AS nb, kc.n AS nc, lag(ka.n) OVER v AS ha, lag(kb.n) OVER v AS hb
      FROM g JOIN k ka ON ka.r = g.r AND ka.x = g.a LEFT JOIN k kb ON kb.r = g.r AND kb.x = g.b LEFT JOIN k kc ON kc.r = g.r AND kc.x = g.c
      WINDOW v AS (PARTITION BY g.r ORDER BY g.i)),
z AS (SELECT d.r, greatest((SELECT sum(len(w)) FROM d) - len(w), 1)::DOUBLE AS others FROM d),
u AS (SELECT s.r, ln(greatest(na, 0.5) / others) AS l1, nb, nc, ha, hb FROM s JOIN z USING (r)),
e AS (SELECT r, nc, hb, CASE WHEN nb IS NULL THEN l1 WHEN nb > 0 THEN ln(nb) - ln(ha) ELSE l1 + ln({alpha}) END AS l2 FROM u),
f AS (SELECT r, sum(CASE WHEN nc IS NULL THEN l2 WHEN nc > 0 THEN ln(nc) - ln(hb) ELSE l2 + ln({alpha}) END) AS l FROM e GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(l, 0), 4) AS log_score, round(CASE WHEN len(w) > 0 THEN l / len(w) ELSE 0 END, 4) AS mean_log_score
FROM d LEFT JOIN f USING (r)"""
