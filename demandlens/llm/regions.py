"""Content-anchored regions: where equal windows of different documents can meet.

A window is L consecutive symbols (bytes or words) of one document.  Its anchor is the
leftmost smallest k-gram hash inside it (winnowing).  Equal windows have equal anchors, so work
on windows can be dealt out by anchor hash and no match is lost.  Consecutive windows with one
anchor position form a region, the symbols that they cover; every window is in one region.

``shared_regions`` deals the regions by anchor into parts (their number follows the bytes of all texts; packed rows:
hashes, positions, lengths, no text) and finds which anchors occur twice.  Identical regions are collapsed, first inside a chunk, then
in a part: the first occurrence of every distinct region goes to the operator that judges windows
(its ``solve`` sees the symbols, shard by shard), and further copies, whose windows all start earlier
in the first, are removed as a whole.  ``judged`` brings everything back to the documents.  A larger k means more regions but fewer whose
anchor is shared by chance or by a frequent line.

The regions of an anchor that hold more than ``batch`` symbols (a frequent line, each time in another context) are
dealt by place into pieces of about half as many, judged one by one.  Windows that no piece finds
earlier meet by the hash of their content, a function of the window alone, and are judged again: a piece
keeps one of each, so a hash has at most as many of them as its anchor has pieces.

Documents are ordered by id; rows that share an id with another are ordered by the hash of their text
behind it, and rows equal in both are one document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandlens.llm import textpack as tp
from demandlens.llm.lm_score import pack, unpack
from demandlens.llm.stage import by_part, dealt, small_batches, staged, tasks_for

U64 = np.uint64
NO_ID = -(1 << 63)
MAX_BROADCAST_IDS = 1_000_000
PIECE = 1 << 22
LOW = U64((1 << 24) - 1)
BATCH_SYMBOLS = 1 << 20
CHUNK_BYTES = 1 << 20


class Symbols:
    """The symbols of a chunk's rows: bytes, or words (``words`` True)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, words: bool):
        if words:
            self.words = tp.Words(buf, offs, tp.space_table(lower=False))
            self.values, self.bounds = self.words.hash, self.words.bounds
            self.prefix = tp.sequence_prefix(self.values)
        else:
            self.values, self.bounds = buf, offs
            self.prefix = tp.prefix(buf)


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of h[i:i+width] (by its upper 40 bits) for every i."""
    out = np.zeros(max(0, len(h) - width + 1), np.int64)
    for at in range(0, len(out), PIECE):
        x = h[at:at + PIECE + width - 1]
        cur, span = (x & ~LOW) | np.arange(len(x), dtype=U64), 1
        while 2 * span <= width:
            cur = np.minimum(cur[:-span], cur[span:])
            span *= 2
        n = len(x) - width + 1
        out[at:at + n] = (np.minimum(cur[:n], cur[width - span:width - span + n]) & LOW).astype(np.int64) + at
    return out


def regions(s: Symbols, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(start, end, row, anchor hash, content hash) of the regions of a chunk."""
    n = len(s.values)
    count = np.maximum(np.diff(s.bounds) - length + 1, 0)
    at = tp.segment_ranges(s.bounds[:-1], count)
    if not len(at):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), np.zeros(0, U64)
    i = np.arange(n - k + 1)
    grams = tp.range_hash(s.prefix, i, i + k)
    anchor = leftmost_minima(grams, length - k + 1)[at]
    row = np.repeat(np.arange(len(count)), count)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, end = at[first], at[last] + length
    # smallest hashes are small: mixed again, they fall evenly into parts
    return start, end, row[first], tp.mix(grams[anchor[first]]), tp.range_hash(s.prefix, start, end)


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text): tie is 0, or the text's hash where several rows have the id."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    again = staged(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc").alias("again")), "again")
    n = again.count()
    if n == 0:
        return docs.select("doc", F.lit(0).cast("long").alias("tie"), "text")
    again = F.broadcast(again) if n <= MAX_BROADCAST_IDS else again
    tied = docs.join(again, F.col("doc") == F.col("again"), "left")
    return tied.select("doc", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(0).alias("tie"), "text")


def _earlier_first(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def shared_regions(docs: DataFrame, length: int, k: int, words: bool, batch: int, tasks: int) -> DataFrame:
    """(doc, tie, off, len, anchor, open, split): regions whose anchor occurs twice; open False: a
    further copy of a region, removed as a whole; open True: to be judged; split: with a piece of
    its anchor's group only, and anchor then stands for the piece."""
    parts = 2 * tasks

    def emit(batches):
        for b in batches:
            doc_ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi, buf, offs in tp.chunks(b.column(2), CHUNK_BYTES):
                s = Symbols(buf, offs, words)
                start, end, row, anchor, content = regions(s, length, k)
                if not len(start):
                    continue
                doc, tie, off, size = doc_ids[lo + row], ties[lo + row], start - s.bounds[row], end - start
                order = _earlier_first(anchor, content, doc, tie, off)
                doc, tie, off, size, anchor, content = (x[order] for x in (doc, tie, off, size, anchor, content))
                same = np.zeros(len(doc), bool)
                same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                # The chunk's first of a region travels; the others start later (but for one place
                # that repeated rows report).
                gone = np.zeros(len(doc), bool)
                gone[1:] = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (off[1:] == off[:-1]) & same[1:]
                doc, tie, off, size, anchor, content, same = (x[~gone] for x in (doc, tie, off, size, anchor, content, same))
                later = same
                part = ((anchor >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                # any part passes these on: each chunk has one of its own choice
                own = int(tp.mix(doc_ids[lo:lo + 1].astype(np.int64).view(U64) + U64(hi))[0] % U64(parts))
                part[later] = own
                out = []
                for is_later, pick in ((False, ~later), (True, later)):
                    at = np.flatnonzero(pick)
                    cut = np.searchsorted(part[at], np.arange(parts + 1)) if not is_later else None
                    for p in (np.flatnonzero(np.diff(cut)) if not is_later else [own] if len(at) else []):
                        x = at[cut[p]:cut[p + 1]] if not is_later else at
                        cols = [(np.diff(anchor[x], prepend=U64(0)) if not is_later else np.zeros(len(x), U64)), content[x] >> U64(16),
                                doc[x].view(U64), tie[x].view(U64), off[x].astype(U64), size[x].astype(U64)]
                        out.append((int(p), is_later, [pack(c) for c in cols]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in out], pa.int32()), pa.array([x for _, x, _ in out], pa.bool_()),
                     pa.array([[w for w, _ in c] for _, _, c in out], pa.list_(pa.int32())),
                     pa.array([[d for _, d in c] for _, _, c in out], pa.list_(pa.binary()))], ["part", "later", "widths", "cols"])

    def meet(batches):
        for cells_of in by_part(batches):
            got = [(x, [unpack(w, d) for w, d in zip(ws, ds)]) for x, ws, ds in cells_of]
            yield from met(got)
            del got, cells_of
            tp.released()

    def met(got):
        for is_later in (True, False):
            cells = [c for x, c in got if x == is_later]
            if not cells:
                continue
            anchor = np.concatenate([np.cumsum(c[0], dtype=U64) for c in cells])
            content = np.concatenate([c[1] for c in cells])
            doc, tie, off, size = (np.concatenate([c[j] for c in cells]).view(np.int64) for j in range(2, 6))
            if is_later:
                use, open_, split = np.arange(len(doc)), np.zeros(len(doc), bool), np.zeros(len(doc), bool)
            else:
                order = _earlier_first(anchor, content, doc, tie, off)
                anchor, content, doc, tie, off, size = (x[order] for x in (anchor, content, doc, tie, off, size))
                twin = np.zeros(len(doc), bool)  # one place reported by repeated rows
                twin[1:] = ((anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (doc[1:] == doc[:-1])
                            & (tie[1:] == tie[:-1]) & (off[1:] == off[:-1]))
                anchor, content, doc, tie, off, size = (x[~twin] for x in (anchor, content, doc, tie, off, size))
                group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
                shared = (np.bincount(group) > 1)[group]
                same = np.zeros(len(doc), bool)
                same[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                use, open_ = np.flatnonzero(shared), ~same
                pieces = -(-2 * np.bincount(group[open_], size[open_]).astype(np.int64) // batch)
                split = open_ & (pieces > 2)[group]
                x = np.flatnonzero(split)
                place = tp.mix(tp.mix(tp.mix(doc[x].view(U64)) + tie[x].view(U64)) + off[x].view(U64))
                anchor[x] ^= tp.mix(place % pieces[group[x]].astype(U64) + U64(1))
            for i in range(0, len(use), 100_000):
                x = use[i:i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(v[x]) for v in (doc, tie, off, size)), pa.array(anchor[x].view(np.int64)), pa.array(open_[x]), pa.array(split[x])],
                    ["doc", "tie", "off", "len", "anchor", "open", "split"])

    packed = docs.mapInArrow(emit, "part int, later boolean, widths array<int>, cols array<binary>")
    return dealt(packed, tasks).mapInArrow(
        meet, "doc bigint, tie bigint, off bigint, len bigint, anchor bigint, open boolean, split boolean")


Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def solved(docs: DataFrame, found: DataFrame, length: int, words: bool, solve: Solve, batch: int, tasks: int) -> DataFrame:
    """(doc, tie, off, len, key): key null: a span covered by windows that start earlier in a region of
    the same anchor; else a window of a split region that doesn't, with the hash of its content."""
    parts = 4 * tasks
    asked = found.groupBy("doc", "tie").agg(F.collect_list(F.struct("off", "len", "anchor", "split")).alias("wanted"))

    def cut_out(batches):
        for b in batches:
            doc, tie = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in tp.chunks(b.column(2), CHUNK_BYTES):
                s = Symbols(buf, offs, words)
                lists = b.column(3).slice(lo, hi - lo)
                n = np.diff(lists.offsets.to_numpy())
                off, size, anchor, split = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                row = np.repeat(np.arange(hi - lo), n)
                begin = s.bounds[row] + off
                part = ((anchor.view(U64) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(cut)):
                    x = order[cut[p]:cut[p + 1]]
                    values = s.values[tp.segment_ranges(begin[x], size[x])]
                    rows.append((int(p), [v.astype(np.int64).tobytes() for v in (anchor[x], doc[lo + row[x]], tie[lo + row[x]], off[x], size[x])]
                                 + [values.tobytes(), split[x].astype(bool).tobytes()]))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()),
                                                  pa.array([c for _, c in rows], pa.list_(pa.binary()))], ["part", "cols"])

    def judge(batches):
        for rows in by_part(batches):
            yield from judged_part([c for c, in rows])
            del rows
            tp.released()

    def judged_part(got):
        anchor, doc, tie, off, size = (np.concatenate([np.frombuffer(c[j], np.int64) for c in got]) for j in range(5))
        values = np.concatenate([np.frombuffer(c[5], U64 if words else np.uint8) for c in got])
        split = np.concatenate([np.frombuffer(c[6], bool) for c in got])
        where = np.cumsum(size) - size
        # Anchors, or pieces of one, stay together; batches of them hold about ``batch`` symbols.
        by = np.lexsort((off, tie, doc, anchor))
        twin = np.zeros(len(by), bool)  # repeated rows send one place several times
        twin[1:] = np.all([c[by][1:] == c[by][:-1] for c in (anchor, doc, tie, off)], axis=0)
        by = by[~twin]
        total = np.cumsum(size[by])
        edge = np.append(np.flatnonzero(anchor[by][1:] != anchor[by][:-1]) + 1, len(by))
        at = 0
        while at < len(by):
            done = total[at - 1] if at else 0
            k_ = np.searchsorted(total[edge - 1], done + batch, "right") - 1
            stop = int(edge[max(k_, np.searchsorted(edge, at, "right"))])
            x = by[at:stop]
            x = x[np.lexsort((off[x], tie[x], doc[x]))]
            at = stop
            width = size[x] + 1  # a 0 behind each region
            starts = np.cumsum(width) - width
            text = np.zeros(int(width.sum()), np.int64)
            plain = values[tp.segment_ranges(where[x], size[x])]
            text[tp.segment_ranges(starts, size[x])] = np.unique(plain, return_inverse=True)[1] + 1 if words else plain.astype(np.int64) + 1
            earlier = solve(text, starts, size[x], length)
            hit = np.flatnonzero(earlier)
            run = np.flatnonzero(np.append(True, hit[1:] != hit[:-1] + 1)) if len(hit) else hit
            first, last = hit[run], hit[np.append(run[1:], len(hit)) - 1] if len(hit) else hit
            r = np.searchsorted(starts, first, "right") - 1
            cells = [(doc[x][r], tie[x][r], off[x][r] + first - starts[r], last - first + length, np.zeros(len(r), np.int64), True)]
            part = np.flatnonzero(split[x])
            if len(part):
                count = size[x][part] - length + 1
                r, at_ = np.repeat(part, count), tp.segment_ranges(starts[part], count)
                kept = np.flatnonzero(~earlier[at_])
                r, at_ = r[kept], at_[kept]
                begin = at_ - r  # in plain, which has no 0 behind the regions
                key = tp.range_hash(tp.sequence_prefix(plain) if words else tp.prefix(plain), begin, begin + length)
                for i in range(0, len(r), 100_000):
                    c = r[i:i + 100_000]
                    cells.append((doc[x][c], tie[x][c], off[x][c] + at_[i:i + 100_000] - starts[c],
                                  np.full(len(c), length), key[i:i + 100_000].view(np.int64), False))
            for *cols, no_key in cells:
                cols = [pa.array(v, pa.int64()) for v in cols]
                yield pa.RecordBatch.from_arrays([*cols[:4], pa.nulls(len(cols[0]), pa.int64()) if no_key else cols[4]],
                                                 ["doc", "tie", "off", "len", "key"])

    cut = (docs.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "wanted")
           .mapInArrow(cut_out, "part int, cols array<binary>"))
    return dealt(cut, tasks).mapInArrow(judge, "doc bigint, tie bigint, off bigint, len bigint, key bigint")


def removed_spans(docs: DataFrame, length: int, k: int, words: bool, solve: Solve, batch: int = BATCH_SYMBOLS) -> DataFrame:
    """(doc, tie, spans): spans [off, off + len) covered by windows that start earlier elsewhere.

    solve(symbols, starts, sizes, length) gets regions in document order, laid one after another
    with a 0 behind each, and returns for every symbol whether the window that starts there
    occurs at a smaller position.  It gets about ``batch`` symbols at once."""
    cols = ["doc", "tie", "off", "len"]
    tasks = tasks_for(docs)
    found = staged(shared_regions(docs, length, k, words, batch, tasks), "regions")
    every = solved(docs, found.filter("open"), length, words, solve, batch, tasks)
    if not found.filter("split").isEmpty():
        every = staged(every, "pieces")
        again = (every.filter("key is not null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("n > 1")
                 .select(*cols, F.col("key").alias("anchor"), F.lit(False).alias("split")))
        every = every.filter("key is null").select(cols).unionAll(solved(docs, again, length, words, solve, batch, tasks).select(cols))
    every = every.select(cols).unionAll(found.filter("not open").select(cols))
    return every.groupBy("doc", "tie").agg(F.collect_list(F.struct("off", "len")).alias("spans"))


def judged(docs: DataFrame, length: int, k: int, words: bool, solve: Solve, finish, schema: str, batch: int = BATCH_SYMBOLS) -> DataFrame:
    """finish(symbols, chunk bytes, removed mask per symbol) per chunk, over all documents; its
    columns come behind the document id."""
    spans = removed_spans(docs, length, k, words, solve, batch)

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tp.chunks(b.column(1), CHUNK_BYTES):
                s = Symbols(buf, offs, words)
                lists = b.column(2).slice(lo, hi - lo)
                n = np.diff(lists.offsets.to_numpy())
                n[lists.is_null().to_numpy(zero_copy_only=False)] = 0
                off, size = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                begin = np.repeat(s.bounds[:-1], n) + off
                step = np.zeros(len(s.values) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + size, -1)
                cols = finish(s, buf, np.cumsum(step[:-1]) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], ["doc", *(f"c{i}" for i in range(len(cols)))])

    done = docs.join(spans, ["doc", "tie"], "left").select("doc", "text", "spans").mapInArrow(
        run, "doc bigint, " + ", ".join(f"c{i} {t.split()[1]}" for i, t in enumerate(schema.split(", "))))
    names = [t.split()[0] for t in schema.split(", ")]
    return done.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
                       *(F.col(f"c{i}").alias(x) for i, x in enumerate(names)))
