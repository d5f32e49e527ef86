"""Packing documents into windows by the sum-of-squares rule, online.

Each text is tokenised whole, followed by one ``end_id``.  Every task packs its own rows as they
come, without a shuffle.  A document first gives away its full windows; the rest, of s tokens,
goes to the fill level h that minimises the sum over levels of N(h)^2, where the level array N
counts the partially filled windows of each fill.  Placing s at h takes 2 N(h) - 1 from that sum
and adds 2 N(h + s) + 1, so one vector expression over the array decides; level 0 opens a
window, and the fullest level wins ties.  Cutting is free: where filling a window up with the
document's head and opening a new one with its tail lowers the sum by more than ``CUT`` below
the best whole placement, the document is cut there.  So no level ever holds more than a few
windows, and the open windows of a task stay bounded whatever the sizes.

At the end of a task its open windows (at most a few for each level, however many rows there were) are
closed: the emptiest give their tokens to the fullest, and the last one, of L tokens, is cut
into windows whose lengths are the powers of two in L.  So every window is full or holds a power
of two, and none is padded.

Sequence ids are (partition << 32) + number in the task; a repeated or lost task packs the same
rows of the same partition in the same way.

Edge cases: null and empty texts are documents of one token (``end_id``); repeated rows and null
ids are documents of their own; the control strings of the tokenizer are ordinary text; a text
longer than a window gives several pieces, however long it is (its tokens are held once, in one
task); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.textpack import chunks

WINDOW = 2048
END_ID = 1
CUT = 2
BATCH_BYTES = 1 << 18
# fixed value: the pre-token pattern of the byte-level vocabulary
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]*")


class Packer:
    """Open windows of one task.  A piece is (document, start in it, ids)."""

    def __init__(self, window: int, emit):
        self.window, self.emit = window, emit
        self.level = np.zeros(window + 1, np.int64)  # N(h); entries 0 and window stay 0
        self.gain = np.zeros(window + 1, np.int64)  # 2 N(h) - 1 where N(h) > 0, else none
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.gain[:] = -1 << 40
        self.gain[0] = 0

    def change(self, h: int, by: int) -> None:
        if 0 < h < self.window:
            self.level[h] += by
            self.gain[h] = 2 * self.level[h] - 1 if self.level[h] else -1 << 40

    def put(self, h: int, piece: tuple) -> None:
        """Adds the piece to a window of fill h (0: a new one)."""
        w = self.open[h].pop() if h else []
        self.change(h, -1)
        w.append(piece)
        h += len(piece[2])
        if h == self.window:
            self.emit(w)
        else:
            self.open[h].append(w)
            self.change(h, 1)

    def add(self, doc: int, ids: np.ndarray) -> None:
        b, at = self.window, 0
        while len(ids) - at >= b:
            self.emit([(doc, at, ids[at:at + b])])
            at += b
        s = len(ids) - at
        if not s:
            return
        # whole: levels 0 .. b - s; the level that is reached costs 2 N + 1, a full window nothing
        cost = 2 * self.level[s:] + 1 - self.gain[:b - s + 1]
        cost[-1] -= 1
        h = b - s - int(np.argmin(cost[::-1]))
        if s > 1:
            # cut: levels b - s + 1 .. b - 1 are filled up, the tail of 1 .. s - 1 tokens opens a window
            cuts = 2 * self.level[1:s] + 1 - self.gain[b - s + 1:b]
            c = int(np.argmin(cuts))
            if cuts[c] + CUT < cost[h]:
                fill = b - s + 1 + c
                self.put(fill, (doc, at, ids[at:at + b - fill]))
                at, h = at + b - fill, 0
        self.put(h, (doc, at, ids[at:].copy() if at else ids))

    def close(self) -> None:
        b = self.window
        left = [w for h in range(b - 1, 0, -1) for w in self.open[h]]
        self.open = [[] for _ in range(b + 1)]
        lo, hi = 0, len(left) - 1
        room = lambda w: b - sum(len(p[2]) for p in w)
        while lo < hi:
            need = room(left[lo])
            while need and lo < hi:
                doc, start, ids = left[hi].pop()
                left[lo].append((doc, start, ids[:need]))
                if len(ids) > need:
                    left[hi].append((doc, start + need, ids[need:]))
                need -= min(need, len(ids))
                hi -= not left[hi]
            if not need:
                self.emit(left[lo])
                lo += 1
        for w in left[lo:hi + 1]:
            total = b - room(w)
            for bit in range(b.bit_length() - 1, -1, -1):  # the powers of two in the fill
                if total >> bit & 1:
                    part, need = [], 1 << bit
                    while need:
                        doc, start, ids = w.pop()
                        part.append((doc, start, ids[:need]))
                        if len(ids) > need:
                            w.append((doc, start + need, ids[need:]))
                        need -= min(need, len(ids))
                    self.emit(part)


def encoder(tokenizer: str, ranks: str | None):
    """list of texts -> list of id arrays.  A text of plain characters only, whose classes (letter, digit,
    space, other) every version of Unicode agrees on, takes the faster library with the same merges, when
    given: lowest-rank merges inside the same pre-tokens give the same ids.  All others take the first."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.encode_special_tokens = True
    whole = lambda texts: [np.array(c.ids, np.int32) for c in model.encode_batch_fast(texts, add_special_tokens=False)]
    if ranks is None:
        return whole
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})

    def encode(texts):
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        others = iter(whole([t for t, p in zip(texts, plain) if not p]))
        return [fast.encode_to_numpy(t).astype(np.int32) if p else next(others) for t, p in zip(texts, plain)]

    return encode


PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    token ids (``ids``) on request.  tokenizer: path of a tokenizers JSON file on every executor;
    ranks: path of the same byte-level vocabulary as ranks, which speeds up plain texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer, ranks)
        first = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        sequences = 0
        names: dict[int, list] = {}  # document -> [id, tokens, tokens not yet returned]

        def emit(pieces):
            nonlocal sequences
            offset = 0
            for doc, start, ids in pieces:
                out.append((doc, start, ids, first + sequences, offset))
                offset += len(ids)
            sequences += 1

        packer = Packer(window, emit)

        def rows_out():
            ids, total = [], []
            for doc, _, piece, _, _ in out:
                known = names[doc]
                ids.append(known[0])
                total.append(known[1])
                known[2] -= len(piece)
                if not known[2]:
                    del names[doc]
            cols = [pa.array(ids, id_type), pa.array([p[1] for p in out], pa.int64()), pa.array([len(p[2]) for p in out], pa.int64()),
                    pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p in out], pa.int64()), pa.array(total, pa.int64()),
                    pa.array([p[3] for p in out], pa.int64()), pa.array([p[4] for p in out], pa.int64())]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                cols.append(pa.array([p[2] for p in out], pa.list_(pa.int32())))
                fields.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(cols, fields)

        seen, id_type = 0, pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for lo, hi, _, _ in chunks(batch.column(1), BATCH_BYTES):
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                for name, code in zip(ids, encode(batch.column(1).slice(lo, hi - lo).to_pylist())):
                    tokens = np.append(code, np.int32(end_id))
                    names[seen] = [name, len(tokens), len(tokens)]
                    packer.add(seen, tokens)
                    seen += 1
                if out:
                    yield rows_out()
        packer.close()
        if out:
            yield rows_out()

    return rows.mapInArrow(run, PIECES.format(id=kind) + (", ids array<int>" if keep_ids else ""))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts, n_pad) of pack(keep_ids=True): the windows as a trainer reads
    them, with each piece's document, and padded to the window unless the length is a power of two.
    A sequence holds at most a window of tokens, so no group is unbounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))
    got = pieces.groupBy("sequence_id").agg(parts.alias("p")).withColumn("flat", F.flatten(F.transform("p", lambda x: x["ids"])))
    n = F.size("flat")
    missing = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(window - n)
    return got.select("sequence_id", F.concat("flat", F.array_repeat(F.lit(pad_id), missing)).alias("ids"),
                      F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["start"]).alias("starts"),
                      missing.cast("int").alias("n_pad"))
