"""Substring de-duplication of word sequences by a compressed FM-index per shard.

Every word covered by a window of ``length`` words whose sequence also starts earlier (smaller
id, or the same document, earlier start) is removed.  The corpus is dealt into shards by
content anchors (see ``regions``), so equal windows always meet in one shard.  A shard's index is a
wavelet tree over the Burrows-Wheeler transform of its text, whose 64-bit words are kept once each, and the
lengths of the common prefixes of neighbouring suffixes, cut at ``length`` (a byte each); neither the text nor the suffix
array is part of it.

The regions of the shard are then streamed against the index, each from its last word to its first in one pass
that carries the matching statistic (the length of the longest string that starts here and occurs twice in
the shard) and its interval.  A word that extends the match narrows the interval by a backward step; one that
doesn't shortens the match to the interval's parent and is tried again.  At ``length`` words the interval
is reported and the match loses its last word.  All windows of a shard are streamed, so the first occurrence of a
sequence is the smallest start reported with its interval: nothing has to be located.

Edge cases: a null text has no words; texts shorter than a window stay whole; very long texts
are cut into regions like any other; rows that repeat an id and text are one document and get
the same result, rows with one id and different texts are ordered by their hash behind the id; a null id is
below all others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandlens.llm import regions
from demandlens.llm.suffix_dedup import suffix_array

LENGTH = 20
GRAM = 10


class Bits:
    """A bit vector with constant-time counts of ones before a position.  Its words of 64 bits are kept
    once each: the runs of a Burrows-Wheeler transform make many of them equal."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view("<u8")
        self.words, slot = np.unique(words, return_inverse=True)
        self.slot = slot.astype(np.min_scalar_type(len(self.words)))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
        self.before = self.before.astype(np.min_scalar_type(len(padded)))

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.slot.nbytes + self.before.nbytes

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.words[self.slot[block]] & mask)


class WaveletTree:
    """Counts of a symbol before a position, level by level from the highest bit; the nodes of a
    level lie one after another, ordered by the bits read so far from the lowest (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray):
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int((~bit).sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.ones(at)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + ones, at - ones)
        return at


class Lows:
    """The nearest value below a bound, on either side of a position: least values of aligned blocks of
    1, 2, 4, ... entries, climbed and descended for all positions at once.  The first and the last
    value must be 0."""

    def __init__(self, values: np.ndarray):
        levels = [values]
        while len(levels[-1]) > 1:
            x = levels[-1]
            if len(x) % 2:
                levels[-1] = x = np.append(x, np.iinfo(x.dtype).max)
            levels.append(np.minimum(x[::2], x[1::2]))
        self.flat = np.concatenate(levels)
        self.level = np.cumsum([0, *map(len, levels[:-1])])

    def nearest(self, at: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        """The nearest position from each of ``at`` on, to the right (step 1) or to the left (-1), whose value is
        below ``bound`` (at least 1)."""
        high = np.zeros(len(at), np.int64)
        block = at.copy()
        go = np.flatnonzero(self.flat[block] >= bound)
        while len(go):
            to = block[go] + step
            up = to & 1 == (step < 0)  # past its parent: on in the parent's neighbour
            block[go], high[go] = to >> up, high[go] + up
            go = go[self.flat[self.level[high[go]] + block[go]] >= bound[go]]
        go = np.flatnonzero(high)
        while len(go):
            high[go] -= 1
            near = 2 * block[go] + (step < 0)
            block[go] = near + step * (self.flat[self.level[high[go]] + near] >= bound[go])
            go = go[high[go] > 0]
        return block


class FMIndex:
    def __init__(self, text: np.ndarray, length: int):
        self.n, self.length = len(text), length
        suffixes = suffix_array(text)
        self.tree = WaveletTree(text[suffixes - 1])
        symbols = np.arange(int(text.max(initial=0)) + 1)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols)))[:-1]])
        self.shift = smaller - self.tree.walk(symbols, np.zeros(len(symbols), np.int64))
        # common prefix of a suffix and the one before it; 0 at both ends
        ended = np.append(text, np.full(length, -1))
        common = np.zeros(self.n + 1, np.min_scalar_type(length + 1))
        same = np.arange(1, self.n)
        for j in range(length):
            same = same[ended[suffixes[same] + j] == ended[suffixes[same - 1] + j]]
            common[same] = j + 1
        self.common, self.lows = common, Lows(common)

    def parent(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``size`` (at least 1) symbols of what [lo, hi) have in common."""
        return self.lows.nearest(lo, size, -1), self.lows.nearest(hi, size, 1)

    def statistics(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, lo) of every window of ``length`` symbols in these stretches of the indexed text that occurs
        more than once; lo is where the interval of its suffixes begins, so equal windows share it."""
        stop, at = starts, starts + sizes
        lo, hi, size = np.zeros(len(at), np.int64), np.full(len(at), self.n), np.zeros(len(at), np.int64)
        found = []
        while True:
            # a stretch ends where no window that is left can still lie inside the match
            go = at + size - self.length >= stop
            stop, at, lo, hi, size = (x[go] for x in (stop, at, lo, hi, size))
            if not len(at):
                break
            c = text[at - 1]
            a, b = (self.shift[c] + self.tree.walk(c, x) for x in (lo, hi))
            more = b - a > 1
            lo, hi = np.where(more, a, lo), np.where(more, b, hi)
            at, size = at - more, size + more
            full = np.flatnonzero(size == self.length)
            if len(full):
                found.append((at[full], lo[full]))
                size[full] -= 1
                lo[full], hi[full] = self.parent(lo[full], hi[full], size[full])
            at = at - (~more & (size == 0))  # the symbol occurs once
            less = np.flatnonzero(~more & (size > 0))
            if len(less):
                size[less] = np.maximum(self.common[lo[less]], self.common[hi[less]])
                none, some = less[size[less] == 0], less[size[less] > 0]
                lo[none], hi[none] = 0, self.n
                lo[some], hi[some] = self.parent(lo[some], hi[some], size[some])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))


def earlier_windows(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each position of the laid-out regions occurs at a smaller one."""
    hit = np.zeros(len(text), bool)
    at, lo = FMIndex(text, length).statistics(text, starts, sizes)
    if len(at):
        order = np.lexsort((at, lo))
        hit[at[order[1:][lo[order][1:] == lo[order][:-1]]]] = True
    return hit


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                          batch_symbols: int = regions.BATCH_SYMBOLS, keep: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row; kept (left out without ``keep``): remaining words joined by a space."""
    if length < GRAM + 1:
        raise ValueError(f"length must be at least {GRAM + 1}")
    docs = regions.identified(docs, id_col, text_col)

    def finish(s, buf, gone):
        kept = ~gone
        row = s.words.row[kept]
        start, size = s.words.start[kept], (s.words.end - s.words.start)[kept]
        # kept words with a space behind each; the row's last space is cut off
        width = size + 1
        place = np.cumsum(width) - width
        flat = np.full(int(width.sum()), 32, np.uint8)
        flat[regions.tp.segment_ranges(place, size)] = buf[regions.tp.segment_ranges(start, size)]
        bounds = np.append(place, len(flat))[np.searchsorted(row, np.arange(len(s.bounds)))]
        cut = [slice(a, max(a, b - 1)) for a, b in zip(bounds, bounds[1:])]
        n = np.diff(s.bounds)
        sums = np.concatenate([[0], np.cumsum(gone)])
        return [pa.array(n, pa.int64()), pa.array(sums[s.bounds[1:]] - sums[s.bounds[:-1]], pa.int64()),
                pa.array([hashlib.sha256(flat[x]).hexdigest() for x in cut], pa.string()),
                *([pa.array([flat[x].tobytes().decode() for x in cut], pa.string())] if keep else [])]

    return regions.judged(docs, length, GRAM, True, earlier_windows, finish,
                          "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep, batch_symbols)


def oracle(table: str = "documents", length: int = LENGTH) -> str:
    """DuckDB SQL for the digests of remove_repeated_words() (ids are unique)."""
    window = " || ' ' || ".join(["x", *(f"lead(x, {i}) OVER v" for i in range(1, length))])
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
b AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS p FROM d),
s AS (SELECT doc_id, p, {window} AS s FROM b WINDOW v AS (PARTITION BY doc_id ORDER BY p) QUALIFY lead(x, {length - 1}) OVER v IS NOT NULL),
f AS (SELECT s, min((doc_id, p)) AS first FROM s GROUP BY s),
hit AS (SELECT s.doc_id, s.p FROM s JOIN f USING (s) WHERE (s.doc_id, s.p) > f.first),
m AS (SELECT b.doc_id, b.p, b.x,
             coalesce(max((hit.p IS NOT NULL)::INT) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW), 0) AS gone
      FROM b LEFT JOIN hit ON hit.doc_id = b.doc_id AND hit.p = b.p),
g AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""
