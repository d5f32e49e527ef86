"""Suffix-array de-duplication of byte strings by the difference-cover algorithm.

Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id, or the
same document, earlier start) is removed.  The corpus is dealt into shards by content
anchors (see ``regions``), so equal strings always meet in one shard; each shard sorts its
suffixes: triples at positions 1 and 2 modulo 3 are sorted and named, the sequence of names
is sorted by recursion until all names differ, the remaining suffixes are sorted by first symbol
and the rank behind it and merged in, and the prefixes of suffixes that stand next to each other in the array
are compared.  Runs of equal prefixes are the occurrences of one string; all but the first are hits.

Edge cases: a null text is empty (0 bytes, the hash of nothing); texts shorter than ``length`` stay whole;
very long texts are cut into regions like any other; rows that repeat an id and text are one
document and get the same result, rows with one id and different texts are ordered by their hash behind
the id; a null id is below all others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from demandlens.llm import regions

LENGTH = 100
GRAM = 48


def ranked(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense ranks from 1) of tuples of small non-negative integers."""
    bits = [int(c.max(initial=0)).bit_length() for c in cols]
    if sum(bits) <= 63:
        key = np.zeros(len(cols[0]), np.int64)
        for c, b in zip(cols, bits):
            key = (key << b) | c
        order = np.argsort(key)  # equal keys get one rank, so their order doesn't matter
        new = np.append(True, key[order][1:] != key[order][:-1])
    else:
        order = np.lexsort(cols[::-1])
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[order][1:] != c[order][:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (non-negative integers) in sorted order; a suffix that
    ends is smaller than one that goes on."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([np.asarray(s, np.int64) + 1, np.zeros(4, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # with a dummy at n, so that the halves don't run together
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, name = ranked([t[sample], t[sample + 1], t[sample + 2]])
    if len(sample) and name.max() < len(sample):
        order = suffix_array(name)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    zero = np.arange(0, n, 3)
    zero = zero[ranked([t[zero], rank[zero + 1]])[0]]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    before = np.zeros(len(zero), np.int64)  # sampled suffixes below each of zero's
    for rest, cols in ((1, 1), (2, 2)):
        other = sampled[sampled % 3 == rest]
        both = np.concatenate([zero, other])
        key = ranked([t[both + j] for j in range(cols)])[1] * (n + 4) + rank[both + cols]
        before += np.searchsorted(key[len(zero):], key[:len(zero)])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def earlier_windows(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each position of the laid-out regions occurs at a smaller one."""
    hit = np.zeros(len(text), bool)
    window = np.zeros(len(text), bool)
    window[regions.tp.segment_ranges(starts, sizes - length + 1)] = True
    order = suffix_array(text)
    order = order[window[order]]
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    raw = np.concatenate([(text - 1).astype(np.uint8), np.zeros(8, np.uint8)])
    load = np.ndarray((len(text),), np.dtype("<u8"), raw.data, strides=(1,))  # eight bytes from each position
    for j in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        same = same[load[a[same] + j] == load[b[same] + j]]
    equal = np.zeros(len(order), bool)
    equal[same + 1] = True
    run = np.flatnonzero(~equal)
    if len(run):
        first = np.minimum.reduceat(order, run)
        hit[order[order != np.repeat(first, np.diff(np.append(run, len(order))))]] = True
    return hit


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                          batch_symbols: int = regions.BATCH_SYMBOLS, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row; kept (left out without ``keep``): remaining bytes."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    docs = regions.identified(docs, id_col, text_col)

    def finish(s, buf, gone):
        n = np.diff(s.bounds)
        sums = np.concatenate([[0], np.cumsum(gone)])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        edge = s.bounds[:-1][n > 0]
        first[edge] = gone[edge]
        spans = np.concatenate([[0], np.cumsum(first)])
        kept = buf[~gone]
        cut = s.bounds - sums[s.bounds]
        texts = [kept[a:b].tobytes() for a, b in zip(cut, cut[1:])] if keep else []
        count = lambda c: pa.array(c[s.bounds[1:]] - c[s.bounds[:-1]], pa.int64())
        return [pa.array(n, pa.int64()), count(sums), count(spans), pa.array([hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(cut, cut[1:])], pa.string()),
                *([pa.array(texts, pa.binary())] if keep else [])]

    return regions.judged(docs, length, GRAM, False, earlier_windows, finish,
                          "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep, batch_symbols)
