"""Entity resolution (E1): best fuzzy match of each left name among right names.

Score: token-sort ratio = 100 · 2 · LCS(a', b') / (|a'| + |b'|) with a', b'
the white-space tokens sorted and joined by one space (Indel similarity).
With e = 1 − c/100, a pair scoring ≥ c (default 88) has Indel distance
d ≤ e(l1 + l2) and lengths within a factor c/(200 − c), and shares at least
max(l1, l2) − 1 − 2d character bigrams (each insertion breaks one, each
deletion two): t(l) = l(1 − 4e) − 1 for a string of length l and any partner.
So its (l − 1) − t + 1 rarest bigram occurrences (prefix filtering under one
global rarity order) find every pair of strings with t ≥ 1.  Pairs with a
shorter string (every pair when e ≥ 1/4) are found by single characters, of
which they share at least l·c/(200 − c): no cross join, no candidate cap,
nothing missed at any cutoff.  Names that match exactly are taken out first,
by an equi-join on the sorted string.

Candidates are scored by an Arrow-batched pandas UDF (bit-parallel LCS);
the best match per left name is one ``min_by`` aggregation (ties: the
smallest right name).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed value: acceptance threshold of the fuzzy match
FUZZY_CUTOFF = 88.0


def token_sort(c) -> Column:
    """Tokens split on white space, sorted, joined by one space."""
    col = F.col(c) if isinstance(c, str) else c
    toks = F.filter(F.split(col, r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, one pass over b)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if n == 0 else 100.0 * 2 * lcs_length(a, b) / n


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter((indel_ratio(x, y) for x, y in zip(a, b)), dtype=np.float64,
                                 count=len(a)))


def _ratio_udf(a, b) -> Column:
    """Arrow-batched scorer (built at call time: workers import this module without a session)."""
    return F.pandas_udf(_ratios, "double")(a, b)


def _bounds(cutoff: float) -> tuple[float, float, float]:
    """(share of l that shared bigrams have, shortest length indexed by bigrams, length ratio)."""
    slope = 4 * cutoff / 100 - 3
    return slope, (2 / slope if slope > 0 else float("inf")), cutoff / (200 - cutoff)


def _elements(names: DataFrame, size: int) -> DataFrame:
    """(name, s, l, gram, occ): every occurrence of a piece of ``size`` characters."""
    pos = names.select("name", "s", F.length("s").alias("l"),
                       F.explode(F.sequence(F.lit(1), F.length("s") - size + 1)).alias("i"))
    pos = pos.withColumn("gram", F.substring(F.col("s"), F.col("i"), F.lit(size)))
    w = Window.partitionBy("name", "gram").orderBy("i")
    return pos.withColumn("occ", F.row_number().over(w)).drop("i")


def _prefixes(elems: DataFrame, freq: DataFrame, shared: Column, size: int) -> DataFrame:
    """Keep each name's rarest occurrences, all but ``shared`` − 1."""
    e = elems.join(freq, ["gram", "occ"])
    keep = (F.col("l") - size + 1) - F.greatest(F.lit(1), shared) + 1
    w = Window.partitionBy("name").orderBy("df", "gram", "occ")
    return (e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
            .select("name", "s", "l", "gram", "occ"))


def _sharing(left: DataFrame, right: DataFrame, size: int, shared: Column, ratio: float) -> DataFrame:
    """Pairs that share a kept piece and whose lengths fit."""
    le, re_ = _elements(left, size), _elements(right, size)
    freq = (le.select("gram", "occ").unionByName(re_.select("gram", "occ"))
            .groupBy("gram", "occ").agg(F.count(F.lit(1)).alias("df")))
    lp, rp = _prefixes(le, freq, shared, size), _prefixes(re_, freq, shared, size)
    fits = F.least("ll", "rl") >= F.greatest("ll", "rl") * F.lit(ratio) - 1e-9
    return (lp.select(F.col("name").alias("lname"), F.col("s").alias("ls"), F.col("l").alias("ll"), "gram", "occ")
            .join(rp.select(F.col("name").alias("rname"), F.col("s").alias("rs"), F.col("l").alias("rl"), "gram", "occ"),
                  ["gram", "occ"])
            .where(fits).select("lname", "ls", "rname", "rs"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Candidate pairs (lname, ls, rname, rs) that can score ``cutoff`` or more."""
    slope, shortest, ratio = _bounds(cutoff)
    n = F.length("s")
    chars = F.ceil(F.col("l") * ratio - 1e-9)
    short = n <= (shortest / ratio if shortest != float("inf") else 1 << 30)
    out = _sharing(left.where(short & (n > 0)), right.where(short & (n > 0)), 1, chars, ratio)
    if slope > 0:
        grams = F.ceil(F.col("l") * slope - 1 - 1e-9)
        long_ = n >= shortest
        out = out.unionByName(_sharing(left.where(long_), right.where(long_), 2, grams, ratio))
    return out.distinct()


def best_matches(left_names: DataFrame, right_names: DataFrame, col: str = "item",
                 cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """(item, match, score) for every distinct left name with a match ≥ ``cutoff``."""
    def prep(df):
        return (df.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct()
                .withColumn("s", token_sort("name")))
    left, right = prep(left_names), prep(right_names)
    exact = (left.join(right.select(F.col("name").alias("rname"), F.col("s").alias("rs")), F.col("s") == F.col("rs"))
             .select(F.col("name").alias("lname"), "rname", F.lit(100.0).alias("score")))
    open_ = left.join(right.select("s"), "s", "left_anti").select("name", "s")
    cand = fuzzy_candidates(open_, right, cutoff)
    scored = cand.withColumn("score", _ratio_udf("ls", "rs")).where(F.col("score") >= cutoff)
    best = scored.select("lname", "rname", "score").unionByName(exact).groupBy("lname").agg(
        F.min_by(F.struct("rname", "score"), F.struct(-F.col("score"), F.col("rname"))).alias("b"))
    return best.select(F.col("lname").alias(col), F.col("b.rname").alias("match"),
                       F.col("b.score").alias("score"))


def apply_matches(df: DataFrame, matches: DataFrame, col: str = "item") -> DataFrame:
    """Replace each name by its match; names without a match stay as they are."""
    m = matches.select(F.col(col).alias("_k"), F.col("match").alias("_m"))
    return (df.join(m, df[col] == m["_k"], "left")
            .withColumn(col, F.coalesce("_m", F.col(col))).drop("_k", "_m"))
