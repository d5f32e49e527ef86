"""Whole-table scalings (P16, P17) without cross joins or unpartitioned windows.

The statistics of all columns are one aggregate row, exposed as a single
struct-valued scalar subquery; every reference to it is the same subquery,
which Spark evaluates once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_stats(df: DataFrame, cols: list[str], kinds=("min", "max")) -> Column:
    """A struct scalar with ``{kind}_{col}`` fields computed over the whole table."""
    fns = {"min": F.min, "max": F.max, "avg": F.avg, "median": F.median}
    fields = [fns[k](c).alias(f"{k}_{c}") for c in cols for k in kinds]
    return df.select(F.struct(*fields).alias("s")).scalar()


def min_max_scale(df: DataFrame, cols: list[str], suffix: str = "_norm",
                  stats: Column | None = None) -> DataFrame:
    """(x - min) / (max - min) over the whole table; a constant column maps to 0.

    ``stats`` may carry precomputed ``min_{c}``/``max_{c}`` fields (see
    ``table_stats``) so that several scalings share one statistics pass.
    """
    s = stats if stats is not None else table_stats(df, cols)
    out = df
    for c in cols:
        lo, hi = s[f"min_{c}"], s[f"max_{c}"]
        out = out.withColumn(c + suffix, F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    return out


def max_scaled_inverse(df: DataFrame, col: str, out: str, digits: int | None = 4,
                       stats: Column | None = None) -> DataFrame:
    """1 - x / max(x) over the whole table."""
    s = stats if stats is not None else table_stats(df, [col], kinds=("max",))
    v = F.lit(1.0) - F.col(col) / s[f"max_{col}"]
    return df.withColumn(out, F.round(v, digits) if digits is not None else v)
