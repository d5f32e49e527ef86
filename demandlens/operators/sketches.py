"""Mergeable distinct counts (A2, A3): one HyperLogLog sketch per (item, year), stored with the cube.

A sketch has a fixed size (about 2 ** lgk bytes at most) and sketches of any groups unite into the
sketch of the whole, so distinct counts per item, per year and over the whole table come from the
stored sketches without reading the log again.  The relative standard error is about
1.04 / sqrt(2 ** lgk); small counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LGK = 12


def relative_error(lgk: int = LGK) -> float:
    """One standard error of an estimate, relative to the count."""
    return 1.04 / 2 ** (lgk / 2)


def sketch_cube(log: DataFrame, value: str, keys: list[str] | None = None, lgk: int = LGK) -> DataFrame:
    """(keys..., sketch, rows): a sketch of ``value`` per key combination, from one partial aggregation; null values
    don't count."""
    keys = keys or ["item", "year"]
    return log.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), F.lit(lgk)).alias("sketch"), F.count(F.lit(1)).alias("rows"))


def unite(cube: DataFrame, keys: list[str]) -> DataFrame:
    """The cube's sketches united over everything but ``keys`` (none: one row)."""
    return cube.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("rows").alias("rows"))


def estimates(cube: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., estimate, rows) of the united sketches."""
    return unite(cube, keys).select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"), "rows")
