"""Shared helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.sources import tables

FOCAL = tables.FOCAL_PROVIDER


def r6(c: str | Column, name: str | None = None) -> Column:
    """Round a floating result to 6 digits (both engines do the same)."""
    col = F.col(c) if isinstance(c, str) else c
    col = F.round(col.cast("double"), 6)
    return col.alias(name or (c if isinstance(c, str) else "value"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.demand_log(spark, sf_dir)


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.coverage_catalogue(spark, sf_dir)


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demand cube written once to the checkpoint folder (for queries that read it
    in several branches: each branch then scans a small table, not the joined log)."""
    from demandlens.operators.features import demand_cube
    from demandlens.session import materialize

    return materialize(demand_cube(demand(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from demandlens.operators.features import feature_table

    return feature_table(demand(spark, sf_dir), coverage(spark, sf_dir), FOCAL)


FEATURE_COLS = [
    ("item", "string"), ("freq", "bigint"), ("n_years", "bigint"), ("trend_slope", "r6"),
    ("velocity", "r6"), ("recency_weight", "r6"), ("volatility", "r6"),
    ("threshold_year", "int"), ("company_spread", "bigint"), ("upcoming_flag", "int"),
    ("company_spread_norm", "double"), ("trajectory", "string"), ("transition", "string"),
    ("taught_count", "bigint"), ("is_covered", "int"), ("provider_gap", "double"),
    ("in_transition", "int"),
]


def typed(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, t in cols:
        if t == "r6":
            out.append(r6(name))
        else:
            out.append(F.col(name).cast(t).alias(name))
    return df.select(*out)


def sql_typed(cols: list[tuple[str, str]], src: str = "") -> str:
    m = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
    parts = []
    for name, t in cols:
        ref = f"{src}{name}"
        if t == "r6":
            parts.append(f"round(CAST({ref} AS DOUBLE), 6) AS {name}")
        else:
            parts.append(f"CAST({ref} AS {m[t]}) AS {name}")
    return ", ".join(parts)
