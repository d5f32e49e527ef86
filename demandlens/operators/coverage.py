"""Coverage of demanded items by providers.

Inputs: a demand log with an ``item`` column and a coverage catalogue with
``provider`` and ``item``.  Provider counts are scalar subqueries, so the
plan has no cross join and nothing is collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_items(df: DataFrame, col: str = "item") -> DataFrame:
    return df.select(F.col(col).alias("item")).where(F.col("item").isNotNull()).distinct()


def covered_items(demand: DataFrame, coverage: DataFrame) -> DataFrame:
    """Items both demanded and covered."""
    return distinct_items(demand).join(distinct_items(coverage), "item", "left_semi")


def gap_items(demand: DataFrame, coverage: DataFrame) -> DataFrame:
    """Demanded items that no provider covers."""
    return distinct_items(demand).join(distinct_items(coverage), "item", "left_anti")


def extra_items(demand: DataFrame, coverage: DataFrame) -> DataFrame:
    """D3: covered items nobody demands."""
    return distinct_items(coverage).join(distinct_items(demand), "item", "left_anti")


def coverage_summary(demand: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row with demanded / covered / overlap / gap / extra counts and gap %.

    One full outer join of the two distinct item sets; counts are conditional.
    """
    d = distinct_items(demand).withColumn("in_d", F.lit(True))
    c = distinct_items(coverage).withColumn("in_c", F.lit(True))
    j = d.join(c, "item", "full_outer")
    out = j.agg(
        F.count_if(F.col("in_d")).alias("demand_items"),
        F.count_if(F.col("in_c")).alias("coverage_items"),
        F.count_if(F.col("in_d") & F.col("in_c")).alias("overlap_items"),
        F.count_if(F.col("in_d") & F.col("in_c").isNull()).alias("gap_items"),
        F.count_if(F.col("in_c") & F.col("in_d").isNull()).alias("extra_items"),
    )
    return out.withColumn(
        "gap_pct",
        F.when(F.col("demand_items") > 0,
               F.round(F.col("gap_items") * 100.0 / F.col("demand_items"), 1)))


def provider_count(coverage: DataFrame):
    """A3: number of distinct providers, as a scalar-subquery column."""
    return coverage.select(F.count_distinct("provider")).scalar()


def item_coverage(coverage: DataFrame, focal: str) -> DataFrame:
    """A2 + J3 per covered item: providers covering it and whether the focal one does.

    One aggregation over the catalogue: (item, taught_count, is_covered_focal).
    """
    return (coverage.where(F.col("item").isNotNull())
            .groupBy("item")
            .agg(F.count_distinct("provider").alias("taught_count"),
                 F.max((F.col("provider") == F.lit(focal)).cast("int")).alias("is_covered")))


def coverage_flags(items: DataFrame, coverage: DataFrame, focal: str,
                   gap_default: float = 1.0, digits: int | None = 3) -> DataFrame:
    """Add taught_count, is_covered and provider_gap to an item table.

    provider_gap = (P - taught_count) / P with P = distinct providers in the
    catalogue; items absent from the catalogue get taught_count 0,
    is_covered 0 and provider_gap ``gap_default``.
    """
    cov = item_coverage(coverage, focal)
    p = provider_count(coverage)
    gap = (p - F.col("taught_count")) / p
    if digits is not None:
        gap = F.round(gap, digits)
    j = items.join(cov, "item", "left")
    return (j.withColumn("provider_gap",
                         F.when(F.col("taught_count").isNull(), F.lit(gap_default)).otherwise(gap))
             .withColumn("taught_count", F.coalesce("taught_count", F.lit(0)).cast("long"))
             .withColumn("is_covered", F.coalesce("is_covered", F.lit(0)).cast("int")))


def provider_item_counts(coverage: DataFrame) -> DataFrame:
    """A2: distinct items per provider."""
    return coverage.groupBy("provider").agg(F.count_distinct("item").alias("n_items"))
