"""Registered queries: table profiles (A11, A14, A15, D6-D8) over the item table and raw logs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.plans import sqlbase as S
from demandlens.plans.common import coverage, demand, features, r6
from demandlens.plans.registry import register
from demandlens.operators.extract import _first_by
from demandlens.operators.order import quantiles
from demandlens.session import materialize

CORR_COLS = ["freq", "trend_slope", "recency_weight", "velocity", "volatility", "company_spread"]


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form (one aggregation).

    From covariance and deviations, as ``corr`` divides by zero in ANSI mode: NaN where one of the two columns
    is constant over the rows that have both, null where no row has both."""
    pairs = list(combinations(cols, 2))

    def pearson(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return F.when(F.count(x) > 0, F.coalesce(r, F.lit(float("nan"))))

    row = df.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    stacked = ", ".join(f"'{a}', '{b}', `{a}|{b}`" for a, b in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stacked}) AS (col_a, col_b, corr)")


@register("feature_correlations", S.with_(S.FEATURES[1:]) + " " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
    f"FROM features" for a, b in combinations(CORR_COLS, 2)))
def feature_correlations(spark, sf):
    """Pairwise Pearson correlations of the numeric item features."""
    c = correlations(features(spark, sf), CORR_COLS)
    return c.select("col_a", "col_b", r6("corr"))


DESCRIBE_COLS = ["freq", "trend_slope", "velocity", "volatility"]


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max per column.

    ``df`` is read twice (moments, then quantiles over range partitions): pass a written table."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
    row = df.agg(*aggs)
    stacked = ", ".join(f"'{c}', CAST(`{c}|count` AS BIGINT), `{c}|mean`, `{c}|std`, `{c}|min`, `{c}|max`" for c in cols)
    moments = row.selectExpr(f"stack({len(cols)}, {stacked}) AS (col, count, mean, std, min, max)")
    at = quantiles(df.select(*cols), {c: [0.25, 0.5, 0.75] for c in cols})
    of = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return (moments.join(at.groupBy("col").agg(of(0.25).alias("p25"), of(0.5).alias("p50"), of(0.75).alias("p75")), "col", "left")
            .select("col", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


@register("feature_describe", S.with_(S.FEATURES[1:]) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"round(min(CAST({c} AS DOUBLE)), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, "
    f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, "
    f"round(max(CAST({c} AS DOUBLE)), 6) AS max FROM features" for c in DESCRIBE_COLS))
def feature_describe(spark, sf):
    """describe() of the main item features."""
    d = describe(materialize(features(spark, sf).select(*DESCRIBE_COLS)), DESCRIBE_COLS)
    return d.select("col", "count", *[r6(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, long form (one aggregation)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return row.selectExpr(f"stack({len(df.columns)}, {stacked}) AS (col, n_null)")


@register("feature_nulls", S.with_(S.FEATURES[1:]) + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM features"
    for c in ("item", "freq", "trend_slope", "velocity", "volatility", "threshold_year", "trajectory",
              "transition", "taught_count", "provider_gap")))
def feature_nulls(spark, sf):
    """Null count of the item-table columns (transition is null when stable)."""
    f = features(spark, sf).select("item", "freq", "trend_slope", "velocity", "volatility", "threshold_year",
                                   "trajectory", "transition", "taught_count", "provider_gap")
    return null_counts(f)


@register("demand_duplicates", S.with_(S.DEMAND[1:]) + """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (
         SELECT DISTINCT company, year, role, item, item_type FROM demand)) AS n_duplicates FROM demand""")
def demand_duplicates(spark, sf):
    """D8 (+D6): rows of the demand log and how many repeat an earlier (company, year, role, item, type)."""
    d = demand(spark, sf).select("company", "year", "role", "item", "item_type")
    distinct = d.distinct().select(F.count(F.lit(1))).scalar()
    return d.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.col("n_rows") - distinct).alias("n_duplicates"))


@register("coverage_first_rows", S.with_(S.COVERAGE[1:]) + """
SELECT course, item, provider, CAST(semester AS INTEGER) AS semester FROM (
  SELECT *, row_number() OVER (PARTITION BY course, item ORDER BY semester, provider) AS r FROM coverage)
WHERE r = 1""")
def coverage_first_rows(spark, sf):
    """D7 + M5: one coverage row per (course, item), the first by semester then provider."""
    c = coverage(spark, sf).select("course", "item", "provider", F.col("semester").cast("int"))
    return _first_by(c.where(F.length("item") > 1), ["course", "item"], "semester")
