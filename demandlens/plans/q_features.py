"""Registered queries: coverage sets, per-item features, time series (steps 1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import coverage as cov
from demandlens.operators import features as fe
from demandlens.plans import sqlbase as S
from demandlens.plans.common import FEATURE_COLS, FOCAL, coverage, demand, features, r6  # noqa: F401
from demandlens.plans.common import cube as cube_of
from demandlens.plans.common import sql_typed, typed
from demandlens.plans.q_text import NORMALISED, coverage_normalised
from demandlens.plans.registry import ORACLE, register
from demandlens.session import materialize
from demandlens.sources import tables

# --- step 1: minimum slice -------------------------------------------------

GAP_TOP_COLS = [("item", "string"), ("freq", "bigint"), ("trend_slope", "r6"),
                ("company_spread", "bigint"), ("provider_gap", "double")]


@register("gap_demand_top", S.with_(S.FEATURES[1:]) + f"""
SELECT {sql_typed(GAP_TOP_COLS)} FROM features WHERE is_covered = 0
ORDER BY freq DESC, item LIMIT 25""")
def gap_demand_top(spark, sf):
    """Top 25 items the focal provider does not cover, by demand (K8 top-k report)."""
    f = features(spark, sf).where(F.col("is_covered") == 0)
    return typed(f.orderBy(F.desc("freq"), "item").limit(25), GAP_TOP_COLS)


@register("item_features", S.with_(S.FEATURES[1:]) + f"""
SELECT {sql_typed(FEATURE_COLS)} FROM features""")
def item_features(spark, sf):
    """The whole per-item feature table."""
    return typed(features(spark, sf), FEATURE_COLS)


@register("yearly_counts", S.with_(S.DEMAND[1:]) + """
SELECT item, CAST(year AS INTEGER) AS year, count(*) AS cnt FROM demand GROUP BY item, year""")
def yearly_counts(spark, sf):
    """Demand rows per (item, year)."""
    y = fe.yearly_counts(fe.demand_cube(demand(spark, sf)))
    return y.select("item", F.col("year").cast("int"), F.col("cnt").cast("bigint"))


# --- coverage sets (D1-D4, A2) ---------------------------------------------

_SETS = S.with_(S.DEMAND[1:], S.COVERAGE)


@register("covered_items", _SETS + """
SELECT DISTINCT item FROM demand WHERE item IN (SELECT item FROM coverage)""")
def covered_items(spark, sf):
    return cov.covered_items(tables.demand_items(spark, sf), coverage(spark, sf))


@register("gap_items", _SETS + """
SELECT DISTINCT item FROM demand WHERE item NOT IN (SELECT item FROM coverage)""")
def gap_items(spark, sf):
    return cov.gap_items(tables.demand_items(spark, sf), coverage(spark, sf))


@register("extra_items", S.with_(S.ITEMS[1:], NORMALISED) + """
SELECT DISTINCT item FROM normalised WHERE item NOT IN (SELECT item FROM items)""")
def extra_items(spark, sf):
    """D3: normalised coverage names that nobody demands."""
    return cov.extra_items(tables.demand_items(spark, sf), coverage_normalised(spark, sf))


@register("coverage_summary", _SETS + """,
d AS (SELECT DISTINCT item FROM demand), c AS (SELECT DISTINCT item FROM coverage)
SELECT (SELECT count(*) FROM d) AS demand_items,
       (SELECT count(*) FROM c) AS coverage_items,
       (SELECT count(*) FROM d WHERE item IN (SELECT item FROM c)) AS overlap_items,
       (SELECT count(*) FROM d WHERE item NOT IN (SELECT item FROM c)) AS gap_items,
       (SELECT count(*) FROM c WHERE item NOT IN (SELECT item FROM d)) AS extra_items,
       round((SELECT count(*) FROM d WHERE item NOT IN (SELECT item FROM c)) * 100.0
             / (SELECT count(*) FROM d), 1)::DOUBLE AS gap_pct""")
def coverage_summary(spark, sf):
    return cov.coverage_summary(tables.demand_items(spark, sf), coverage(spark, sf))


@register("coverage_summary_all_semesters", ORACLE["coverage_summary"].replace("FROM part WHERE p_size <= 12", "FROM part"))
def coverage_summary_all_semesters(spark, sf):
    """D1-D4 over the whole catalogue, without the bound on the semester."""
    return cov.coverage_summary(tables.demand_items(spark, sf), tables.coverage_catalogue(spark, sf, max_semester=None))


@register("provider_item_counts", S.with_(S.COVERAGE[1:]) + """
SELECT provider, count(DISTINCT item) AS n_items FROM coverage GROUP BY provider""")
def provider_item_counts(spark, sf):
    return cov.provider_item_counts(coverage(spark, sf))


@register("focal_gap_summary", S.with_(S.FEATURES[1:]) + """
SELECT count(*) AS n_items, CAST(sum(CASE WHEN is_covered = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps,
       round(sum(CASE WHEN is_covered = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 1)::DOUBLE AS gap_pct
FROM features""")
def focal_gap_summary(spark, sf):
    """Items demanded, items missing at the focal provider, gap % (NB01 summary)."""
    f = features(spark, sf)
    return f.agg(F.count(F.lit(1)).alias("n_items"),
                 F.count_if(F.col("is_covered") == 0).alias("n_gaps")).withColumn(
        "gap_pct", F.round(F.col("n_gaps") * 100.0 / F.col("n_items"), 1))


# --- time series (T8, T9), modes (A7, K10), value counts (A10) ---------------

@register("type_transitions", S.with_(S.FEATURES[1:]) + """
SELECT item, transition, CAST(threshold_year AS INTEGER) AS threshold_year
FROM features WHERE transition IS NOT NULL""")
def type_transitions(spark, sf):
    cube = cube_of(spark, sf)
    tr = fe.type_transitions(cube).where(F.col("transition").isNotNull())
    th = fe.item_trends(cube).select("item", F.col("threshold_year").cast("int"))
    return tr.join(th, "item", "left")


@register("transition_counts", S.with_(S.FEATURES[1:]) + """
SELECT transition, count(*) AS n_items FROM features WHERE transition IS NOT NULL GROUP BY transition""")
def transition_counts(spark, sf):
    return fe.transition_counts(fe.type_transitions(fe.demand_cube(demand(spark, sf))))


@register("trajectory_counts", S.with_(S.FEATURES[1:]) + """
SELECT trajectory, count(*) AS n_items FROM features GROUP BY trajectory""")
def trajectory_counts(spark, sf):
    t = fe.trajectory(fe.demand_cube(demand(spark, sf)))
    return t.groupBy("trajectory").agg(F.count(F.lit(1)).alias("n_items"))


@register("yearly_type_mode", S.with_(S.DEMAND[1:]) + """
SELECT item, CAST(year AS INTEGER) AS year, item_type AS year_type FROM (
  SELECT item, year, item_type,
         row_number() OVER (PARTITION BY item, year ORDER BY count(*) DESC, item_type) AS rn
  FROM demand GROUP BY item, year, item_type) WHERE rn = 1""")
def yearly_type_mode(spark, sf):
    """A7 per (item, year): the most frequent type, smallest on ties."""
    return fe.weighted_mode(fe.demand_cube(demand(spark, sf)), ["item", "year"], "item_type",
                            out="year_type").select("item", F.col("year").cast("int"), "year_type")


@register("threshold_years", S.with_(S.FEATURES[1:]) + """
SELECT CAST(threshold_year AS INTEGER) AS threshold_year, count(*) AS n_items
FROM features GROUP BY threshold_year""")
def threshold_years(spark, sf):
    """Distribution of threshold years."""
    t = fe.item_trends(cube_of(spark, sf))
    return t.groupBy(F.col("threshold_year").cast("int").alias("threshold_year")).agg(
        F.count(F.lit(1)).alias("n_items"))


@register("trend_by_trajectory", S.with_(S.FEATURES[1:]) + """
SELECT trajectory, round(avg(freq), 3)::DOUBLE AS freq, round(avg(trend_slope), 3)::DOUBLE AS trend_slope,
       round(avg(velocity), 3)::DOUBLE AS velocity, round(avg(volatility), 3)::DOUBLE AS volatility
FROM features GROUP BY trajectory""")
def trend_by_trajectory(spark, sf):
    """Mean features per trajectory, rounded to 3 digits."""
    f = features(spark, sf)
    return f.groupBy("trajectory").agg(*[F.round(F.avg(c), 3).alias(c) for c in
                                         ("freq", "trend_slope", "velocity", "volatility")])


CHANGE_POINTS = S.FEATURES + """,
cp_n AS (SELECT lo, hi - lo + 1 AS n FROM bounds),
cp_y AS (SELECT item, year - (SELECT lo FROM bounds) AS t, CAST(cnt AS DOUBLE) AS y FROM grid),
cp_p AS (SELECT x.item, x.t AS i, z.t AS j, (x.y - z.y) * (x.y - z.y) AS d FROM cp_y x JOIN cp_y z ON x.item = z.item),
cp_w AS (SELECT item, median(d) AS w FROM cp_p WHERE i < j GROUP BY item),
cp_g AS (SELECT item, i, j, exp(-d / CASE WHEN w > 0 THEN w ELSE 1.0 END) AS g FROM cp_p LEFT JOIN cp_w USING (item)),
cp_s AS (SELECT a.range AS a, b.range AS b FROM range(0, (SELECT n FROM cp_n)) a, range(1, (SELECT n + 1 FROM cp_n)) b WHERE b.range - a.range >= 2),
cp_c AS (SELECT g.item, s.a, s.b, round((s.b - s.a) - sum(g.g) / (s.b - s.a), 9) AS cost
         FROM cp_s s JOIN cp_g g ON g.i >= s.a AND g.i < s.b AND g.j >= s.a AND g.j < s.b GROUP BY g.item, s.a, s.b),
cp_path AS (
  SELECT item, b AS t, round(cost + 1.0, 9) AS v, b AS first, [0] AS starts FROM cp_c WHERE a = 0
  UNION ALL
  SELECT p.item, c.b, round(p.v + c.cost + 1.0, 9), p.first, list_prepend(c.a, p.starts) FROM cp_path p JOIN cp_c c ON c.item = p.item AND c.a = p.t),
cp_best AS (SELECT item, first FROM (
  SELECT item, first, row_number() OVER (PARTITION BY item ORDER BY v, starts) AS r
  FROM cp_path WHERE t = (SELECT n FROM cp_n)) WHERE r = 1)"""


@register("change_point_years", S.with_(CHANGE_POINTS[1:]).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT f.item, CAST(CASE WHEN b.first < (SELECT n FROM cp_n) THEN (SELECT lo FROM cp_n) + b.first - 1
                         ELSE coalesce(f.threshold_year, (SELECT lo FROM cp_n)) END AS INTEGER) AS change_year
FROM features f LEFT JOIN cp_best b USING (item)""")
def change_point_years(spark, sf):
    """T7 (opt-in): change-point year per item (RBF cost, penalty 1, min size 2, jump 1), T6 fallback.  The SQL
    twin tries every partition of the years."""
    cube = cube_of(spark, sf)
    b = cube.agg(F.min("year").alias("lo"), F.max("year").alias("hi")).first()  # two numbers
    return fe.change_point_years(cube, int(b["lo"]), int(b["hi"]))


@register("one_hot_matrix", S.with_(S.FEATURES[1:]) + """,
one AS (SELECT item, freq, trajectory, coalesce(transition, '__unknown') AS transition FROM features),
slots AS (SELECT 'trajectory_' || t AS feature, 'trajectory' AS col, t AS v FROM (SELECT DISTINCT trajectory AS t FROM one)
          UNION ALL SELECT 'transition_' || t, 'transition', t FROM (SELECT DISTINCT transition AS t FROM one UNION SELECT '__unknown')
          UNION ALL SELECT 'trajectory___unknown', 'trajectory', '__unknown')
SELECT item, feature, CAST(CASE WHEN col = 'trajectory' THEN trajectory = v ELSE transition = v END AS DOUBLE) AS value FROM one, slots
UNION ALL SELECT item, 'freq', CAST(freq AS DOUBLE) FROM one""")
def one_hot_matrix(spark, sf):
    """The model matrix of frequency, trajectory and transition (null for stable items: unknown), one row per slot."""
    from pyspark.ml.functions import vector_to_array

    f = materialize(features(spark, sf).select("item", "freq", "trajectory", "transition"))
    vectors, names = fe.feature_vectors(f, ["freq"], ["trajectory", "transition"])
    name = F.array(*[F.lit(n) for n in names])
    return vectors.select("item", F.posexplode(vector_to_array("features")).alias("at", "value")).select(
        "item", F.get(name, F.col("at")).alias("feature"), "value")
