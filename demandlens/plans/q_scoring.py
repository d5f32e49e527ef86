"""Registered queries: labels, co-occurrence, lag, watch list, priority, debt (step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import cooccur as co
from demandlens.operators import scoring as sc
from demandlens.plans import analytics as an
from demandlens.plans import sqlbase as S
from demandlens.plans.common import FOCAL, coverage, demand, features, r6, sql_typed, typed
from demandlens.plans.registry import register
from demandlens.operators.order import quantile
from demandlens.session import materialize
from demandlens.sources import tables

SCORED = S.FEATURES + """,
ds AS (
  SELECT f.*, round(CAST(freq AS DOUBLE) * 0.25 + trend_slope * 0.20 + recency_weight * 0.20
                    + velocity * 0.15 + company_spread_norm * 0.20, 4) AS demand_score
  FROM features f),
lab AS (
  SELECT ds.*, CASE WHEN demand_score > (SELECT quantile_cont(demand_score, 0.65) FROM ds)
                     AND is_covered = 0 THEN 1 ELSE 0 END AS label,
         demand_score AS gap_prob
  FROM ds),
lagged AS (
  SELECT lab.*,
         CAST(CASE WHEN is_covered = 0 THEN (SELECT hi FROM bounds) - coalesce(threshold_year, (SELECT lo FROM bounds))
              ELSE 0 END AS INTEGER) AS lag
  FROM lab),
watched AS (
  SELECT lagged.*,
         CASE WHEN (upcoming_flag = 1 OR trajectory = 'R') AND velocity >= 0
                   AND round(volatility, 9) < (SELECT median(round(volatility, 9)) FROM lagged)
                   AND is_covered = 0 THEN 1 ELSE 0 END AS watch_list
  FROM lagged),
urg AS (
  SELECT watched.*,
         round(CASE WHEN watch_list = 1 THEN company_spread * 1.0 / (SELECT n FROM ncomp) * recency_weight
               ELSE 0.0 END, 4) AS watch_urgency
  FROM watched),
mm AS (
  SELECT min(lag) AS lo_l, max(lag) AS hi_l, min(velocity) AS lo_v, max(velocity) AS hi_v,
         min(company_spread) AS lo_s, max(company_spread) AS hi_s, min(gap_prob) AS lo_p, max(gap_prob) AS hi_p,
         min(provider_gap) AS lo_g, max(provider_gap) AS hi_g, max(volatility) AS hi_vol
  FROM urg),
prio AS (
  SELECT u.*, round(
      (CASE WHEN hi_l > lo_l THEN (lag - lo_l) * 1.0 / (hi_l - lo_l) ELSE 0.0 END) * 0.30
    + (CASE WHEN hi_v > lo_v THEN (velocity - lo_v) / (hi_v - lo_v) ELSE 0.0 END) * 0.25
    + (CASE WHEN hi_s > lo_s THEN (company_spread - lo_s) * 1.0 / (hi_s - lo_s) ELSE 0.0 END) * 0.20
    + (CASE WHEN hi_p > lo_p THEN (gap_prob - lo_p) / (hi_p - lo_p) ELSE 0.0 END) * 0.15
    + (CASE WHEN hi_g > lo_g THEN (provider_gap - lo_g) / (hi_g - lo_g) ELSE 0.0 END) * 0.10, 4) AS priority_score,
    CASE WHEN hi_v > lo_v THEN round((velocity - lo_v) / (hi_v - lo_v), 4) ELSE 0.0 END AS velocity_pos,
    round(1 - volatility / hi_vol, 4) AS volatility_inv_norm
  FROM urg u, mm),
scored AS (
  SELECT prio.*, CASE WHEN is_covered = 1 THEN 0.0
                      ELSE round(lag * (1 + velocity_pos) * (1 + provider_gap), 4) END AS debt_score
  FROM prio)"""

LABEL_COLS = [("item", "string"), ("demand_score", "double"), ("label", "int")]


@register("demand_labels", S.with_(SCORED[1:]) + f"SELECT {sql_typed(LABEL_COLS)} FROM lab")
def demand_labels(spark, sf):
    """L1 + L2: demand score and weak label (score above its 65th percentile, not covered)."""
    f = sc.weak_label(materialize(sc.demand_score(features(spark, sf))))
    return typed(f, LABEL_COLS)


@register("label_balance", S.with_(SCORED[1:]) + """
SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
       CAST(sum(label) AS BIGINT) AS n_positive,
       round(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) * 1.0 / nullif(sum(label), 0), 6)::DOUBLE AS imbalance_ratio,
       round(quantile_cont(demand_score, 0.65), 6)::DOUBLE AS threshold
FROM lab""")
def label_balance(spark, sf):
    """A16 + A12: class counts, imbalance ratio and the 65th-percentile threshold."""
    scored = materialize(sc.demand_score(features(spark, sf)).select("demand_score", "is_covered"))
    thr = quantile(scored, "demand_score", sc.LABEL_QUANTILE)
    f = sc.weak_label(scored.withColumn("threshold", thr), threshold=F.col("threshold"))
    return f.agg(F.count_if(F.col("label") == 0).alias("n_negative"),
                 F.sum("label").cast("long").alias("n_positive"),
                 r6(F.count_if(F.col("label") == 0) / F.when(F.sum("label") > 0, F.sum("label")),
                    "imbalance_ratio"),
                 r6(F.max("threshold"), "threshold"))


PRIORITY_COLS = [("item", "string"), ("trajectory", "string"), ("lag", "int"),
                 ("company_spread", "bigint"), ("provider_gap", "double"), ("gap_prob", "double"),
                 ("priority_score", "double"), ("debt_score", "double"), ("watch_list", "int")]


@register("gap_priority", S.with_(SCORED[1:]) + f"""
SELECT {sql_typed(PRIORITY_COLS)} FROM scored WHERE is_covered = 0""")
def gap_priority(spark, sf):
    """Flagship: every uncovered item with lag, priority (K4), debt (K6) and watch flag."""
    f = an.scored_items(demand(spark, sf), coverage(spark, sf), FOCAL)
    return typed(sc.rank_gaps(f, "priority_score"), PRIORITY_COLS)


SCORE_COLS = [("item", "string"), ("lag", "int"), ("watch_list", "int"), ("watch_urgency", "double"),
              ("priority_score", "double"), ("velocity_pos", "double"),
              ("volatility_inv_norm", "double"), ("debt_score", "double")]


@register("item_scores", S.with_(SCORED[1:]) + f"SELECT {sql_typed(SCORE_COLS)} FROM scored")
def item_scores(spark, sf):
    """K1-K4, K6, P17 for every item."""
    f = an.scored_items(demand(spark, sf), coverage(spark, sf), FOCAL)
    return typed(f, SCORE_COLS)


@register("watch_list", S.with_(SCORED[1:]) + """
SELECT item, CAST(velocity AS DOUBLE) AS velocity, round(volatility, 6) AS volatility,
       CAST(watch_urgency AS DOUBLE) AS watch_urgency
FROM scored WHERE watch_list = 1""")
def watch_list(spark, sf):
    """K2 + K3: watched items and their urgency."""
    f = an.scored_items(demand(spark, sf), coverage(spark, sf), FOCAL).where(F.col("watch_list") == 1)
    return f.select("item", F.col("velocity").cast("double"), r6("volatility"), "watch_urgency")


@register("debt_top", S.with_(SCORED[1:]) + """
SELECT item, CAST(lag AS INTEGER) AS lag, velocity_pos, debt_score FROM scored
WHERE is_covered = 0 ORDER BY debt_score DESC, item LIMIT 15""")
def debt_top(spark, sf):
    """K6 + K8: the 15 largest debts."""
    f = an.scored_items(demand(spark, sf), coverage(spark, sf), FOCAL).where(F.col("is_covered") == 0)
    return sc.top_k(f, "debt_score", 15).select("item", "lag", "velocity_pos", "debt_score")


@register("analysis_summary", S.with_(SCORED[1:]) + """
SELECT count(*) AS n_items, count(*) FILTER (WHERE is_covered = 0) AS n_gaps,
       CAST(sum(watch_list) AS BIGINT) AS n_watch, CAST(sum(in_transition) AS BIGINT) AS n_transition,
       round(avg(lag) FILTER (WHERE is_covered = 0), 6) AS mean_lag,
       max(lag) FILTER (WHERE is_covered = 0) AS max_lag, round(sum(debt_score), 6) AS total_debt
FROM scored""")
def analysis_summary(spark, sf):
    """K9: one summary row."""
    s = sc.final_summary(an.scored_items(demand(spark, sf), coverage(spark, sf), FOCAL))
    return s.select("n_items", "n_gaps", "n_watch", "n_transition", r6("mean_lag"),
                    "max_lag", r6("total_debt"))


# --- co-occurrence (G1-G4) ---------------------------------------------------

PAIRS = S.DEMAND + """,
bi AS (SELECT DISTINCT basket, item FROM demand),
pairs AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS co_count
  FROM bi a JOIN bi b ON a.basket = b.basket AND a.item < b.item
  GROUP BY a.item, b.item),
edges AS (
  SELECT item_a AS item, item_b AS neighbour, co_count AS weight FROM pairs
  UNION ALL SELECT item_b, item_a, co_count FROM pairs)"""


@register("cooccurrence_pairs", S.with_(PAIRS[1:]) + "SELECT item_a, item_b, co_count FROM pairs")
def cooccurrence_pairs(spark, sf):
    """G1: basket = order; pairs of distinct items a < b with the number of baskets."""
    return co.pair_counts(co.basket_items(tables.demand_baskets(spark, sf)))


@register("graph_summary", S.with_(PAIRS[1:]) + """
SELECT (SELECT count(DISTINCT item) FROM edges) AS n_nodes, (SELECT count(*) FROM pairs) AS n_edges,
       (SELECT max(co_count) FROM pairs) AS max_weight,
       (SELECT count(*) FROM pairs WHERE co_count = 1) AS n_weight_one""")
def graph_summary(spark, sf):
    """Nodes, edges, heaviest edge, edges of weight one."""
    return co.graph_summary(co.pair_table(tables.demand_baskets(spark, sf)))


@register("top_cooccurring", S.with_(PAIRS[1:]) + """
SELECT item, string_agg(neighbour, ', ' ORDER BY r) AS top_cooccurring FROM (
  SELECT item, neighbour, row_number() OVER (PARTITION BY item ORDER BY weight DESC, neighbour) AS r
  FROM edges) WHERE r <= 3 GROUP BY item""")
def top_cooccurring(spark, sf):
    """Three heaviest neighbours per item."""
    return co.top_neighbours(co.pair_table(tables.demand_baskets(spark, sf)), 3)


@register("gap_propagation", S.with_(SCORED[1:] + "," + PAIRS[1:].replace("demand AS (", "demand2 AS (", 1)
                                     .replace("FROM demand)", "FROM demand2)")) + """,
recv AS (
  SELECT e.neighbour AS item, sum(CAST(s.gap_prob AS DECIMAL(28,10)) * e.weight) * 0.3 AS s
  FROM edges e JOIN scored s ON s.item = e.item AND s.is_covered = 0 GROUP BY e.neighbour)
SELECT s.item, round(coalesce(r.s, 0.0), 4)::DOUBLE AS propagated_gap
FROM scored s LEFT JOIN recv r USING (item)""")
def gap_propagation(spark, sf):
    """One-step spread of gap probability to co-occurring items."""
    d = demand(spark, sf)
    f = an.scored_items(d, coverage(spark, sf), FOCAL)
    out = co.propagate_gaps(f, co.pair_table(tables.demand_baskets(spark, sf)))
    return out.select("item", "propagated_gap")
