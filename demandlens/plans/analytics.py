"""The offline gap analysis as one plan (features → labels → scores → graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import cooccur as co
from demandlens.operators import features as fe
from demandlens.operators import scoring as sc
from demandlens.session import materialize


def scored_items(demand: DataFrame, coverage: DataFrame, focal: str,
                 prob: DataFrame | None = None, upcoming_type: str = "R",
                 checkpoint: bool = True) -> DataFrame:
    """Feature table + demand score, label, lag, watch list, priority, debt.

    ``prob`` (item, gap_prob) supplies model probabilities; without it the
    demand score stands in (K4 min-max scales it either way).

    The item-level table (one row per item, independent of the log size) is
    written once to the shared checkpoint folder: that cuts the lineage back
    to the log scan, and every whole-table statistic of the later scores is
    one struct scalar subquery over that small table instead of a re-run of
    the feature plan per statistic.
    """
    # the cube is the only log-sized step: write it once, every feature branch reads it
    cube = materialize(fe.demand_cube(demand)) if checkpoint else fe.demand_cube(demand)
    f = fe.feature_table(demand, coverage, focal, cube=cube)
    lo, hi = fe.year_bounds(cube)
    ncomp = cube.select(F.count_distinct("company")).scalar()
    f = (sc.demand_score(f).withColumn("n_companies", ncomp)
         .withColumn("year_lo", lo).withColumn("year_hi", hi))
    if prob is None:
        f = f.withColumn("gap_prob", F.col("demand_score"))
    else:
        f = f.join(prob.select("item", "gap_prob"), "item", "left").fillna({"gap_prob": 0.0})
    f = sc.lag_index(f, hi, lo)
    if checkpoint:
        f = materialize(f)
    st = sc.score_stats(f)
    f = sc.weak_label(f, threshold=st["q_demand_score"])
    f = sc.watch_list(f, F.col("n_companies"), upcoming_type, median=st["median_volatility"])
    f = sc.priority_score(f, stats=st)
    f = sc.debt_score(f, stats=st)
    return f


def with_graph(items: DataFrame, demand: DataFrame, n_top: int = 3) -> DataFrame:
    """Add propagated gap weight (G3) and top co-occurring items (G4); of ``demand`` only
    (basket, item) is read."""
    pairs = co.pair_table(demand)
    out = co.propagate_gaps(items, pairs)
    top = co.top_neighbours(pairs, n_top)
    return out.join(top, "item", "left").withColumn(
        "top_cooccurring", F.coalesce("top_cooccurring", F.lit("")))


def analysed_items(demand: DataFrame, coverage: DataFrame, focal: str, n_top: int = 3,
                   baskets: DataFrame | None = None) -> DataFrame:
    """The full per-item analysis: scores plus graph columns (input of the cards).  ``baskets``
    (basket, item) spares the graph the joins of the whole demand log."""
    return with_graph(scored_items(demand, coverage, focal), demand if baskets is None else baskets, n_top)
