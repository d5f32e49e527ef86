"""Labels and gap scores over the per-item feature table (L1, L2, K1-K7, K9).

Whole-table statistics (quantile, median, min/max, last year) are struct
scalar subqueries (see ``functions.scaling``); every score is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.scaling import min_max_scale, table_stats
from demandlens.operators.order import quantile, quantiles

# fixed values: weights and constants of the scores
DEMAND_WEIGHTS = {"freq": 0.25, "trend_slope": 0.20, "recency_weight": 0.20,
                  "velocity": 0.15, "company_spread_norm": 0.20}
LABEL_QUANTILE = 0.65
PRIORITY_WEIGHTS = {"lag": 0.30, "velocity": 0.25, "company_spread": 0.20,
                    "gap_prob": 0.15, "provider_gap": 0.10}
TEXT_PRIORITY_WEIGHTS = {"priority_score": 0.60, "gap_distance": 0.25, "rarity": 0.15}


def _rnd(c: Column, digits: int | None) -> Column:
    return F.round(c, digits) if digits is not None else c


def weighted_sum(weights: dict[str, float], suffix: str = "") -> Column:
    terms = [F.col(k + suffix) * F.lit(w) for k, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def demand_score(features: DataFrame, digits: int | None = 4) -> DataFrame:
    """L1: weighted sum of frequency, slope, recency, velocity and spread."""
    return features.withColumn("demand_score", _rnd(weighted_sum(DEMAND_WEIGHTS), digits))


def score_stats(items: DataFrame, q: float = LABEL_QUANTILE) -> dict[str, Column]:
    """Every whole-table statistic the scores read, as fields of two struct scalar subqueries.

    Fields: ``q_demand_score`` (L2 threshold), ``median_volatility`` (K2, at 9
    digits), ``min_*``/``max_*`` of the K4 inputs and ``max_volatility`` (P17).
    Read it from a materialised item table, so each subquery is one small scan; the
    quantiles come from range partitions, not from one buffer of all values.
    """
    fields = [F.max("volatility").alias("max_volatility")]
    for c in PRIORITY_WEIGHTS:
        fields += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    ends = items.select(F.struct(*fields).alias("s")).scalar()
    out = {f: ends[f] for c in PRIORITY_WEIGHTS for f in (f"min_{c}", f"max_{c}")} | {"max_volatility": ends["max_volatility"]}
    got = quantiles(items.select("demand_score", F.round("volatility", 9).alias("volatility")),
                    {"demand_score": [q], "volatility": [0.5]})
    of = lambda c: F.max(F.when(F.col("col") == c, F.col("value")))
    mid = got.select(F.struct(of("demand_score").alias("q_demand_score"), of("volatility").alias("median_volatility")).alias("s")).scalar()
    return out | {f: mid[f] for f in ("q_demand_score", "median_volatility")}


def weak_label(scored: DataFrame, q: float = LABEL_QUANTILE, score: str = "demand_score",
               out: str = "label", threshold: Column | None = None) -> DataFrame:
    """L2: 1 when the score exceeds its q-quantile (linear interpolation) and the item is uncovered."""
    thr = threshold if threshold is not None else quantile(scored, score, q)
    return scored.withColumn(out, ((F.col(score) > thr) & (F.col("is_covered") == 0)).cast("int"))


def lag_index(features: DataFrame, year_hi: Column, year_lo: Column) -> DataFrame:
    """K1: last log year minus threshold year for uncovered items, else 0."""
    th = F.coalesce(F.col("threshold_year"), year_lo)
    return features.withColumn("lag", F.when(F.col("is_covered") == 0, year_hi - th)
                               .otherwise(F.lit(0)).cast("int"))


def watch_list(features: DataFrame, n_companies: Column, upcoming_type: str = "R",
               strict: bool = True, digits: int | None = 4,
               median: Column | None = None) -> DataFrame:
    """K2 + K3: watch flag and urgency.

    watch = (upcoming flag or trajectory = upcoming_type) and velocity >= 0 and
    volatility < median volatility (over all items; compared at 9 digits) and
    not covered.  urgency = spread / companies * recency for watched items.
    """
    med = median if median is not None else quantile(features.select(F.round("volatility", 9).alias("v")), "v", 0.5)
    vol = F.round("volatility", 9)
    below = vol < med if strict else vol <= med
    w = (((F.col("upcoming_flag") == 1) | (F.col("trajectory") == upcoming_type))
         & (F.col("velocity") >= 0) & below & (F.col("is_covered") == 0))
    w = F.coalesce(w, F.lit(False))
    urg = F.when(w, F.col("company_spread") / n_companies * F.col("recency_weight")).otherwise(F.lit(0.0))
    return features.withColumn("watch_list", w.cast("int")).withColumn("watch_urgency", _rnd(urg, digits))


def priority_score(df: DataFrame, prob_col: str = "gap_prob", digits: int | None = 4,
                   stats: dict[str, Column] | None = None) -> DataFrame:
    """K4: weighted sum of min-max scaled lag, velocity, spread, probability, provider gap."""
    src = df if prob_col == "gap_prob" else df.withColumn("gap_prob", F.col(prob_col))
    cols = list(PRIORITY_WEIGHTS)
    scaled = min_max_scale(src, cols, suffix="__n", stats=stats)
    out = scaled.withColumn("priority_score", _rnd(weighted_sum(PRIORITY_WEIGHTS, "__n"), digits))
    return out.drop(*[c + "__n" for c in cols])


def text_priority(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """K5: .60 priority + .25 scaled gap distance + .15 scaled rarity."""
    scaled = min_max_scale(df, ["gap_distance", "rarity"], suffix="__n")
    v = (F.col("priority_score") * TEXT_PRIORITY_WEIGHTS["priority_score"]
         + F.col("gap_distance__n") * TEXT_PRIORITY_WEIGHTS["gap_distance"]
         + F.col("rarity__n") * TEXT_PRIORITY_WEIGHTS["rarity"])
    return scaled.withColumn("text_priority", _rnd(v, digits)).drop("gap_distance__n", "rarity__n")


def debt_score(df: DataFrame, digits: int | None = 4, stats: dict[str, Column] | Column | None = None) -> DataFrame:
    """K6 (+P17): lag · (1 + scaled velocity) · (1 + provider gap), 0 when covered."""
    s = stats if stats is not None else table_stats(df, ["velocity", "volatility"], kinds=("min", "max"))
    lo, hi = s["min_velocity"], s["max_velocity"]
    vpos = F.when(hi > lo, _rnd((F.col("velocity") - lo) / (hi - lo), digits)).otherwise(F.lit(0.0))
    debt = _rnd(F.col("lag") * (1 + vpos) * (1 + F.col("provider_gap")), digits)
    return (df.withColumn("velocity_pos", vpos)
            .withColumn("volatility_inv_norm", _rnd(1 - F.col("volatility") / s["max_volatility"], digits))
            .withColumn("debt_score", F.when(F.col("is_covered") == 1, F.lit(0.0)).otherwise(debt)))


def rank_gaps(df: DataFrame, by: str = "gap_prob") -> DataFrame:
    """K7: uncovered items, ``by`` descending, item ascending (total order)."""
    return df.where(F.col("is_covered") == 0).orderBy(F.desc(by), F.asc("item"))


def top_k(df: DataFrame, by: str, k: int, ascending: bool = False) -> DataFrame:
    """K8: the k best rows by ``by`` with the item as tie-break (TakeOrderedAndProject)."""
    o = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(o, F.asc("item")).limit(k)


def final_summary(df: DataFrame) -> DataFrame:
    """K9: one row of totals over the analysed items."""
    gap = F.col("is_covered") == 0
    return df.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(gap).alias("n_gaps"),
        F.sum("watch_list").cast("long").alias("n_watch"),
        F.sum("in_transition").cast("long").alias("n_transition"),
        F.avg(F.when(gap, F.col("lag"))).alias("mean_lag"),
        F.max(F.when(gap, F.col("lag"))).alias("max_lag"),
        F.sum("debt_score").alias("total_debt"))
