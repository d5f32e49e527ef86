"""Per-item demand features.

All work runs on one compact aggregate of the demand log, the *cube*
``(item, year, company, item_type) -> n``.  The cube is built with a
partial (map-side) aggregation, so a hot item costs one row per task before
the shuffle.  Every feature below reads the cube; the branches prune it
differently, so Spark would not reuse one exchange for all of them, and
``feature_table`` therefore writes the cube once (checkpoint) and lets every
branch scan that small table.

Global scalars (first/last year, number of companies) are scalar subqueries
over small aggregates, never collected on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUBE_KEYS = ("item", "year", "company", "item_type")


def demand_cube(demand: DataFrame) -> DataFrame:
    """(item, year, company, item_type, n, upcoming) with n = demand rows."""
    agg = [F.count(F.lit(1)).alias("n")]
    if "upcoming_flag" in demand.columns:
        agg.append(F.max("upcoming_flag").alias("upcoming"))
    else:
        agg.append(F.lit(0).alias("upcoming"))
    return demand.where(F.col("item").isNotNull()).groupBy(*CUBE_KEYS).agg(*agg)


def yearly_counts(cube: DataFrame) -> DataFrame:
    """Demand rows per (item, year), present years only."""
    return cube.groupBy("item", "year").agg(F.sum("n").alias("cnt"))


def item_frequency(cube: DataFrame) -> DataFrame:
    """A1: demand rows per item."""
    return cube.groupBy("item").agg(F.sum("n").alias("freq"))


def year_bounds(cube: DataFrame) -> tuple[Column, Column]:
    """First and last year of the whole log, as scalar-subquery columns."""
    b = cube.select(F.min("year").alias("lo"), F.max("year").alias("hi"))
    return b.select("lo").scalar(), b.select("hi").scalar()


def item_trends(cube: DataFrame, threshold: bool = True) -> DataFrame:
    """T2-T6 in one aggregation per item over its yearly counts.

    * freq            Σ cnt
    * n_years         number of present years
    * trend_slope     OLS slope of cnt on year over present years, 0 if < 2 years
    * velocity        mean first difference over present years = (last-first)/(n-1), 0 if < 2
    * recency_weight  Σ cnt·(year-lo) / (Σ cnt · (hi-lo)) in whole numbers with one division, 0 when hi = lo
    * volatility      sample std of the counts zero-filled over lo..hi, closed form
                      from Σcnt, Σcnt² and N = hi-lo+1 (no row expansion)
    * threshold_year  first year with cnt >= median of the positive counts (T6)
    """
    yearly = yearly_counts(cube)
    lo, hi = year_bounds(cube)
    aggs = [
        F.sum("cnt").alias("freq"),
        F.count(F.lit(1)).alias("n_years"),
        F.regr_slope(F.col("cnt").cast("double"), F.col("year").cast("double")).alias("_slope"),
        F.min_by("cnt", "year").alias("_first"),
        F.max_by("cnt", "year").alias("_last"),
        F.sum(F.col("cnt") * F.col("year")).alias("_sy"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("_sq"),
    ]
    if threshold:
        # the per-item list holds one entry per present year: bounded by the
        # number of distinct years, not by the data volume
        aggs += [F.median("cnt").alias("_med"),
                 F.collect_list(F.struct("year", "cnt")).alias("_series")]
    t = yearly.groupBy("item").agg(*aggs)
    n = (hi - lo + 1).cast("double")
    s = F.col("freq").cast("double")
    out = (t
           .withColumn("trend_slope", F.when(F.col("n_years") > 1, F.col("_slope")).otherwise(F.lit(0.0)))
           .withColumn("velocity", F.when(F.col("n_years") > 1,
                                          (F.col("_last") - F.col("_first")) / (F.col("n_years") - 1))
                       .otherwise(F.lit(0.0)))
           .withColumn("recency_weight", F.when(hi > lo, (F.col("_sy") - lo * F.col("freq")) / (F.col("freq") * (hi - lo)))
                       .otherwise(F.lit(0.0)))
           .withColumn("volatility", F.when(n > 1, F.sqrt(
               F.greatest(F.lit(0.0), (n * F.col("_sq") - s * s) / (n * (n - 1))))))
           )
    if threshold:
        out = out.withColumn("threshold_year", F.array_min(F.transform(
            F.filter("_series", lambda x: (x["cnt"] >= F.col("_med")) & (x["cnt"] > 0)),
            lambda x: x["year"])))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def company_spread(cube: DataFrame, digits: int | None = 3) -> DataFrame:
    """A2 + A4: distinct companies per item and the share of all companies."""
    total = cube.select(F.count_distinct("company")).scalar()
    per = cube.groupBy("item").agg(F.count_distinct("company").alias("company_spread"),
                                   F.max("upcoming").alias("upcoming_flag"))
    norm = F.col("company_spread") / total
    if digits is not None:
        norm = F.round(norm, digits)
    return per.withColumn("company_spread_norm", norm)


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: str = "n",
                  out: str = "mode") -> DataFrame:
    """Most frequent ``value`` per ``keys``, smallest value on ties.

    ``df`` holds pre-aggregated weights; one aggregation picks the value with
    the largest weight via ``min_by(value, (-weight, value))``.
    """
    w = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return w.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct(-F.col("_w"), F.col(value))).alias(out))


def trajectory(cube: DataFrame, default: str = "Unknown") -> DataFrame:
    """Mode of item_type over the whole log per item."""
    m = weighted_mode(cube, ["item"], "item_type", out="trajectory")
    return m.withColumn("trajectory", F.coalesce("trajectory", F.lit(default)))


def type_transitions(cube: DataFrame) -> DataFrame:
    """Per item, the yearly mode of item_type; ``first -> last`` when it changes.

    transition is null unless the item has ≥ 2 years and > 1 distinct yearly mode.
    """
    ym = weighted_mode(cube, ["item", "year"], "item_type", out="year_type")
    per = ym.groupBy("item").agg(
        F.count(F.lit(1)).alias("_ny"),
        F.count_distinct("year_type").alias("_nt"),
        F.min_by("year_type", "year").alias("_a"),
        F.max_by("year_type", "year").alias("_b"))
    tr = F.when((F.col("_ny") >= 2) & (F.col("_nt") > 1),
                F.concat(F.col("_a"), F.lit(" -> "), F.col("_b")))
    return per.select("item", tr.alias("transition"))


def transition_counts(transitions: DataFrame) -> DataFrame:
    """Number of items per transition pattern."""
    return (transitions.where(F.col("transition").isNotNull())
            .groupBy("transition").agg(F.count(F.lit(1)).alias("n_items")))


def feature_table(demand: DataFrame, coverage: DataFrame, focal: str,
                  cube: DataFrame | None = None) -> DataFrame:
    """The per-item feature table: trends, spread, coverage, trajectory, transition.

    Item-level frames are joined on ``item``; each is one row per item, so
    the joins shuffle item-sized data only.
    """
    from demandlens.operators.coverage import coverage_flags

    if cube is None:
        # every branch below reads the cube: write it once (a persisted cube would stay
        # pinned in executor memory after the query; the written one is cleaned up)
        from demandlens.session import materialize

        cube = materialize(demand_cube(demand))
    f = (item_trends(cube)
         .join(company_spread(cube), "item")
         .join(trajectory(cube), "item", "left")
         .join(type_transitions(cube), "item", "left"))
    f = coverage_flags(f, coverage, focal)
    return f.withColumn("in_transition", F.col("transition").isNotNull().cast("int"))


MAX_CATEGORIES = 1000


def one_hot(df: DataFrame, col: str, categories: list[str], prefix: str | None = None) -> DataFrame:
    """One boolean column per declared category (fixed width, independent of the data); a null is in none."""
    p = prefix or col
    return df.select("*", *[F.coalesce(F.col(col).cast("string") == F.lit(str(c)), F.lit(False)).alias(f"{p}_{c}") for c in categories])


def categories_of(df: DataFrame, col: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """The distinct non-null values of a column, sorted: the declared categories of ``one_hot``.  A column of more
    than ``limit`` values is an error (wide columns are for small sets; use ``feature_vectors``)."""
    found = [r[0] for r in df.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} categories")
    return sorted(found)


def feature_vectors(df: DataFrame, numeric: list[str], categorical: list[str], out: str = "features") -> tuple[DataFrame, list[str]]:
    """P15 for models: ``out`` = sparse vector of the numeric columns and one slot per category found in the data
    (plus one for unknown values); returns the frame and the slots' names."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    text = df.withColumns({c: F.col(c).cast("string") for c in categorical} | {c: F.col(c).cast("double") for c in numeric})
    index, hot = [f"_{c}_index" for c in categorical], [f"_{c}_hot" for c in categorical]
    stages = [VectorAssembler(inputCols=[*numeric, *hot], outputCol=out, handleInvalid="keep")]
    if categorical:
        stages = [StringIndexer(inputCols=categorical, outputCols=index, stringOrderType="alphabetAsc", handleInvalid="keep"),
                  OneHotEncoder(inputCols=index, outputCols=hot, dropLast=False), *stages]
    model = Pipeline(stages=stages).fit(text)
    labels = model.stages[0].labelsArray if categorical else []
    names = [*numeric, *[f"{c}_{v}" for c, vs in zip(categorical, labels) for v in (*vs, "__unknown")]]
    return model.transform(text).drop(*index, *hot), names


COST_DIGITS = 9   # segment costs are compared at so many digits, so that ties don't hang on the order of a sum


def segment_costs(cube: DataFrame, lo: int, hi: int) -> DataFrame:
    """(item, a, b, cost) of every segment of years lo + a .. lo + b - 1 of an item's zero-filled series.

    The cost is that of an RBF kernel: length minus the mean row sum of exp(-gamma (y_i - y_j)^2)
    over the segment, where 1 / gamma is the median squared difference of two years (1 where that is 0).
    Years are paired by an equi-join on the item; an item has n = hi - lo + 1 years, so it makes at
    most n^2 pairs and n^4 / 24 segment entries, whatever the size of the log.
    """
    n = hi - lo + 1
    years = (yearly_counts(cube).select("item", (F.col("year") - lo).alias("t"), F.col("cnt").cast("double").alias("y"))
             .groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("t", "y"))).alias("m")))
    series = years.select("item", F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                              lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("y"))
    row = series.select("item", F.posexplode("y").alias("i", "yi"))
    pairs = row.join(row.select("item", F.col("i").alias("j"), F.col("yi").alias("yj")), "item").withColumn(
        "d", (F.col("yi") - F.col("yj")) * (F.col("yi") - F.col("yj")))
    # the median of at most n (n - 1) / 2 differences
    width = pairs.where("i < j").groupBy("item").agg(F.median("d").alias("w"))
    gram = pairs.join(width, "item", "left").select(
        "item", "i", "j", F.exp(-F.col("d") / F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1.0))).alias("g"))
    starts = F.sequence(F.lit(0), F.least("i", "j"))
    ends = F.sequence(F.greatest("i", "j") + 1, F.lit(n))
    inside = gram.select("item", "g", F.explode(starts).alias("a"), F.greatest("i", "j").alias("j"), F.least("i", "j").alias("i"))
    inside = inside.select("item", "g", "a", F.explode(ends).alias("b"))
    length = F.col("b") - F.col("a")
    return inside.groupBy("item", "a", "b").agg(F.sum("g").alias("s")).select(
        "item", "a", "b", F.round(length - F.col("s") / length, COST_DIGITS).alias("cost"))


def change_point_years(cube: DataFrame, lo: int, hi: int, penalty: float = 1.0,
                       min_size: int = 2, jump: int = 1) -> DataFrame:
    """T7 (opt-in): (item, change_year): year before the first change point of each item's zero-filled yearly
    series (RBF kernel cost, median-heuristic bandwidth, penalty per segment), else T6.

    Segment costs are an aggregation; the optimal partitioning is a fold over the few years: for every
    admissible end the least cost so far and the first break on the way (ties: the earlier
    last segment).  ``lo``/``hi`` are the log's first and last year (two numbers read once).
    """
    n = hi - lo + 1
    costs = segment_costs(cube, lo, hi).where(F.col("b") - F.col("a") >= min_size)
    table = costs.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct(
        (F.col("a") * (n + 1) + F.col("b")).cast("int").alias("k"), F.col("cost").alias("v")))).alias("cost"))
    ends = [t for t in range(1, n + 1) if t % jump == 0 or t == n]
    state = "struct<t:int,v:double,first:int>"
    zero = F.array(F.struct(F.lit(0).alias("t"), F.lit(0.0).alias("v"), F.lit(0).alias("first")).cast(state))

    def step(best: Column, t: Column) -> Column:
        tried = F.transform(best, lambda s: F.struct(
            (s["v"] + F.element_at("cost", s["t"] * (n + 1) + t) + penalty).alias("v"), s["t"].alias("s"),
            F.when(s["first"] > 0, s["first"]).otherwise(t).alias("first")))
        least = F.array_min(F.filter(tried, lambda x: x["v"].isNotNull()))
        return F.when(least.isNull(), best).otherwise(F.concat(best, F.array(
            F.struct(t.alias("t"), F.round(least["v"], COST_DIGITS).alias("v"), least["first"].alias("first")).cast(state))))

    folded = F.aggregate(F.array(*[F.lit(t) for t in ends]), zero, step)
    last = F.element_at(F.filter("best", lambda s: s["t"] == n), 1)
    broken = F.when(F.size(F.filter("best", lambda s: s["t"] == n)) > 0, last["first"])
    found = table.select("item", folded.alias("best")).select("item", F.when(broken < n, lo + broken - 1).alias("_year"))
    trend = item_trends(cube).select("item", "threshold_year")
    return trend.join(found, "item", "left").select("item", F.coalesce("_year", "threshold_year", F.lit(lo)).cast("int").alias("change_year"))
