"""Whole-table order statistics without a single-task buffer or a global window.

``ranged()`` lays a table out in sorted range partitions (written once to the checkpoint
folder).  Totals per partition are a few numbers each; their running sums are the offsets that
turn what is counted inside a partition into whole-table positions:

* ``global_index``  consecutive numbers over all rows (M1 with chunks across files);
* ``prefix_sums``   running sums over all rows (L15);
* ``quantiles``     exact quantiles (A12-A14): of the range partitions only those that hold a wanted
  rank are read further, and the two neighbouring values are interpolated.

Values are counted by a partial aggregation first, so a value that a third of all rows hold is one
row; a sort key should end in a column that makes it unique, so that hot keys can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.session import materialize

OFFSET_GROUP = 256   # partitions whose running sum is one window group
ROW_BITS = 33        # monotonically_increasing_id: partition above, row in the partition below


def ranged(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """df sorted in range partitions of ``order``, with ``_part`` and ``_row`` (number in the
    partition), written once.  Small tables are coalesced at run time."""
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    laid = dealt.sortWithinPartitions(*order).withColumn("_place", place)
    return materialize(laid.withColumn("_part", F.shiftright("_place", ROW_BITS))
                       .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("_place"))


def offsets(laid: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_part, total_<name>, before_<name>): a row per range partition."""
    names = list(sums)
    totals = (laid.groupBy("_part").agg(*[F.sum(c).alias(f"total_{n}") for n, c in sums.items()])
              .withColumn("_group", F.floor(F.col("_part") / OFFSET_GROUP)))
    inside = Window.partitionBy("_group").orderBy("_part")
    groups = totals.groupBy("_group").agg(*[F.sum(f"total_{n}").alias(n) for n in names])
    listed = groups.agg(F.collect_list(F.struct("_group", *names)).alias("g")).scalar()
    out = totals.withColumn("_groups", listed)

    def lower(n: str) -> Column:
        zero = F.lit(0).cast(totals.schema[f"total_{n}"].dataType)
        return F.aggregate(F.filter("_groups", lambda g: g["_group"] < F.col("_group")), zero, lambda a, g: a + g[n])

    for n in names:
        out = out.withColumn(f"before_{n}", F.sum(f"total_{n}").over(inside) - F.col(f"total_{n}") + lower(n))
    return out.drop("_group", "_groups")


def global_index(df: DataFrame, order: list[str], out: str = "index", partitions: int | None = None) -> DataFrame:
    """Consecutive numbers from 0 in the order of ``order`` over all rows (no window, one shuffle)."""
    laid = ranged(df, order, partitions)
    at = offsets(laid, {"rows": F.lit(1)}).select("_part", "before_rows")
    return (laid.join(F.broadcast(at), "_part")   # a row per range partition
            .withColumn(out, F.col("before_rows") + F.col("_row")).drop("_part", "_row", "before_rows"))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """df with ``before_<name>``: the sum over all rows earlier in ``order`` (which is to be unique)."""
    laid = ranged(df, order, partitions)
    at = offsets(laid, sums).drop(*[f"total_{n}" for n in sums])
    w = Window.partitionBy("_part").orderBy("_row")
    rows = laid.join(F.broadcast(at), "_part")
    return rows.select(*df.columns, *[(F.col(f"before_{n}") + F.sum(c).over(w) - c).alias(f"before_{n}") for n, c in sums.items()])


def quantiles(df: DataFrame, wanted: dict[str, list[float]], partitions: int | None = None) -> DataFrame:
    """(col, q, value): exact quantiles by linear interpolation, nulls left out; a column without
    values has null.  All columns go through one plan: (column, value, count) rows."""
    cols = list(wanted)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]))
    values = (df.select(pairs.alias("e")).select("e.col", "e.v").where(F.col("v").isNotNull())
              .groupBy("col", "v").agg(F.count(F.lit(1)).alias("c")))
    laid = ranged(values, ["col", "v"], partitions)
    n = laid.groupBy("col").agg(F.sum("c").alias("n"))
    asked = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.lit(float(q)).alias("q")) for c in cols for q in wanted[c]]))
    ask = df.sparkSession.range(1).select(asked.alias("a")).select("a.col", "a.q")
    # columns come one after the other in the whole order
    starts = n.agg(F.collect_list(F.struct("col", "n")).alias("s")).scalar()
    ask = (ask.join(F.broadcast(n), "col", "left").withColumn("_s", starts)
           .withColumn("_start", F.aggregate(F.filter("_s", lambda x: x["col"] < F.col("col")), F.lit(0).cast("long"),
                                             lambda a, x: a + x["n"]))
           .withColumn("pos", F.col("q") * (F.col("n") - 1))
           .select("col", "q", "pos", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("k"), "_start")
           .distinct().withColumn("k", F.col("k").cast("long")).withColumn("rank", F.col("_start") + F.col("k")))
    ranks = ask.agg(F.collect_set("rank")).scalar()   # two for each wanted quantile
    at = offsets(laid, {"c": F.col("c")}).withColumn("_ranks", ranks)
    hit = at.where(F.exists("_ranks", lambda k: (k >= F.col("before_c")) & (k < F.col("before_c") + F.col("total_c"))))
    w = Window.partitionBy("_part").orderBy("_row")
    rows = (laid.join(F.broadcast(hit.select("_part", "before_c", "_ranks")), "_part")
            .withColumn("_lo", F.col("before_c") + F.sum("c").over(w) - F.col("c")))
    held = F.filter("_ranks", lambda k: (k >= F.col("_lo")) & (k < F.col("_lo") + F.col("c")))
    found = rows.select("v", F.explode(held).alias("rank"))
    near = ask.join(F.broadcast(found), "rank", "left")
    low, high = F.min_by("v", "k"), F.max_by("v", "k")
    weight = F.max("pos") - F.min("k")
    value = F.when(F.min("k") == F.max("k"), low).otherwise((1 - weight) * low + weight * high)
    return near.groupBy("col", "q").agg(value.alias("value"))


def quantile(df: DataFrame, col: str, q: float, partitions: int | None = None) -> Column:
    """One exact quantile as a scalar subquery."""
    return quantiles(df, {col: [q]}, partitions).select("value").scalar()
