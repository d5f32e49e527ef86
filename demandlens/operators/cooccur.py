"""Item co-occurrence graph (G1-G4) as equi-joins and aggregations.

G1 counts, for every unordered item pair a < b, the baskets holding both.
Items are de-duplicated per basket first.  A basket with k distinct items
yields k(k-1)/2 pairs; to keep a hot basket from landing in one task its
items are hashed into T tiles (T grows with k, T = 1 for ordinary baskets)
and tile pair (i, j) of that basket becomes its own join key, so the pairs
of one basket are produced by T² tasks in parallel and each pair exactly
once.  Pair counts then aggregate with a map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed value: share of a gap's probability passed to each co-occurring item
PROPAGATION_FACTOR = 0.3


def basket_items(demand: DataFrame, basket: str = "basket") -> DataFrame:
    return (demand.select(F.col(basket).alias("basket"), "item")
            .where(F.col("item").isNotNull()).distinct())


def pair_counts(baskets: DataFrame, tile_size: int = 512) -> DataFrame:
    """G1: (item_a, item_b, co_count) with item_a < item_b.

    ``tile_size`` is the number of items per tile, so a join key makes at most about
    tile_size² pairs whatever the size of the basket.
    """
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("_k"))
    tiles = F.ceil(F.col("_k") / F.lit(tile_size)).cast("int")
    bi = (baskets.join(sizes.select("basket", tiles.alias("_t")), "basket")
          .withColumn("_tile", F.pmod(F.xxhash64("item"), F.col("_t")).cast("int"))
          .withColumn("_all", F.sequence(F.lit(0), F.col("_t") - 1)))
    left = bi.select("basket", F.col("item").alias("item_a"), F.col("_tile").alias("_ta"),
                     F.explode("_all").alias("_tb"))
    right = bi.select("basket", F.col("item").alias("item_b"), F.explode("_all").alias("_ta"),
                      F.col("_tile").alias("_tb"))
    pairs = left.join(right, ["basket", "_ta", "_tb"]).where(F.col("item_a") < F.col("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("co_count"))


def pair_table(demand: DataFrame, basket: str = "basket") -> DataFrame:
    """G1 written once to the checkpoint folder, for plans that read the pairs
    several times (both edge directions, neighbours, propagation): without it
    each reference re-runs the demand join and the basket self-join."""
    from demandlens.session import materialize

    return materialize(pair_counts(basket_items(demand, basket)))


def undirected_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of every edge: (item, neighbour, weight)."""
    a = pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("neighbour"),
                     F.col("co_count").alias("weight"))
    b = pairs.select(F.col("item_b").alias("item"), F.col("item_a").alias("neighbour"),
                     F.col("co_count").alias("weight"))
    return a.unionByName(b)


def graph_summary(pairs: DataFrame) -> DataFrame:
    """Node and edge counts of the weighted graph."""
    nodes = undirected_edges(pairs).select("item").distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    edges = pairs.agg(F.count(F.lit(1)).alias("n_edges"), F.max("co_count").alias("max_weight"),
                      F.count_if(F.col("co_count") == 1).alias("n_weight_one"))
    return nodes.select(F.col("n_nodes"), edges.select("n_edges").scalar().alias("n_edges"),
                        edges.select("max_weight").scalar().alias("max_weight"),
                        edges.select("n_weight_one").scalar().alias("n_weight_one"))


def propagate_gaps(items: DataFrame, pairs: DataFrame, prob_col: str = "gap_prob",
                   factor: float = PROPAGATION_FACTOR, digits: int | None = 4,
                   scale: int = 10) -> DataFrame:
    """Each neighbour of an uncovered item g receives Σ factor · prob(g) · weight.

    Edges ⋈ gap items on the gap side, aggregate per neighbour, left join back;
    0 for items that receive nothing.  The sum runs in DECIMAL(28, ``scale``)
    so it is exact and independent of the order rows reach each task.
    """
    gaps = items.where(F.col("is_covered") == 0).select(
        F.col("item").alias("_g"), F.col(prob_col).cast(f"decimal(28,{scale})").alias("_p"))
    e = undirected_edges(pairs)
    recv = (e.join(gaps, e.item == gaps._g)
            .groupBy(F.col("neighbour").alias("item"))
            .agg(F.sum(F.col("_p") * F.col("weight")).alias("_s")))
    v = F.coalesce(F.col("_s") * F.lit(factor).cast("decimal(4,3)"), F.lit(0))
    if digits is not None:
        v = F.round(v, digits)
    return (items.join(recv, "item", "left")
            .withColumn("propagated_gap", v.cast("double")).drop("_s"))


def top_neighbours(pairs: DataFrame, n: int = 3) -> DataFrame:
    """Per item, its n heaviest neighbours (weight desc, name asc) joined by ', '.

    The window is partitioned by item and limited to n rows per item
    (Spark plans a group limit before the shuffle).
    """
    e = undirected_edges(pairs)
    w = Window.partitionBy("item").orderBy(F.desc("weight"), F.asc("neighbour"))
    top = e.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy("item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "neighbour"))),
                                 lambda x: x["neighbour"]), ", ").alias("top_cooccurring"))
