"""Registered queries: vectors (V1-V5, V8, V9) over ``embeddings(vec_id, embedding, label)``.

The search batch is data-derived: one query per label, its vector the label's
centroid; the searched cards are all embeddings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from demandlens.operators import vectors as vx
from demandlens.plans.common import r6
from demandlens.plans.registry import register
from demandlens.session import materialize
from demandlens.sources import tables

CENTROID_SQL = """
cen AS (
  SELECT list(m ORDER BY p) AS c FROM (
    SELECT p, avg(x) AS m FROM (
      SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM {src}) GROUP BY p))"""


def _emb(spark, sf):
    return tables.table(spark, sf, "embeddings")


@register("vector_centrality", "WITH " + CENTROID_SQL.format(src="embeddings")[1:] + """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), cen.c), 6) AS centrality
FROM embeddings, cen""")
def vector_centrality(spark, sf):
    """V1 + V2: cosine of every vector to the centroid of all vectors."""
    return vx.centrality(_emb(spark, sf)).select("vec_id", r6("centrality"))


@register("vector_gap_distance", "WITH " + CENTROID_SQL.format(
    src="(SELECT * FROM embeddings WHERE label = 0)")[1:] + """
SELECT vec_id, round(coalesce(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), cen.c), 0.0), 6)
       AS gap_distance
FROM embeddings LEFT JOIN cen ON true""")
def vector_gap_distance(spark, sf):
    """V3: 1 - cosine to the centroid of the label-0 ("covered") vectors."""
    e = _emb(spark, sf)
    return vx.gap_distance(e, F.col("label") == 0).select("vec_id", r6("gap_distance"))


@register("unit_vectors", """
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS unit_norm,
       round(v[1], 6) AS first_component FROM (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]),
           lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v
  FROM embeddings)""")
def unit_vectors(spark, sf):
    """V5: unit-normalised vectors (norm and first component reported)."""
    u = _emb(spark, sf).select("vec_id", vx.unit("embedding").alias("v"))
    return u.select("vec_id", r6(vx.norm("v"), "unit_norm"), r6(F.col("v")[0], "first_component"))


@register("semantic_neighbours", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (
  SELECT a.vec_id, b.vec_id AS nb, list_cosine_similarity(a.v, b.v) AS sim
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, CAST(nb AS VARCHAR)) AS rk FROM s)
SELECT CAST(vec_id AS VARCHAR) AS vec_id, string_agg(CAST(nb AS VARCHAR), ', ' ORDER BY rk) AS neighbours
FROM r WHERE rk <= 3 GROUP BY vec_id""")
def semantic_neighbours(spark, sf):
    """V4: the three most similar other vectors of every vector (exact, blocked)."""
    return vx.semantic_neighbours(_emb(spark, sf), "vec_id", n=3)


@register("approximate_neighbours")
def approximate_neighbours(spark, sf):
    """V4, approximate: the three most similar other vectors found in shared buckets of random
    projections (rows-only; ``neighbour_recall`` measures it against the exact blocks)."""
    return vx.joined_neighbours(vx.approx_pairs(_emb(spark, sf), "vec_id", n=3), "vec_id")


@register("neighbour_recall", """
SELECT 3 * count(*) AS n_pairs, 3 * count(*) AS n_returned, true AS recall_at_least_090,
       true AS similarities_exact FROM embeddings""")
def neighbour_recall(spark, sf):
    """V4: share of the exact three neighbours of every vector that the buckets find (at least 0.9), and
    whether every pair returned by both has the same similarity to 9 digits."""
    e = _emb(spark, sf)
    found = materialize(vx.approx_pairs(e, "vec_id", n=3))
    side = e.select(F.col("vec_id").cast("string").alias("_id"), F.col("embedding").alias("_v"))
    exact = materialize(vx.all_neighbours(side, 3))
    both = found.join(exact.select("lid", "rid", F.col("sim").alias("exact")), ["lid", "rid"])
    same = both.agg(F.every(F.abs(F.col("sim") - F.col("exact")) < 1e-9).alias("s")).scalar()
    r = vx.neighbour_recall(found, exact)
    return r.select("n_pairs", found.agg(F.count(F.lit(1))).scalar().alias("n_returned"),
                    (F.col("recall") >= 0.9).alias("recall_at_least_090"), same.alias("similarities_exact"))


def label_queries(emb):
    """One query per label: the centroid of its vectors (positions averaged)."""
    per = (emb.select("label", F.posexplode("embedding").alias("p", "x"))
           .groupBy("label", "p").agg(F.avg("x").alias("m")))
    return per.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("query_vec")
    ).select(F.col("label").cast("string").alias("query_id"), "query_vec")


@register("vector_search", """
WITH q AS (
  SELECT CAST(label AS VARCHAR) AS query_id, list(m ORDER BY p) AS qv FROM (
    SELECT label, p, avg(x) AS m FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS p FROM embeddings)
    GROUP BY label, p) GROUP BY label),
s AS (
  SELECT q.query_id, CAST(e.vec_id AS VARCHAR) AS id,
         1 - list_cosine_similarity(q.qv, CAST(e.embedding AS DOUBLE[])) AS distance
  FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s),
k AS (SELECT *, round(0.7 * (1 - distance) + 0.3 * 0.0, 4) AS hybrid_score FROM r WHERE rank <= 8)
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance, hybrid_score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, rank) AS INTEGER) AS hybrid_rank
FROM k""")
def vector_search(spark, sf):
    """V8 + V9: top-8 vectors per label-centroid query, then the hybrid re-rank."""
    e = _emb(spark, sf)
    hits = vx.search(label_queries(e), e, 8, c_id="vec_id")
    h = vx.hybrid_rerank(hits.withColumnRenamed("vec_id", "id"), priority=None)
    return h.select("query_id", "id", F.col("rank").cast("int"), r6("distance"), "hybrid_score",
                    F.col("hybrid_rank").cast("int"))


@register("vector_clusters")
def vector_clusters(spark, sf):
    """V6 + V7: k-means (k = 8, best of 10 seeds) on unit vectors; size and first six
    members of each cluster.  Rows-only check (labels are arbitrary)."""
    e = _emb(spark, sf)
    labelled, _ = vx.kmeans_clusters(e, "embedding", k=8, seed=42, restarts=10)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.join(vx.cluster_representatives(labelled, "vec_id"), "cluster")
