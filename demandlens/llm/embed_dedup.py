"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label (and one length) are compared with each other, all pairs in tiles of two
blocks.  Vectors are made unit length and turned into the axes of an uncentred PCA, so that
the leading dimensions carry most of every product.  A tile accumulates the products of the
leading dimensions for all its pairs; the rest of a product is at most the product of the two
suffix norms, so pairs whose bound stays below the threshold are dropped, dimension slice
by slice.  Survivors are decided by the cosine of the original vectors in double precision.
Blocks are sorted by the first axis; two blocks whose angles to that axis differ by more
than the threshold's angle are never paired.

Equal vectors of a label are one class from the start, compared once and counted by their
number.  A tile returns, per vector, its number of links and the smallest id that it reaches
inside the tile, not the links, so its output is linear in the block size.

The axes are fitted on at most ``sample`` vectors picked by hash; they change the
speed, never the result.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null label, link with nothing and are returned as their own component; vectors of
one label and different length are not compared; rows that repeat an id, label and vector are one vector and
each get its result; an id with several vectors or labels has a row and result for each, and doesn't link them; a null id is kept and sorts below all others; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.stage import components, partitions, staged

NO_ID = -(1 << 63)
BLOCK = 512
SLICES = 4
SLACK = 1e-9
SAMPLE = 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Length of vector -> orthonormal axes, largest second moment first."""
    out = {}
    for d in {len(v) for v in vectors}:
        x = unit(np.array([v for v in vectors if len(v) == d]))
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def tile_links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) with cosine >= threshold; i < j when both are one block."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ basis, ub @ basis
    cuts = np.linspace(0, a.shape[1], SLICES + 1).astype(int)
    rest = lambda r, c: np.sqrt(np.maximum((r[:, c:] ** 2).sum(axis=1), 0))
    c = cuts[1]
    s = ra[:, :c] @ rb[:, :c].T
    alive = s + np.outer(rest(ra, c), rest(rb, c)) >= threshold - SLACK
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    i, j = np.nonzero(alive)
    s = s[i, j]
    for lo, c in zip(cuts[1:], cuts[2:]):
        na, nb, keep = rest(ra, c), rest(rb, c), []
        for at in range(0, len(i), 1 << 16):  # bounded memory for the gathered rows
            x = slice(at, at + (1 << 16))
            s[x] += np.einsum("ij,ij->i", ra[i[x], lo:c], rb[j[x], lo:c])
        keep = s + na[i] * nb[j] >= threshold - SLACK
        i, j, s = i[keep], j[keep], s[keep]
    ok = np.zeros(len(i), bool)
    sa, sb = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    na, nb = np.sqrt((sa * sa).sum(axis=1)), np.sqrt((sb * sb).sum(axis=1))
    for at in range(0, len(i), 1 << 16):
        x = slice(at, at + (1 << 16))
        ok[x] = np.einsum("ij,ij->i", sa[i[x]], sb[j[x]]) / (na[i[x]] * nb[j[x]]) >= threshold
    return i[ok], j[ok]


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id in the component of each of n vectors under the links (i, j)."""
    low = ids.copy()
    while True:
        new = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        if np.array_equal(new, low):
            return low
        low = new


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding",
                         label_col: str = "label", block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                          F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(usable)
    # a class is a node of its own, so that an id with several vectors or labels joins nothing by itself
    classes = staged(good.distinct().groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
                     .withColumn("rep", F.monotonically_increasing_id()), "classes")
    picked = classes.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(sample).collect()
    basis = axes([np.array(r["v"]) for r in picked])

    def project(batches):
        for b in batches:
            first = np.zeros(b.num_rows)
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            start = np.concatenate([[0], np.cumsum(size)])
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = unit(flat[(start[at][:, None] + np.arange(d))])
                first[at] = x @ basis.get(int(d), np.eye(int(d)))[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size.astype(np.int32)), pa.array(np.arccos(np.clip(first, -1, 1)))],
                                             ["label", "v", "rep", "copies", "d", "angle"])

    def build(batches):
        kept: list[tuple] = []

        def out(part):
            v = np.array([x[3] for x in part])
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (uuid.uuid4().hex, part[0][0], part[0][1], part[0][2], part[-1][2])]
                + [pa.array([x.tobytes()], pa.binary()) for x in (np.array([x[4] for x in part], np.int64),
                                                                  np.array([x[5] for x in part], np.int64), v)],
                ["block", "label", "d", "lo", "hi", "ids", "copies", "vecs"])

        for b in batches:
            lists = b.column(1)
            o, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            o = o - o[0]
            cols = [b.column(k).to_pylist() for k in (0, 4, 5, 2, 3)]
            for r, (label, d, angle, rep, copies) in enumerate(zip(*cols)):
                if kept and (kept[-1][:2] != (label, d) or len(kept) >= block):
                    yield out(kept)
                    kept = []
                kept.append((label, d, angle, flat[o[r]:o[r + 1]], rep, copies))
        if kept:
            yield out(kept)

    axis = classes.select("label", "v", "rep", "copies").mapInArrow(project, "label string, v array<double>, rep bigint, copies bigint, d int, angle double")
    blocks = staged(axis.repartitionByRange(partitions(spark), "label", "d", "angle", "rep").sortWithinPartitions("label", "d", "angle", "rep")
                    .mapInArrow(build, "block string, label string, d bigint, lo double, hi double, ids binary, copies binary, vecs binary"), "blocks")
    limit = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    side = lambda k: blocks.select("label", "d", *(F.col(c).alias(f"{c}{k}") for c in ("block", "lo", "hi")))
    pairs = (side("a").join(side("b"), ["label", "d"])
             .filter((F.col("blocka") <= F.col("blockb")) & (F.col("lob") - F.col("hia") <= limit) & (F.col("loa") - F.col("hib") <= limit))
             .select(F.col("blocka").alias("x"), F.col("blockb").alias("y")))
    data = lambda k: blocks.select(F.col("block").alias(k), "d", F.col("ids").alias(f"ids_{k}"),
                                   F.col("copies").alias(f"copies_{k}"), F.col("vecs").alias(f"vecs_{k}"))

    def compare(batches):
        for b in batches:
            for x, y, d, *cells in zip(*(b.column(k).to_pylist() for k in range(9))):
                ia, ca, va, ib, cb, vb = cells
                ids = [np.frombuffer(c, np.int64) for c in (ia, ib)]
                copies = [np.frombuffer(c, np.int64) for c in (ca, cb)]
                va, vb = (np.frombuffer(c, np.float64).reshape(-1, d) for c in (va, vb))
                i, j = tile_links(va, vb, basis.get(d, np.eye(d)), threshold, x == y)
                if not len(i):
                    continue
                if x != y:
                    j = j + len(ids[0])
                    ids, copies = [np.concatenate(ids)], [np.concatenate(copies)]
                all_ids, n = ids[0], copies[0]
                got = np.bincount(i, n[j], len(n)) + np.bincount(j, n[i], len(n))
                low = smallest_reached(len(n), i, j, all_ids)
                use = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(all_ids[use]), pa.array(got[use].astype(np.int64)), pa.array(low[use])], ["id", "n", "low"])

    tiles = (pairs.join(data("x"), "x").join(data("y").drop("d"), "y")
             .select("x", "y", "d", "ids_x", "copies_x", "vecs_x", "ids_y", "copies_y", "vecs_y"))
    found = staged(tiles.mapInArrow(compare, "id bigint, n bigint, low bigint"), "tiles")
    groups = staged(components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))), "groups")
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    least = groups.join(classes.select("rep", "least"), F.col("id") == F.col("rep")).groupBy("component").agg(F.min("least").alias("c"))
    of_class = groups.join(least, "component").select(F.col("id").alias("member"), "c")
    named = classes.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(of_class, F.col("rep") == F.col("member"), "left")
    named = staged(named.select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                                F.coalesce("c", "least").alias("c")), "named")
    out = (good.join(named, ["label", "v"]).select("id", "n_links", "c")
           .unionAll(rows.filter(~usable).select("id", F.lit(0).cast("long"), F.col("id"))))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias("vec_id"), "n_links", back("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def oracle(table: str = "embeddings", threshold: float = 0.93) -> str:
    """DuckDB SQL for embedding_duplicates() over columns vec_id, embedding, label."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {table}),
g AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {threshold}),
r(id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id AND r.c < l.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN m ON m.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""
