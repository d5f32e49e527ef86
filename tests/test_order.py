"""Global numbering, prefix sums, quantiles, ROC-AUC and approximate neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.operators import learn as ln
from demandlens.operators import order as od
from demandlens.operators import vectors as vx
from tests.plan_checks import assert_plan_shape


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_global_index_numbers_all_rows(spark, partitions):
    rows = [(k % 5, k, "x" * (k % 3)) for k in range(211)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, index_ string").repartition(6)
    got = od.global_index(df, ["a", "b"], "at", partitions)
    assert_plan_shape("global_index", got)
    assert [(r["a"], r["b"]) for r in sorted(got.collect(), key=lambda r: r["at"])] == sorted((a, b) for a, b, _ in rows)
    assert sorted(r["at"] for r in got.collect()) == list(range(211))
    assert od.global_index(df.limit(0), ["a", "b"]).count() == 0


def test_offsets_over_more_partitions_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(od, "OFFSET_GROUP", 3)
    df = spark.createDataFrame([(k,) for k in range(300)], "k int")
    got = od.prefix_sums(df, ["k"], {"k": F.col("k"), "n": F.lit(1)}, partitions=16).collect()
    assert all(r["before_k"] == r["k"] * (r["k"] - 1) // 2 and r["before_n"] == r["k"] for r in got)


@pytest.mark.parametrize("partitions", [1, 5, None])
def test_quantiles_match_numpy(spark, partitions):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(size=200) * 1e6, np.zeros(150), [-1e-9, 1e300, -1e300]])   # one value holds many rows
    rows = [(float(x), None if k % 3 else int(k % 7), None) for k, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(4)
    wanted = {"a": [0.0, 0.25, 0.5, 0.65, 0.999, 1.0], "b": [0.5, 0.9], "c": [0.5]}
    q = od.quantiles(df, wanted, partitions)
    assert_plan_shape("quantiles", q)
    got = {(r["col"], r["q"]): r["value"] for r in q.collect()}
    b = [r[1] for r in rows if r[1] is not None]
    for (c, p), v in got.items():
        want = None if c == "c" else np.quantile(a if c == "a" else b, p)
        assert v is None and want is None or v == pytest.approx(want, rel=1e-12)
    assert len(got) == 9
    assert od.quantiles(df.limit(0), {"a": [0.5]}).collect()[0]["value"] is None


def test_quantiles_keep_no_buffer_of_all_values(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = od.quantiles(df, {"x": [0.5]}, 4)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list(x" not in plan


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_groups(spark):
    rnd = random.Random(3)
    rows = [(g, rnd.randrange(6) / 5, rnd.randrange(2)) for g in ("a", "b") for _ in range(80)]
    rows += [("one class", 0.3, 1)] * 4 + [("a", 0.4, 0)] * 200   # a score that most rows hold
    df = spark.createDataFrame(rows, "g string, s double, label int").repartition(5)
    got = {r["g"]: r["auc"] for r in ln.roc_auc(df, "s", by="g").collect()}
    for g in ("a", "b", "one class"):
        want = brute_auc([(s, y) for h, s, y in rows if h == g])
        assert got[g] is None and want is None or got[g] == pytest.approx(want, abs=1e-12)
    whole = ln.roc_auc(df, "s").collect()[0]
    assert whole["auc"] == pytest.approx(brute_auc([(s, y) for _, s, y in rows]), abs=1e-12)
    assert whole["n_positive"] + whole["n_negative"] == len(rows)


def exact_top(ids, x, n):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i, a in enumerate(ids):
        near = sorted((-round(s[i, j], 9), b) for j, b in enumerate(ids) if j != i)[:n]
        out[a] = [b for _, b in near]
    return out


def found_top(df, n):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["lid"], []).append(r["rid"])
    assert all(len(v) <= n for v in out.values())
    return out


def test_all_probes_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12))
    ids = [f"{k:03d}" for k in range(90)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<double>")
    got = vx.approx_pairs(df, "id", n=3, tables=1, probes=64, bucket_rows=20)   # 2 bits, every bucket probed
    assert_plan_shape("approx_pairs", got)
    assert found_top(got, 3) == exact_top(ids, x, 3)


def test_close_vectors_are_found_in_few_probes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 24))
    x = np.repeat(centres, 5, 0) + 0.05 * rng.normal(size=(300, 24))
    ids = [f"{k:03d}" for k in range(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, embedding array<double>")
    got, want = found_top(vx.approx_pairs(df, "id", n=4, tables=4, probes=4, bucket_rows=10), 4), exact_top(ids, x, 4)
    assert sum(len(set(got.get(i, [])) & set(want[i])) for i in ids) / 1200 > 0.95


@pytest.mark.parametrize("block_rows", [2048, 16])
def test_hot_vector_and_odd_rows(spark, block_rows):
    rng = np.random.default_rng(6)
    rows = [(f"h{k:02d}", [1.0, 2.0, 0.5]) for k in range(40)] + [(f"v{k:02d}", rng.normal(size=3).tolist()) for k in range(60)]
    odd = [("null", None), ("empty", []), ("zero", [0.0, 0.0, 0.0]), ("other", [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "id string, embedding array<double>")
    got = found_top(vx.approx_pairs(df, "id", n=2, tables=2, probes=64, bucket_rows=30, block_rows=block_rows), 2)
    assert got["h00"] == ["h01", "h02"] and got["h01"] == ["h00", "h02"] and got["h39"] == ["h00", "h01"]
    assert "null" not in got and "empty" not in got
    assert sum(len(got[i]) == 2 for i, _ in rows) == len(rows)


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_search_in_place_equals_blocks(spark, bytes_, monkeypatch):
    monkeypatch.setattr(vx, "MAX_QUERY_BYTES", bytes_)
    rng = np.random.default_rng(8)
    cards = [(f"c{k:03d}", "xyz"[k % 3], rng.normal(size=6).round(3).tolist()) for k in range(150)] + [("zero", "x", [0.0] * 6)]
    queries = [(f"q{k}", "xyw"[k % 3], rng.normal(size=6).round(3).tolist()) for k in range(12)]
    c = spark.createDataFrame(cards, "id string, type string, embedding array<float>").repartition(5)
    q = spark.createDataFrame(queries, "query_id string, type string, query_vec array<float>")
    for typed in (None, "type"):
        got = {}
        for r in sorted(vx.search(q, c, 4, type_col=typed, card_block_rows=40, query_block_rows=5).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append((r["id"], round(r["distance"], 5)))
        for i, t, v in queries:
            def distance(w):
                n = np.linalg.norm(v) * np.linalg.norm(w)
                return round(1 - (np.dot(v, w) / n if n else 0.0), 5)
            want = sorted((distance(w), j) for j, u, w in cards if typed is None or u == t)[:4]
            assert got.get(i, []) == [(j, d) for d, j in want], (i, typed)
    assert vx.search(q.limit(0), c, 3).count() == 0 and vx.search(q, c.limit(0), 3).count() == 0
