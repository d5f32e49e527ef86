"""Model selection, importances, one-hots, CSV rejects and change points on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.operators import features as fe
from demandlens.operators import learn as ln
from demandlens.plans.q_learn import model_properties
from demandlens.sources import files

SMALL = dict(forest={"numTrees": 10}, boosted={"maxIter": 3})


def frame(spark, n=120, positives=25, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.argsort(np.argsort(-(x[:, 0] + 0.3 * rng.normal(size=n)))) < positives
    return spark.createDataFrame([(f"i{k:03d}", int(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(n)], "item string, label int, a double, b double")


def test_model_selection_on_smote_rows(spark):
    f = ln.stratified_split(frame(spark), "item")
    train, test = f.where("is_test = 0"), f.where("is_test = 1")
    models, predictions = ln.select_model(train, test, "item", ["a", "b"], **SMALL)
    rows = {r["model"]: r for r in models.collect()}
    n0, n1 = train.where("label = 0").count(), train.where("label = 1").count()
    assert all(r["n_train"] == 2 * n0 and r["n_synthetic"] == n0 - n1 for r in rows.values())
    assert sum(r["winner"] for r in rows.values()) == 1
    assert rows["boosted"]["winner"] == (rows["boosted"]["best_f1"] > rows["forest"]["best_f1"])
    for r in model_properties(models, predictions, test).collect():
        assert r["each_row_once"] and r["probabilities"] and r["metrics_agree"] and r["n_test"] == test.count()


def test_model_selection_with_few_positives_uses_weights(spark):
    f = frame(spark, 60, 3).withColumn("is_test", (F.col("item") > "i040").cast("int"))
    train = f.where("is_test = 0 OR label = 1")
    models, _ = ln.select_model(train, f.where("is_test = 1"), "item", ["a", "b"], **SMALL)
    assert all(r["n_synthetic"] == 0 and r["n_train"] == train.count() for r in models.collect())


def test_equal_scores_leave_the_forest_the_winner(spark, monkeypatch):
    forest = ln.fit_forest(frame(spark), ["a", "b"], numTrees=5)
    monkeypatch.setattr(ln, "fit_gbt", lambda *a, **k: forest)
    monkeypatch.setattr(ln, "fit_forest", lambda *a, **k: forest)
    f = ln.stratified_split(frame(spark), "item")
    models, _ = ln.select_model(f.where("is_test = 0"), f.where("is_test = 1"), "item", ["a", "b"])
    assert {r["model"]: r["winner"] for r in models.collect()} == {"forest": True, "boosted": False}


def test_missing_feature_is_named(spark):
    with pytest.raises(ValueError, match="nowhere"):
        ln.fit_forest(frame(spark), ["a", "nowhere"], numTrees=2)


def test_importance_table(spark):
    rf = ln.fit_forest(frame(spark), ["a", "b"], numTrees=10)
    t = ln.importance_table(spark, rf, ["a", "b"], ("b",)).orderBy("rank").collect()
    assert [r["feature"] for r in t] == ["a", "b"] and [r["is_text"] for r in t] == [False, True]
    assert t[0]["text_share"] == pytest.approx(t[1]["importance"])


def test_one_hots_declared_found_and_sparse(spark):
    df = spark.createDataFrame([("x", "a", 1), ("y", "b/c d", 2), ("z", None, 3), ("w", "a", 4)], "item string, kind string, n int")
    assert fe.categories_of(df, "kind") == ["a", "b/c d"]
    with pytest.raises(ValueError):
        fe.categories_of(df, "item", limit=3)
    wide = {r["item"]: r for r in fe.one_hot(df, "kind", ["a", "b/c d", "unseen"]).collect()}
    assert [wide[i]["kind_a"] for i in "xyzw"] == [True, False, False, True] and not any(r["kind_unseen"] for r in wide.values())
    vectors, names = fe.feature_vectors(df, ["n"], ["kind"])
    assert names == ["n", "kind_a", "kind_b/c d", "kind___unknown"]
    got = {r["item"]: r["features"].toArray().tolist() for r in vectors.collect()}
    assert got == {"x": [1, 1, 0, 0], "y": [2, 0, 1, 0], "z": [3, 0, 0, 1], "w": [4, 1, 0, 0]}


def test_csv_rejects(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Company,Year,Role,Skill,Skill_Type\nAcme,2024,Dev, SQL ,UPCOMING\nB, 2023 ,Ops,x,\n"
                                    "C,n/a,Ops,y,T\nD,2020,Ops,  ,T\nonly,two\nE,1,2,3,4,5\n\"F, G\",2021,R,\"a, b\",upcoming\n")
    rows, rejected = files.demand_with_rejects(spark, str(tmp_path / "d.csv"))
    assert sorted((r["company"], r["year"], r["item"], r["upcoming_flag"]) for r in rows.collect()) == [
        ("Acme", 2024, "sql", 1), ("B", 2023, "x", 0), ("F, G", 2021, "a, b", 1)]
    assert sorted((r["reason"], r["line"]) for r in rejected.collect()) == [
        ("fields", "E,1,2,3,4,5"), ("fields", "only,two"), ("item", "D,2020,Ops,\"\",T"), ("year", "C,n/a,Ops,y,T")]
    (tmp_path / "c.csv").write_text("Institute,Semester,Course,Skill\n A ,5, Net ,TCP\nB,,M,Algebra\nC,five,M,Z\nD,1,M,\n")
    rows, rejected = files.coverage_with_rejects(spark, str(tmp_path / "c.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 5, "Net", "tcp"), ("b", 0, "M", "algebra")]
    assert sorted(r["reason"] for r in rejected.collect()) == ["item", "semester"]
    (tmp_path / "empty.csv").write_text("Institute,Semester,Course,Skill\n")
    assert [x.count() for x in files.coverage_with_rejects(spark, str(tmp_path / "empty.csv"))] == [0, 0]


def brute_change(y, penalty, min_size, jump):
    n = len(y)
    d = (np.array(y, float)[:, None] - np.array(y, float)[None]) ** 2
    w = np.median(d[np.triu_indices(n, 1)]) if n > 1 else 0
    g = np.exp(-d / (w if w > 0 else 1))
    cost = lambda a, b: round((b - a) - g[a:b, a:b].sum() / (b - a), 9)
    best = None

    def walk(at, v, ends):
        nonlocal best
        if at == n:
            key = (v, [0, *ends[:-1]][::-1], ends[0])
            best = min(best, key) if best else key
            return
        for b in range(at + min_size, n + 1):
            if b % jump == 0 or b == n:
                walk(b, round(v + cost(at, b) + penalty, 9), [*ends, b])

    walk(0, 0.0, [])
    return best[2] if best and best[2] < n else None


@pytest.mark.parametrize("penalty,min_size,jump", [(1.0, 2, 1), (0.2, 1, 1), (0.3, 2, 2), (5.0, 2, 1), (1.0, 9, 1)])
def test_change_points_match_every_partition(spark, penalty, min_size, jump):
    rng = np.random.default_rng(int(penalty * 10))
    series = {f"i{k}": [int(v) for v in rng.integers(0, 9, 7)] for k in range(25)}
    series |= {"flat": [3] * 7, "shift": [1, 1, 1, 9, 9, 9, 9], "one": [0, 0, 0, 4, 0, 0, 0]}
    rows = [(i, 2000 + t, "c", "T", v, 0) for i, ys in series.items() for t, v in enumerate(ys) if v]
    cube = spark.createDataFrame(rows, "item string, year int, company string, item_type string, n long, upcoming int")
    got = {r["item"]: r["change_year"] for r in fe.change_point_years(cube, 2000, 2006, penalty, min_size, jump).collect()}
    threshold = {r["item"]: r["threshold_year"] for r in fe.item_trends(cube).select("item", "threshold_year").collect()}
    assert got.keys() == threshold.keys()
    for i, year in got.items():
        first = brute_change(series[i], penalty, min_size, jump)
        assert year == (2000 + first - 1 if first else threshold[i]), i


def test_correlations_of_constant_columns(spark):
    from demandlens.plans.q_profile import correlations

    rows = [(1.0, 0.1, None, 3.0), (2.0, 0.1, None, 1.0), (4.0, 0.1, None, 2.0), (9.0, 0.1, None, None)]
    df = spark.createDataFrame(rows, "a double, k double, nothing double, b double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlations(df, ["a", "k", "nothing", "b"]).collect()}
    assert np.isnan(got["a", "k"]) and np.isnan(got["k", "b"]) and got["a", "nothing"] is None
    assert got["a", "b"] == pytest.approx(np.corrcoef([1, 2, 4], [3, 1, 2])[0, 1], abs=1e-12)


def one_class(spark, label=0):
    return frame(spark, 40, 10).withColumn("label", F.lit(label))


@pytest.mark.parametrize("label", [0, 1])
def test_out_of_fold_with_one_class(spark, monkeypatch, label):
    monkeypatch.setitem(ln.RF_PARAMS, "numTrees", 3)
    got = ln.out_of_fold(one_class(spark, label), "item", ["a", "b"]).collect()
    assert len(got) == 40 and {r["prob"] for r in got} == {float(label)}


def test_model_comparison_with_one_class(spark):
    got = ln.compare_models(one_class(spark), one_class(spark), {"a": ["a"], "ab": ["a", "b"]}, numTrees=3).collect()
    assert [(r["feature_set"], r["auc"], r["best_f1"]) for r in got] == [("a", None, 0.0), ("ab", None, 0.0)]


@pytest.mark.parametrize("label", [0, 1])
def test_model_selection_with_one_class(spark, label):
    f = one_class(spark, label)
    models, predictions = ln.select_model(f, f, "item", ["a", "b"], **SMALL)
    assert all(r["auc"] is None and r["n_synthetic"] == 0 and r["n_train"] == 40 for r in models.collect())
    for r in model_properties(models, predictions, f).collect():
        assert r["each_row_once"] and r["probabilities"] and r["metrics_agree"]


def test_oof_checks_with_one_class(spark, monkeypatch):
    from demandlens.plans import q_learn as ql

    p = one_class(spark).select("item", F.lit(0).alias("fold"), "label", F.lit(0.0).alias("prob"))
    monkeypatch.setattr(ql, "oof_probabilities", lambda *a: p)
    (r,) = ql.oof_checks(spark, "").collect()
    assert r["n_items"] == 40 and r["each_row_once"] and r["probabilities"] and r["better_than_chance"]


def test_model_selection_query_runs_all_boosting_rounds(spark, monkeypatch):
    from demandlens.plans import q_learn as ql

    f = frame(spark, 40, 12).select("item", "label", *[(F.col("a") + i * F.col("b")).alias(c) for i, c in enumerate(ln.BASE_FEATURES)])
    fit, rounds = ln.fit_gbt, []

    def few(train, features, label="label", seed=ln.SEED, **params):
        rounds.append(params.get("maxIter", ln.GBT_PARAMS["maxIter"]))
        return fit(train, features, label, seed, **{**params, "maxIter": 2})

    monkeypatch.setattr(ql, "_training_table", lambda *a: f)
    monkeypatch.setattr(ln, "fit_gbt", few)
    monkeypatch.setitem(ln.RF_PARAMS, "numTrees", 5)
    assert ql.model_selection(spark, "").count() == 2 and rounds == [200]
