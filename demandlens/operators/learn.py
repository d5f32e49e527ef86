"""Labels, splits, classifiers and evaluation.

Splits and folds are seeded hashes of the row key (md5 prefix as a number),
so they are deterministic, need no sort and no global window, and an SQL
engine can reproduce them.  Models are MLlib estimators; evaluation is
aggregation: confusion cells per threshold, ROC-AUC from prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: model and evaluation settings
TEST_FRACTION = 0.25
N_FOLDS = 5
SEED = 42
THRESHOLDS = [round(0.20 + 0.05 * i, 2) for i in range(10)]     # 0.20 .. 0.65
BASE_FEATURES = ["freq", "trend_slope", "recency_weight", "velocity", "company_spread_norm",
                 "upcoming_flag", "provider_gap", "volatility", "company_spread", "taught_count"]
RF_PARAMS = dict(numTrees=200, maxDepth=6, minInstancesPerNode=2)
GBT_PARAMS = dict(maxIter=200, maxDepth=4, stepSize=0.05)


def check_columns(df: DataFrame, required: list[str], optional_prefixes: tuple[str, ...] = ()) -> list[str]:
    """L3: fail when a required column is missing; return required + optional-by-prefix columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    extra = [c for c in df.columns if optional_prefixes and c.startswith(optional_prefixes)]
    return list(required) + [c for c in extra if c not in required]


def hash_unit(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from md5(key:seed): first 32 bits / 2^32."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    return h.cast("long") / F.lit(4294967296.0)


def class_rank(df: DataFrame, key: str, label: str = "label", seed: int = SEED, buckets: int = 1024) -> DataFrame:
    """``_rank`` (from 0) and ``_n`` of every row inside its class, in the order of hash_unit(key).

    The class is cut into ``buckets`` ranges of the hash; a window ranks inside a range, and the
    ranges' offsets come from their counts (classes x buckets rows).  No window holds a whole class.
    """
    from pyspark.sql import Window

    x = (df.withColumn("_h", hash_unit(F.col(key), seed))
         .withColumn("_bk", F.least(F.floor(F.col("_h") * buckets), F.lit(buckets - 1)).cast("int")))
    counts = x.groupBy(F.col(label).alias("_l"), F.col("_bk").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_l").orderBy("_b")
    offs = counts.select("_l", "_b", (F.sum("_c").over(w) - F.col("_c")).alias("_off"),
                         F.sum("_c").over(Window.partitionBy("_l")).alias("_n"))
    inside = Window.partitionBy(label, "_bk").orderBy("_h", key)
    return (x.withColumn("_i", F.row_number().over(inside) - 1)
            .join(offs, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_bk") == F.col("_b")))
            .withColumn("_rank", F.col("_off") + F.col("_i")).drop("_h", "_bk", "_l", "_b", "_off", "_i"))


def stratified_split(df: DataFrame, key: str, label: str = "label", test_fraction: float = TEST_FRACTION,
                     seed: int = SEED) -> DataFrame:
    """L4: ``is_test`` = the first test_fraction of every class in hash order."""
    r = class_rank(df, key, label, seed)
    return r.withColumn("is_test", (F.col("_rank") < F.col("_n") * test_fraction).cast("int")).drop("_rank", "_n")


def fold_of(df: DataFrame, key: str, n_folds: int = N_FOLDS, seed: int = SEED, label: str = "label") -> DataFrame:
    """fold = rank in hash order inside the class, modulo n_folds: classes spread evenly."""
    r = class_rank(df, key, label, seed)
    return r.withColumn("fold", (F.col("_rank") % n_folds).cast("int")).drop("_rank", "_n")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (k · n_class) per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    n = df.select(F.count(F.lit(1))).scalar()
    k = df.select(F.count_distinct(label)).scalar()
    return per.withColumn("weight", n / (k * F.col("n_class")))


def with_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return df.join(w, label, "left")


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    check_columns(df, features)
    cast = df.select(*[c for c in df.columns if c not in features],
                     *[F.col(c).cast("double").alias(c) for c in features])
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(cast)


def fit_forest(train: DataFrame, features: list[str], label: str = "label", seed: int = SEED,
               weighted: bool = True, **params):
    """Random forest (200 trees, depth 6, ≥2 rows per leaf), balanced class weights."""
    from pyspark.ml.classification import RandomForestClassifier

    p = dict(RF_PARAMS)
    p.update(params)
    data = assemble(with_weights(train, label) if weighted else train, features)
    if weighted:
        p["weightCol"] = "weight"
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, **p)
    return rf.fit(data.withColumn(label, F.col(label).cast("double")))


def fit_gbt(train: DataFrame, features: list[str], label: str = "label", seed: int = SEED, **params):
    """Gradient-boosted trees, positive rows weighted n0/n1 (1 where one of the classes has no rows)."""
    from pyspark.ml.classification import GBTClassifier

    p = dict(GBT_PARAMS)
    p.update(params)
    counts = train.groupBy().agg(F.count_if(F.col(label) == 0).alias("n0"),
                                 F.count_if(F.col(label) == 1).alias("n1"))
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    ratio = counts.select(F.when(both, F.col("n0") / F.col("n1")).otherwise(F.lit(1.0)).alias("r")).scalar()
    data = assemble(train.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0))),
                    features)
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, weightCol="weight", **p)
    return gbt.fit(data.withColumn(label, F.col(label).cast("double")))


def positive_probability(model, df: DataFrame, features: list[str], out: str = "prob") -> DataFrame:
    """Score rows; ``out`` = P(class 1), 0 by a model that has seen class 0 only (its vector has one entry)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(assemble(df, features))
    return scored.withColumn(out, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))).drop(
        "features", "rawPrediction", "probability", "prediction")


def out_of_fold(df: DataFrame, key: str, features: list[str], label: str = "label",
                n_folds: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Every row scored once, by the model fitted on the other folds."""
    f = fold_of(df, key, n_folds, seed)
    parts = []
    for k in range(n_folds):
        m = fit_forest(f.where(F.col("fold") != k), features, label, seed)
        parts.append(positive_probability(m, f.where(F.col("fold") == k), features))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threshold_sweep(df: DataFrame, score: str, label: str = "label",
                    thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall, F1 at every threshold (zero division → 0).

    The thresholds are a literal array exploded per row, then one grouped
    aggregation of the four confusion cells.
    """
    ts = F.array(*[F.lit(float(t)) for t in (thresholds or THRESHOLDS)])
    x = df.select(F.col(label).alias("_y"), F.col(score).alias("_s"), F.explode(ts).alias("threshold"))
    pred = F.col("_s") >= F.col("threshold")
    cells = x.groupBy("threshold").agg(
        F.count_if(pred & (F.col("_y") == 1)).alias("tp"),
        F.count_if(pred & (F.col("_y") == 0)).alias("fp"),
        F.count_if(~pred & (F.col("_y") == 1)).alias("fn"),
        F.count_if(~pred & (F.col("_y") == 0)).alias("tn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    out = cells.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                       2 * F.col("precision") * F.col("recall")
                                       / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the largest F1, the smallest threshold on ties."""
    return sweep.agg(F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                              F.struct("f1", -F.col("threshold"))).alias("b")).select("b.*")


def confusion(df: DataFrame, score: str, threshold: float | Column, label: str = "label") -> DataFrame:
    """The four cells (actual, predicted, n), zeros included."""
    pred = (F.col(score) >= threshold).cast("int")
    c = df.select(F.col(label).cast("int").alias("actual"), pred.alias("predicted"))
    return c.groupBy().agg(*[
        F.count_if((F.col("actual") == a) & (F.col("predicted") == p)).alias(f"n_{a}{p}")
        for a in (0, 1) for p in (0, 1)])


def classification_report(cells: DataFrame) -> DataFrame:
    """Per-class precision / recall / F1 / support, macro and weighted means, accuracy."""
    def prf(tp, fp, fn):
        p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        return p, r, f
    n00, n01, n10, n11 = (F.col(c) for c in ("n_00", "n_01", "n_10", "n_11"))
    p1, r1, f1 = prf(n11, n01, n10)
    p0, r0, f0 = prf(n00, n10, n01)
    s0, s1 = n00 + n01, n10 + n11
    tot = s0 + s1
    return cells.select(
        *cells.columns, p0.alias("precision_0"), r0.alias("recall_0"), f0.alias("f1_0"), s0.alias("support_0"),
        p1.alias("precision_1"), r1.alias("recall_1"), f1.alias("f1_1"), s1.alias("support_1"),
        *(e for name, x0, x1 in (("precision", p0, p1), ("recall", r0, r1), ("f1", f0, f1))
          for e in (((x0 + x1) / 2).alias(f"macro_{name}"), ((x0 * s0 + x1 * s1) / tot).alias(f"weighted_{name}"))),
        ((n00 + n11) / tot).alias("accuracy"))


def roc_auc(df: DataFrame, score: str, label: str = "label", by: str | None = None) -> DataFrame:
    """Exact ROC-AUC, one row ``([by,] n_negative, n_positive, auc)``; null with one class only.

    Rows are counted per distinct score (partial aggregation); prefix sums over the sorted scores
    give every score the negatives below it, and negatives of the same score count one half.  ``by`` names
    a column of groups (folds, models): all are ranked in one pass, each from its own first negative.
    """
    from demandlens.operators.order import prefix_sums

    keys = [by] if by else []
    y = F.col(label).cast("int")
    per = df.select(*keys, F.col(score).cast("double").alias("_s"), y.alias("_y")).groupBy(*keys, "_s").agg(
        F.count_if(F.col("_y") == 0).alias("n0"), F.count_if(F.col("_y") == 1).alias("n1"))
    at = prefix_sums(per, [*keys, "_s"], {"n0": F.col("n0")})
    wins = F.sum(F.col("n1").cast("decimal(19, 0)") * (2 * F.col("before_n0") + F.col("n0")).cast("decimal(19, 0)"))
    tot = at.groupBy(*keys).agg(F.sum("n0").alias("n_negative"), F.sum("n1").alias("n_positive"),
                                F.min("before_n0").alias("_first"), wins.alias("_wins"))
    both = F.col("n_negative").cast("double") * F.col("n_positive")
    own = F.col("_wins").cast("double") / 2 - F.col("_first").cast("double") * F.col("n_positive")
    return tot.select(*keys, "n_negative", "n_positive", F.when(both > 0, own / both).alias("auc"))


def feature_importance(model, features: list[str], text_prefixes: tuple[str, ...] = ()) -> list[tuple]:
    """(feature, importance, is_text) sorted desc; model-sized, built from the fitted model."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda x: (-x[1], x[0]))
    return [(f, float(v), bool(text_prefixes) and f.startswith(text_prefixes)) for f, v in rows]


def importance_table(spark, model, features: list[str], text_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(rank, feature, importance, is_text, text_share): one row per feature, and the share of all
    importance that the text features carry."""
    rows = feature_importance(model, features, text_prefixes)
    df = spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], "rank int, feature string, importance double, is_text boolean")
    share = df.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("is_text"), F.col("importance"))), F.sum("importance")), F.lit(0.0))).scalar()
    return df.withColumn("text_share", share)


def evaluate_model(model, test: DataFrame, features: list[str], label: str = "label") -> dict:
    """Test-split AUC (L15) and the best threshold of the sweep (L11, L12) of one fitted model."""
    from demandlens.session import materialize

    p = materialize(positive_probability(model, test, features).select(label, "prob"))
    b = best_threshold(threshold_sweep(p, "prob", label)).first()
    return {"auc": roc_auc(p, "prob", label).first()["auc"], "best_threshold": b["threshold"], "best_f1": b["f1"],
            "precision": b["precision"], "recall": b["recall"]}


def compare_models(train: DataFrame, test: DataFrame, feature_sets: dict[str, list[str]],
                   label: str = "label", seed: int = SEED, **params) -> DataFrame:
    """One forest per feature set, evaluated on the same test split.

    The table has one row per feature set (a handful): name, AUC, best
    threshold and F1, the share of importance carried by the features that
    are not in the first set, and the top feature."""
    spark = train.sparkSession
    names = list(feature_sets)
    base = set(feature_sets[names[0]])
    rows = []
    for name in names:
        feats = check_columns(train, feature_sets[name])
        m = fit_forest(train, feats, label, seed, **params)
        ev = evaluate_model(m, test, feats, label)
        imp = feature_importance(m, feats)
        extra = sum(v for f, v, _ in imp if f not in base)
        rows.append((name, len(feats), ev["auc"], float(ev["best_threshold"]), float(ev["best_f1"]),
                     float(extra), imp[0][0]))
    return spark.createDataFrame(rows, "feature_set string, n_features int, auc double, best_threshold double, "
                                       "best_f1 double, added_importance double, top_feature string")


def balanced_training(train: DataFrame, key: str, features: list[str], label: str = "label", k: int = 3, seed: int = SEED) -> tuple[DataFrame, bool]:
    """L9 for a fit: SMOTE rows where the smaller class has more than ``k`` rows, else the rows themselves, to be
    weighted; and which of the two it was."""
    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    rows = train.select(key, label, *[F.col(c).cast("double").alias(c) for c in features])
    if n["classes"] < 2 or n["n"] <= k:
        return rows, False
    return smote(rows, key, features, label, k=k, seed=seed), True


def select_model(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str = "label", seed: int = SEED,
                 forest: dict | None = None, boosted: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """L6 + L7 + L9 + L12: forest and boosted trees fitted on the same balanced rows, judged on the same test rows.

    Returns (models, predictions).  ``models`` has a row per model (n_train, synthetic rows, AUC, best
    threshold of the sweep with its F1, precision, recall, winner); the boosted trees win only by a
    strictly greater F1.  ``predictions`` (model, key, label, prob) is written once; every metric is computed from it.
    """
    from functools import reduce

    from demandlens.session import materialize

    spark = train.sparkSession
    rows, smoted = balanced_training(train, key, features, label, seed=seed)
    rows = materialize(rows)
    n_train = rows.count()
    n_new = rows.where("synthetic = 1").count() if smoted else 0
    fitted = {"forest": fit_forest(rows, features, label, seed, weighted=not smoted, **(forest or {})),
              "boosted": fit_gbt(rows, features, label, seed, **(boosted or {}))}
    scored = [positive_probability(m, test, features).select(F.lit(name).alias("model"), key, label, "prob") for name, m in fitted.items()]
    predictions = materialize(reduce(DataFrame.unionByName, scored))
    auc = {r["model"]: r["auc"] for r in roc_auc(predictions, "prob", label, by="model").collect()}   # a row per model
    found = {name: best_threshold(threshold_sweep(predictions.where(F.col("model") == name), "prob", label)).first() for name in fitted}
    winner = "boosted" if found["boosted"]["f1"] > found["forest"]["f1"] else "forest"
    table = [(name, n_train, n_new, auc.get(name), float(b["threshold"]), float(b["f1"]), float(b["precision"]), float(b["recall"]), name == winner)
             for name, b in found.items()]
    return spark.createDataFrame(table, "model string, n_train long, n_synthetic long, auc double, best_threshold double, best_f1 double, "
                                        "precision double, recall double, winner boolean"), predictions


def smote(df: DataFrame, key: str, features: list[str], label: str = "label", k: int = 3,
          seed: int = SEED, block_rows: int = 4096) -> DataFrame:
    """Oversample the minority class to the majority size (SMOTE).

    Each synthetic row takes a minority row x (row i gets ⌊need/n⌋ rows, the
    first need mod n rows in hash order one more), one of x's min(k, n - 1) nearest
    minority neighbours z (Euclidean, blocked exact search) chosen by hash,
    and u ∈ [0, 1) from a hash: x + u·(z − x).  Returns the input rows plus
    the synthetic ones (key ``<key>#s<j>``, ``synthetic`` = 1).  A single
    minority row is its own neighbour, so its synthetic rows are copies.
    """
    import math

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(0))
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    need = n_maj - n_min
    base = df.withColumn("synthetic", F.lit(0))
    if need == 0:
        return base
    mino = df.where(F.col(label) == minority).select(
        F.col(key).cast("string").alias("_id"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("_v"))
    nb = max(1, math.ceil(n_min / block_rows))
    from demandlens.operators.vectors import blocked_topk

    knn = blocked_topk(mino, mino, max(1, min(k, n_min - 1)), nb, nb, exclude_self=n_min > 1, metric="euclidean")
    nbrs = knn.groupBy(F.col("lid").alias("_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "rid"))), lambda x: x["rid"]).alias("_nb"))
    q, r = divmod(need, n_min)
    ranked = class_rank(mino.withColumn("_class", F.lit(0)), "_id", "_class", seed, max(1, math.isqrt(n_min))).drop("_class", "_n")
    copies = F.lit(q) + (F.col("_rank") < r).cast("int")
    syn = (ranked.join(nbrs, "_id")
           .withColumn("_j", F.explode(F.sequence(F.lit(1), copies)))
           .where(copies > 0))
    tag = F.concat_ws("#", "_id", F.col("_j").cast("string"))
    pick = F.element_at("_nb", (F.pmod(F.xxhash64(tag, F.lit(seed)), F.size("_nb")) + 1).cast("int"))
    syn = syn.withColumn("_z", pick).withColumn("_u", hash_unit(tag, seed + 1))
    zv = mino.select(F.col("_id").alias("_z"), F.col("_v").alias("_zv"))
    syn = syn.join(zv, "_z")
    cols = {c: F.col("_v")[i] + F.col("_u") * (F.col("_zv")[i] - F.col("_v")[i]) for i, c in enumerate(features)}
    out = syn.select(F.concat(F.col("_id"), F.lit("#s"), F.col("_j").cast("string")).alias(key),
                     *[v.alias(c) for c, v in cols.items()], F.lit(minority).alias(label),
                     F.lit(1).alias("synthetic"))
    return base.select(key, *features, label, "synthetic").unionByName(
        out.select(*[F.col(c).cast(base.schema[c].dataType) if c in (key, label) else F.col(c)
                     for c in [key, *features, label]], "synthetic"))
