"""Rules, lemmas and synonyms as tables, chunks across files, sketches and the versioned collection."""

import random

import pytest
from pyspark.sql import functions as F

from demandlens.operators import collection as cl
from demandlens.operators import extract as ex
from demandlens.operators import rules as ru
from demandlens.operators import sketches as sk
from demandlens.operators import text as tx
from tests.plan_checks import assert_plan_shape


def brute_rules(texts, rules):
    out = {}
    for i, t in texts:
        hits = sorted((r, d, k) for d, r, k in rules if k and t is not None and k in t.lower())
        if hits:
            out[i] = hits[0]
    return out


@pytest.mark.parametrize("n_rules", [6, 10_000])
def test_rules_match_brute_force(spark, n_rules):
    rnd = random.Random(n_rules)
    word = lambda k: "".join(rnd.choice("abcde ") for _ in range(k))
    rules = [(f"d{rnd.randrange(20)}", rnd.randrange(n_rules), word(rnd.randrange(1, 9))) for _ in range(n_rules)]
    rules += [("none", 0, ""), ("null", 0, None), ("short", 1, "é"), ("long", 0, "x" * 40), ("same", 2, "abc"), ("same too", 2, "abc")]
    texts = [(k, word(rnd.randrange(0, 30)).upper()) for k in range(80)] + [(900, None), (901, ""), (902, "É x"), (903, "x" * 41), (904, "ab")]
    t = spark.createDataFrame(texts, "id int, t string").repartition(3)
    r = spark.createDataFrame(rules, "domain string, rank long, keyword string").repartition(5)
    got = ru.match_rules(t, r, "id", "t")
    assert_plan_shape("match_rules", got)
    assert {x["id"]: (x["rank"], x["domain"], x["keyword"]) for x in got.collect()} == brute_rules(texts, rules)


def test_rules_as_table_tag_like_the_literal_chain(spark):
    items = [("machine learning",), ("social media",), ("ai ",), ("ai",), ("cv design",), ("5g radio",), ("cooking",), ("aws data",), ("",), ("CI/CD",)]
    df = spark.createDataFrame(items, "item string")
    want = {r[0]: r[1] for r in df.select("item", tx.domain_of("item")).collect()}
    rules = ru.rule_table(spark, tx.DOMAIN_KEYWORDS)
    assert {r["item"]: r["domain"] for r in ru.domains_by_rules(df, rules, "item", "item").collect()} == want
    none = ru.domains_by_rules(df, rules.limit(0), "item", "item").collect()
    assert len(none) == len(items) and {r["domain"] for r in none} == {"Other"}


def test_lemma_table_equals_the_map_literal(spark):
    rows = [(1, "  Old GIZMO  parts "), (2, "gizmo"), (3, None), (4, ""), (5, "  "), (6, "gizmos gizmo gizmo"), (7, "gizmo")]
    df = spark.createDataFrame(rows, "id int, item string")
    lemmas = {"gizmo": "gadget", "parts": "part"}
    want = {r["id"]: r["x"] for r in df.select("id", tx.lemma_normalise("item", lemmas).alias("x")).collect()}
    table = spark.createDataFrame(list(lemmas.items()), "word string, lemma string")
    got = ru.lemmatise(df, "item", table, "x")
    assert_plan_shape("lemmatise", got)
    assert {r["id"]: r["x"] for r in got.collect()} == want and got.columns == ["id", "item", "x"]


def test_mined_lemmas_need_their_stem(spark):
    words = ["test", "tests", "testing", "class", "classes", "classs", "party", "parties", "is", "i", "bus", "buse", "buses", "red", None, "tests"]
    got = {r["word"]: r["lemma"] for r in ru.mine_lemmas(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {"tests": "test", "testing": "test", "classes": "class", "classs": "class", "parties": "party", "buses": "bus"}


def test_expansion_tables_equal_the_literal(spark):
    texts = ["AI gaps in clouds", "nothing here", None, "", "data data ml", "gapss", "urgents web"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = {r["id"]: r["x"] for r in df.select("id", tx.expand_query("t").alias("x")).collect()}
    words = df.select(F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\w+"), 0)).alias("word")).distinct()
    lemmas = words.where(F.endswith("word", F.lit("s"))).select("word", F.regexp_replace("word", "s$", "").alias("lemma"))
    got = ru.expand_queries(df, "id", "t", ru.synonym_table(spark, tx.QUERY_SYNONYMS), lemmas, "x")
    assert {r["id"]: r["x"] for r in got.collect()} == want


def test_global_chunks_cross_documents(spark):
    pages = [(d, p, f"page {d}.{p}") for d, n in ((3, 2), (1, 4), (2, 1), (9, 3)) for p in range(n)]
    df = spark.createDataFrame(pages, "doc_id long, page_no int, text string").repartition(4)
    got = sorted(ex.global_chunk_pages(df, 3, "|").collect(), key=lambda r: r["chunk_no"])
    flat = [t for _, _, t in sorted(pages)]
    assert [r["text"] for r in got] == ["|".join(flat[k:k + 3]) for k in range(0, 10, 3)]
    assert [r["chunk_no"] for r in got] == [0, 1, 2, 3] and (got[1]["first_doc"], got[1]["last_doc"]) == (1, 3)


def test_sketches_unite_and_stay_within_their_error(spark):
    log = spark.range(60000).select((F.col("id") % 7).alias("item"), (F.col("id") % 3).alias("year"), (F.col("id") % 20011).alias("v"))
    cube = sk.sketch_cube(log, "v").cache()
    for keys in (["item"], ["year"], []):
        exact = {tuple(r[k] for k in keys): r["n"] for r in log.groupBy(*keys).agg(F.count_distinct("v").alias("n")).collect()}
        for r in sk.estimates(cube, keys).collect():
            n = exact[tuple(r[k] for k in keys)]
            assert abs(r["estimate"] - n) <= 4 * sk.relative_error() * n
    one = spark.createDataFrame([("a", 1, None), ("a", 1, 5)], "item string, year int, v int")
    assert [(r["estimate"], r["rows"]) for r in sk.estimates(sk.sketch_cube(one, "v"), ["item"]).collect()] == [(1, 2)]
    cube.unpersist()


def cards_of(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, text string, priority_score double, embedding array<float>, meta map<string,string>")


GOOD = [("a", "x", "one", 0.5, [3.0, 4.0], {"k": "v"}), ("b", "y", "two", None, [0.0, 0.0], None), ("c", "x", "three", 0.1, [1.0, 0.0], {})]


def test_collection_versions(spark, tmp_path):
    path = str(tmp_path / "cards")
    with pytest.raises(ValueError):
        cl.read_collection(spark, path)
    first = cl.rebuild(cards_of(spark, GOOD), path)
    rows = {r["id"]: r for r in cl.read_collection(spark, path).collect()}
    assert rows["a"]["embedding"] == pytest.approx([0.6, 0.8]) and rows["b"]["embedding"] == [0.0, 0.0]
    assert rows["a"]["meta"] == {"k": "v"} and rows["b"]["meta"] == {}
    old_reader = cl.read_collection(spark, path)

    bad = {"duplicate": [*GOOD, ("a", "z", "again", 0.0, [1.0, 1.0], None)], "without id": [*GOOD, (None, "z", "t", 0.0, [1.0, 1.0], None)],
           "vector lengths": [*GOOD, ("d", "z", "t", 0.0, [1.0], None)], "unit vector": [*GOOD, ("d", "z", "t", 0.0, None, None)]}
    for why, cards in bad.items():
        with pytest.raises(ValueError, match=why):
            cl.rebuild(cards_of(spark, cards), path)
        assert cl.current_version(spark, path) == first and cl.read_collection(spark, path).count() == 3
    cl.write_version(cards_of(spark, GOOD[:1]), path)   # the driver is lost before the check
    assert cl.current_version(spark, path) == first

    second = cl.rebuild(cards_of(spark, GOOD[:2]), path)
    assert second != first and cl.read_collection(spark, path).count() == 2
    assert old_reader.count() == 3   # a reader keeps the version that it resolved
    gone = cl.prune(spark, path, keep=1)
    assert first in gone and cl.versions(spark, path) == [second] and cl.read_collection(spark, path).count() == 2


def test_type_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "cards")
    cl.rebuild(cards_of(spark, GOOD), path)
    df = cl.read_collection(spark, path, ["x"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in df.collect()} == {"a", "c"} and "PartitionFilters: [" in plan and "type" in plan.split("PartitionFilters: [")[1].split("]")[0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_dictionary_mentions_match_brute_force(spark, broadcast, monkeypatch):
    import re

    if not broadcast:
        monkeypatch.setattr(ex, "MAX_BROADCAST_TERMS", 0)
    rnd = random.Random(9)
    words = ["a", "b", "c++", "d.e", "f-g", "h"]
    pages = [(k // 2, k % 2, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14))) + rnd.choice(["", "!", " (A)"])) for k in range(60)]
    pages += [(50, 0, None), (51, 0, ""), (52, 0, "a"), (53, 0, "a b a b a b"), (53, 0, "h a b")]
    entries = {" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(60)} | {"A  B", "missing", "a b"}
    d = spark.createDataFrame([(e,) for e in sorted(entries)] + [(None,), ("A b ",)], "item string")
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string").repartition(3)
    want = set()
    for i, p, t in pages:
        toks = re.findall(ex.TOKEN, (t or "").lower())
        grams = {" ".join(toks[a:a + n]) for n in range(1, 6) for a in range(len(toks) - n + 1)}
        want |= {(i, p, g) for g in grams & {" ".join(e.lower().split()) for e in entries}}
    got = [tuple(r) for r in ex.dictionary_mentions(df, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ex.dictionary_mentions(df, d.limit(0)).count() == 0
    once = df.where("doc_id < 53")
    assert sorted(map(tuple, ex.dictionary_mentions(once, d, unique=True).collect())) == sorted(x for x in want if x[0] < 53)


def test_rules_that_travel_and_rules_that_are_dealt_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"alpha{i % 7} beta {'gamma' * (i % 3)} x") for i in range(40)] + [(None, "alpha1"), (3, "beta alpha6")], "id long, t string")
    rules = spark.createDataFrame([("d1", 2, "alpha1"), ("d2", 1, "magam"), ("d3", 3, "a"), ("d4", 0, "alpha6"), ("d5", 0, "zz")], "domain string, rank long, keyword string")
    got = ru.match_rules(texts, rules, "id", "t")
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ru, "MAX_RULE_BYTES", 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ru.match_rules(texts, rules, "id", "t").collect()))
