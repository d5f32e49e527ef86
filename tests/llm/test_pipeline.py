"""The corpus pipeline against a brute-force version of its last four stages."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from demandlens.llm import decontam, jaccard, mixing, pii, toxicity
from demandlens.llm.queries import read

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "mixing"]
    docs = read(spark, SF, "documents")
    model = toxicity.train(docs, read(spark, SF, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).filter("rejected").collect()}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] not in bad}
    sets = {i: shingles(r["text"]) for i, r in rows.items()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = {i: r for i, r in rows.items() if find(i) == i}
    left = spark.createDataFrame([tuple(r) for r in rows.values()], docs.schema)
    leaked = {r["doc_id"] for r in decontam.find_overlaps(left, read(spark, SF, "benchmark")).collect()}
    want = {i: pii.redacted(r["text"]) for i, r in rows.items() if i not in leaked}
    copies = mixing.mix_sources(left.filter(~F.col("doc_id").isin(list(leaked) or [-9])))
    counts = {r["doc_id"]: r["n"] for r in copies.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    out = P.run(spark, SF)
    got = out.collect()
    seen = {}
    for r in got:
        assert r["text"] == want[r["doc_id"]] and r["n_chars"] == len(r["text"])
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == counts and leaked


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_keep_the_columns(spark, name):
    docs = read(spark, SF, "documents").limit(0)
    out = dict(P.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, repeated rows, a long text and columns with the names used inside."""
    base = read(spark, SF, "documents")
    first = base.orderBy("doc_id").limit(30).collect()
    long = "".join(f"word{k % 977} " for k in range(160000))
    rows = [tuple(r) for r in first] + [tuple(first[3])] * 5 + [(None, first[4]["text"], None, None, 3), (9001, None, None, None, None), (9002, "", "en", None, 0),
                                                                (9003, long, "de", "src1", len(long)), (9003, long, "de", "src1", len(long)),
                                                                (None, "mail bob@example.com alone here today friends", "xx", "src9", 1)]
    names = ["cdf", "_gone", "_again", "_bad", "_mix_count", "_mix_source", "_mix_cdf", "rep", "seed", "score", "threshold", "upto", "h"]
    docs = spark.createDataFrame(rows, base.schema).withColumns({n: F.lit(f"user {n}") for n in names})
    before = docs
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:len(docs.columns)] == docs.columns
        docs = P.staged(out, name)
    got = docs.collect()
    assert all(r[n] == f"user {n}" for r in got for n in names)
    ids = {r["doc_id"] for r in got}
    assert ids <= {r["doc_id"] for r in before.collect()}
    texts = {(r["doc_id"], r["text"]) for r in got}
    assert len({t for i, t in texts if i == 9003}) <= 1 and not any(t and "bob@example.com" in t for _, t in texts)
