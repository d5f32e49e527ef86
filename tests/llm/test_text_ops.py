"""Operators 1, 2, 4, 8, 9 and 10 with edge cases."""
import hashlib
import inspect
import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from demandlens.llm import chat_format, decontam, lm_score, mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


def oracle_rows(sql, **frames):
    con = duckdb.connect()
    for name, f in frames.items():
        con.register(name, f)
    cur = con.execute(sql)
    return sorted(c[0] for c in cur.description), cur


def compare(df, sql, **tables):
    con = duckdb.connect()
    for name, pdf in tables.items():
        con.register(name, pdf)
    want = con.execute(sql).to_arrow_table()
    cols = sorted(df.columns)
    assert sorted(want.column_names) == cols
    a = Counter(tuple(r) for r in df.select(*cols).collect())
    b = Counter(zip(*(want[c].to_pylist() for c in cols))) if want.num_rows else Counter()
    assert a == b
    return sum(a.values())


# 1 toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1600):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["Nasty", "vile!", "stemword" + rng.choice(["er", "ing", "es"])]))
        rows.append((i, " ".join(w), ("en", "de")[i % 2], "zzz"))
        labels.append((i, int(bad), "x"))
    rows += [(3000, None, None, ""), (3001, "", "en", ""), (3002, "?! ...", "fr", ""), (3003, "nasty " * 20000, "en", ""), rows[0], (None, "vile nasty", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    return docs, spark.createDataFrame(labels + [(4000, None, "")], "doc_id long, toxic int, text string")


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    out = {(r["doc_id"]): r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in y if i in out and out[i]["held"]]
    pos = [out[i]["score"] for i in held if y[i]]
    neg = [out[i]["score"] for i in held if not y[i]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert len(held) > 150 and auc > 0.97
    assert set(model.thresholds) == {"de", "en"}
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert out[3000]["score"] == out[3001]["score"] == out[3002]["score"] < 0.3 < out[3003]["score"]
    assert docs.count() == toxicity.score(docs, model).count()
    kept = toxicity.reject_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["rejected"]}


def test_toxicity_reads_only_the_text(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 5000)
    a = Counter(round(r["score"], 12) for r in toxicity.score(docs, model).collect())
    assert a == Counter(round(r["score"], 12) for r in toxicity.score(other, model).collect())


def test_toxicity_sample_is_bounded(spark, labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda data, y, *a: seen.append((len(data), sum(d.shape[1] for d in data))))
    copies = docs.filter("doc_id = 9").crossJoin(spark.range(500).select("id")).drop("id")   # one labelled row in many rows
    huge = docs.filter("doc_id = 9").withColumn("text", F.repeat(F.lit("word "), 50000))
    toxicity.train(docs, labels)
    toxicity.train(docs.unionByName(copies), labels)
    assert seen[0] == seen[1]
    toxicity.train(docs.unionByName(huge), labels, max_train=100, max_words=2000)
    assert seen[2][0] <= 100 and 0 < seen[2][1] <= 2000


def test_toxicity_trains_on_every_labelled_document(spark, monkeypatch):
    docs = spark.range(13600).selectExpr("id AS doc_id", "concat('word ', id % 7, if(id % 7 = 0, ' vile', '')) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 7 = 0 as int) AS toxic")
    seen = []
    monkeypatch.setattr(toxicity, "fit_shards", lambda rows: seen.append(rows.select("id").distinct().count()))
    monkeypatch.setattr(toxicity, "fit", lambda data, *a: seen.append(len(data)))
    toxicity.train(docs.unionByName(docs.filter("doc_id < 100")), labels)
    assert seen == [docs.filter(~toxicity.held_out()).count()] and seen[0] > 10000


def test_toxicity_in_shards(spark, labelled, monkeypatch):
    docs, labels = labelled
    begun, start = [], toxicity.start
    monkeypatch.setattr(toxicity, "start", lambda df, n, rng: (begun.append((np.stack(df), n)), start(df, n, rng))[1])
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 300)
    model, again = toxicity.train(docs, labels), toxicity.train(docs.repartition(7), labels)
    assert len(begun) == 3 and all((df == begun[0][0]).all() and n == begun[0][1] for df, n in begun)
    assert model.scale == again.scale and model.thresholds == again.thresholds and set(model.thresholds) == {"de", "en"}
    assert all((a == b).all() for a, b in zip(model.emb, again.emb))
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).filter(toxicity.held_out()).collect() if r["doc_id"] in y}
    pos, neg = ([s for i, s in out.items() if y[i] == c] for c in (1, 0))
    assert len(out) > 150 and np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.97


def test_toxicity_in_shards_with_one_class(spark, labelled, monkeypatch):
    docs, labels = labelled
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 100)
    one = toxicity.train(docs, labels.filter("toxic = 1"))
    assert one.base == 1.0


def test_every_language_of_the_calibration_rows_has_a_threshold(spark, labelled):
    docs, labels = labelled
    few = docs.withColumn("lang", F.when(F.col("doc_id") % 40 == 0, "rare").otherwise(F.col("lang")))
    model = toxicity.train(few, labels)
    assert set(model.thresholds) == {"de", "en", "rare"}
    odds = lambda t: np.log(t / (1 - t))
    assert all(0 < t < 1 for t in model.thresholds.values())
    assert abs(odds(model.thresholds["rare"]) - odds(model.threshold)) < 5


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    one = toxicity.train(docs, labels.filter("toxic = 1"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}
    assert toxicity.score(docs.limit(0), one).count() == 0


def test_convolution_matches_loops():
    rng = np.random.default_rng(3)
    m = toxicity.Model([rng.normal(size=(toxicity.BUCKETS + 1, toxicity.DIM)).astype(np.float32) for _ in toxicity.PREFIXES],
                       [rng.normal(size=(w, toxicity.PARTS * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS],
                       rng.normal(size=3 * toxicity.FILTERS).astype(np.float32), np.zeros(1))
    counts = np.array([4, 0, 1, 7])
    b = rng.integers(0, toxicity.BUCKETS, (toxicity.PARTS, 12)).astype(np.int32)
    x = toxicity.features(m, b, counts)
    at = 0
    for d, n in enumerate(counts):
        e = np.zeros((max(n, 1) + 5, toxicity.PARTS * toxicity.DIM))
        for k in range(n):
            e[k] = np.concatenate([m.emb[i][b[i, at + k]] for i in range(toxicity.PARTS)])
        at += n
        for c, w in enumerate(toxicity.WIDTHS):
            win = np.array([sum(e[i + j] @ m.conv[c][j] for j in range(w)) for i in range(max(n, 1))])
            for r in range(3):
                cols = slice(c * toxicity.FILTERS, (c + 1) * toxicity.FILTERS)
                want = win[r::3].max(axis=0) + m.bias[cols] if len(win[r::3]) else np.full(toxicity.FILTERS, -1e9)
                assert np.allclose(np.maximum(x[d, r, cols], -1e8), np.maximum(want, -1e8), atol=1e-3)


# 2 decontamination

def test_masks_find_every_window():
    for bad in itertools.combinations(range(decontam.WINDOW), decontam.MISMATCHES):
        assert any(all(s + j not in bad for j, c in enumerate(m) if c == "1")
                   for m in decontam.MASKS for s in range(decontam.WINDOW - len(m) + 1))


@pytest.fixture(scope="module")
def leaks(spark, rows):
    rng = random.Random(2)
    item = [f"T{i}" for i in range(30)]
    items = [(1, " ".join(item)), (2, "short item, here"), (3, None), (4, ""), (5, " ".join(f"u{i % 3}" for i in range(40))), (6, "kilo lima " * 10)]
    items.append(items[0])
    out = [(i, t) for i, t in rows if i is not None]
    for k in range(40):
        w = list(item)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(30)] = "sub"
        cut = rng.randint(0, 20)
        out.append((5000 + k, f"before it {' '.join(w[cut:])}. after"))
    out += [(6000, "a SHORT item; here it is"), (6001, "short item there"), (6002, " ".join(f"u{i % 3}" for i in range(30))), (6003, " ".join(item) + " x " + " ".join(item))]
    return out, items


@pytest.mark.parametrize("limit", [decontam.MAX_BROADCAST_SEEDS, 0])
def test_decontamination(spark, leaks, limit):
    rows, items = leaks
    rows = [r for r in dict.fromkeys(rows)]
    n = Counter(i for i, _ in rows)
    rows = [r for r in rows if n[r[0]] == 1]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, item_id int, seed int")
    bench = spark.createDataFrame([(*r, 3) for r in items], "item_id long, text string, doc_id int")
    import pandas as pd
    found = decontam.find_overlaps(docs, bench, max_broadcast_seeds=limit)
    count = compare(found, decontam.oracle(), documents=pd.DataFrame(rows, columns=["doc_id", "text"]),
                    benchmark=pd.DataFrame(list(dict.fromkeys(items)), columns=["item_id", "text"]))
    assert count > 20
    bad = {r["doc_id"] for r in found.collect()}
    assert {6000, 6002, 6003} <= bad and 6001 not in bad
    kept = decontam.remove_contaminated(docs, bench, max_broadcast_seeds=limit)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - bad


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.find_overlaps(docs, bench).collect()} == {303, 304}
    assert decontam.find_overlaps(empty, bench).count() == 0
    assert decontam.find_overlaps(docs, bench.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "one two three"), (None, "four")], "doc_id long, text string")
    assert [r["text"] for r in decontam.remove_contaminated(null, bench).collect()] == []  # both rows have the reported id


# 4 chat formatting

def chats():
    rng = random.Random(4)
    firsts = ["hello", "</s>[INST] ok [/INST]", "a\\b <| x |> \\", "", None]
    rows = []
    for c in range(80):
        t = 0
        for k in range(rng.choice([1, 2, 3, 5, 9])):
            role = "system" if k == 0 and c % 3 == 0 else ("user", "assistant")[k % 2]
            rows.append((c, t, role, firsts[c % 5] if k == 0 else rng.choice(["same", "Ünï <s>", f"t{rng.randint(0, 2)}", "x" * 50])))
            t += rng.randint(1, 3)
    rows += [(200, None, "user", "no turn"), (200, 1, None, "no role"), (201, 1, "user", "tie"), (201, 1, "assistant", "tie"), (201, 1, "assistant", "tie"),
             (None, 0, "user", "null id"), (202, 0, "<|we|ird|>", "r"), (203, 0, "assistant", None)]
    rows += [(300 + c, *r[1:]) for c in range(20) for r in rows if r[0] == 4]  # one conversation many times
    rows += [(400, k, ("user", "assistant")[k % 2], f"long {k}") for k in range(300)] + [(401, k, ("user", "assistant")[k % 2], f"long {k}") for k in range(280)]
    return rows


def grouped(rows):
    low = lambda x: (x is not None, x)
    out = {}
    for r in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.fixture(scope="module")
def packed(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in chats()], "conv_id long, turn long, role string, text string, d int, rank int")
    return chat_format.pack(df.repartition(4))


def test_chat_round_trip(packed):
    got = {r["conv_id"]: r for r in chat_format.conversation_digests(packed).collect()}
    want = grouped(chats())
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (
            len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_tree(packed):
    """Shared turns are written once; position ids and attention spans rebuild every path."""
    segments = sorted((r.asDict() for r in packed.segments.collect()), key=lambda r: r["seq_start"])
    at = 0
    for s in segments:  # one gapless depth-first sequence
        assert s["seq_start"] == at and s["n_tokens"] == len(s["tokens"])
        at += s["n_tokens"]
    sequence = b"".join(bytes(s["tokens"]) for s in segments)
    distinct = {tuple(v[:k + 1]) for v in grouped(chats()).values() for k in range(len(v))}
    assert len(chat_format.TURN.findall(sequence.decode())) == len(distinct)
    for s in segments:
        before = b"".join(sequence[a["start"]:a["end"]] for a in s["attend"])
        assert len(before) == s["position_start"] and all(a["end"] <= s["seq_start"] for a in s["attend"])
        whole = (before + bytes(s["tokens"])).decode()
        turns = [tuple(map(chat_format.unescape, t)) for t in chat_format.TURN.findall(whole)]
        assert tuple(turns) in distinct


def test_chat_empty(spark):
    p = chat_format.pack(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert p.segments.count() == 0 and chat_format.conversation_digests(p).count() == 0


# 8 language-model scores

def test_lm_scores(spark, docs, rows, empty):
    import pandas as pd
    got = lm_score.lm_scores(docs, chunk_bytes=4000).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                                                          F.round("mean_log_score", 4).alias("mean_log_score"))
    table = pd.DataFrame(rows, columns=["doc_id", "text"])
    table["doc_id"] = table["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", table)
    want = con.execute(lm_score.oracle()).fetchall()
    a = sorted(((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in got.collect()))
    b = sorted(((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in want))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert all(abs(x[3] - y[3]) < 1e-3 and abs(x[4] - y[4]) < 1e-3 for x, y in zip(a, b))
    assert lm_score.lm_scores(empty).count() == 0


def test_lm_narrow_hashes(spark, docs):
    width = inspect.signature(lm_score.lm_scores).parameters["bits"].default
    assert width[0] == 64 and sum(width) >= 96  # whatever the input's size
    score = lambda **a: sorted(((r["doc_id"] or -1, r["n_words"], r["log_score"]) for r in lm_score.lm_scores(docs, chunk_bytes=4000, **a).collect()))
    exact = score()
    assert np.allclose(score(bits=(9, 32)), exact)  # n-grams of one first hash are told apart by the second
    shared = score(bits=(9, 0))
    assert shared != exact and all(math.isfinite(x) for _, _, x in shared)  # n-grams that share counts


def test_lm_false_count_of_unseen_history():
    g = lm_score.Grams(pa.array(["alone here", "other text"], pa.large_string()), 2, (64, 32))
    _, _, counts, which = g.distinct()
    total = counts.copy()
    total[which[1]] += 3  # the word pairs seem to be elsewhere, their histories are not
    assert np.allclose(lm_score.score_chunk(g, which, total, 4, 0.4), [2 * math.log(0.5 / 2) + math.log(0.4)] * 2)


def test_lm_repeated_rows_spread(spark):
    import pandas as pd
    rows = [(i % 7 if i % 3 else 5, "the same short row again and again" if i % 3 else f"row {i} has words {i * 7 % 11} of its own and again") for i in range(600)]
    src = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    out = lm_score.lm_scores(src, chunk_bytes=1000)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    key = lambda r: (r[0], r[1], round(r[2], 2))
    assert sorted(key(r) for r in out.collect()) == sorted(key(r) for r in con.execute(lm_score.oracle()).fetchall())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow deal") == 1  # the texts are dealt out once, their exchange is used three times


def test_lm_homes():
    """Near copies share a chunk, short texts don't all share one, a text's chunk is its own matter."""
    words = [" ".join(f"w{(i * 31 + j * j) % 97}" for j in range(60)) for i in range(40)]
    texts = pa.array([*words, *(w.replace("w5 ", "x ") for w in words), *(f"a{i}" for i in range(40)), "", "..."], pa.large_string())
    data, offs = lm_score.tp.buffers(texts)
    at = lm_score.homes(lm_score.tp.Words(data, offs, lm_score.tp.letter_table()), 1000)
    assert (at[:40] == at[40:80]).mean() > 0.8 and len(set(at[80:120].tolist())) > 30
    for i in (0, 45, 100, 120):
        data, offs = lm_score.tp.buffers(texts.slice(i, 1).take(pa.array([0])))
        assert lm_score.homes(lm_score.tp.Words(data, offs, lm_score.tp.letter_table()), 1000)[0] == at[i]


def test_lm_pack_round_trip():
    for a in ([], [0], [255, 256, 0], [1 << 55, 3]):
        x = np.array(a, np.uint64)
        assert lm_score.unpack(*lm_score.pack(x)).tolist() == a
    rng = np.random.default_rng(5)
    for a in ([], [0], [(1 << 64) - 1, 0], [1 << 55, 3, 2], rng.exponential(1e9, 500), [*rng.integers(0, 200, 99), 1 << 40]):
        x = np.array(a, np.uint64)
        assert lm_score.unpack_patched(lm_score.pack_patched(x)).tolist() == x.tolist()
        assert lm_score.unpack_patched(lm_score.unsqueeze(lm_score.squeeze(lm_score.pack_patched(x)))).tolist() == x.tolist()
    for a in ([], [0], [0, 0, 7, 0, 300], [5]):
        assert lm_score.unpack_sparse(lm_score.pack_sparse(np.array(a, np.int64)), len(a)).tolist() == a


# 9 mixing

def test_mixing(spark, docs, empty, rows):
    out = mixing.mix_sources(docs, seed=5)
    assert out.columns == [c for c in docs.columns if c not in ("copy_no", "shuffle_key")] + ["copy_no", "shuffle_key"]
    import pandas as pd
    src = docs.select("doc_id", "source").toPandas()
    src["doc_id"] = src["doc_id"].astype("Int64")
    compare(out.select("doc_id", "source", "copy_no", "shuffle_key"), mixing.oracle(seed=5), documents=src)
    assert mixing.mix_sources(empty).count() == 0
    none = mixing.mix_sources(docs, weights={"s1": 1.0})
    assert {r["source"] for r in none.collect()} == {"s1"}
    assert mixing.mix_sources(docs, weights={"s9": 1.0}).count() == 0


def test_mixing_is_poisson(spark):
    big = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix_sources(big, weights={"a": 3.0, "b": 1.0}, budget=30000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 22500) < 600 and abs(n["b"] - 7500) < 400
    per = Counter(r["n"] for r in out.filter("source = 'a'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    per[0] = 5000 - sum(per.values())
    for k in range(10):  # rate 4.5
        p = math.exp(-4.5) * 4.5 ** k / math.factorial(k)
        assert abs(per[k] - 5000 * p) < 5 * math.sqrt(5000 * p) + 5
    again = mixing.mix_sources(big.repartition(7), weights={"a": 3.0, "b": 1.0}, budget=30000)
    assert again.exceptAll(out).isEmpty()
    rate = mixing.source_rates(spark.range(1).select(F.lit("z").alias("source")), budget=2000.0).first()
    assert abs(rate["cdf"][-1] - 1) < 1e-6 and abs(rate["cdf"][2000] - 0.506) < 0.01  # no underflow at large rates


# 10 personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: [int(c) for c in s if "0" <= c <= "9"]

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m.group())) <= 15]


PII_TEXTS = ["mail bob.x+1@mail7.example.com or a@b.c_d@e.f @ x@y", "ip 10.0.0.255 and 256.1.1.1 1.2.3.4.5 0.0.0.0", "card 4529 6034-6113 5147 4111111111111111 x 4111111111111112",
             "call +1 (361) 555-8283 or +1 2 3", "IBAN GB82 WEST 1234 5698 7654 32 done", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "ssn 123-45-6789; 123-45-6789",
             "é" * 10 + " é@é.de ü+49 30 1234567", "card 378282246310005", "", None, "7" * 4000 + "." + "1" * 3000, "+1((((" * 500, "a" * 3000 + "@"]


def test_pii_base_spans():
    rng = random.Random(8)
    for t in [t for t in PII_TEXTS if t] + ["".join(rng.choice("ab1.2@@-_+ .34é()") for _ in range(rng.randint(0, 40))) for _ in range(5000)]:
        assert [x[:3] for x in pii.spans_of(t) if x[0] in pii.BASE_KINDS] == plain_spans(t)


def test_context_words_are_whole_and_on_both_sides():
    kinds = lambda t: [(x[0], round(x[3], 2)) for x in pii.spans_of(t)]
    assert kinds("we discarded 378282246310005 boxes") == [] and kinds("recipe 1.2.3.4") == [("ip", 0.6)]
    assert kinds("my card: 378282246310005") == kinds("378282246310005 is the card") == [("short_card", 0.75)]
    assert kinds("cards 378282246310005") == [("short_card", 0.75)] and kinds("ip 1.2.3.4") == [("ip", 0.95)]
    assert kinds("378282246310005" + "." * 60 + "card") == []


def test_pii_query(spark):
    rows = [(i, t, 1, 2.0) for i, t in enumerate(PII_TEXTS)] + [(None, PII_TEXTS[0], 1, 2.0), (0, PII_TEXTS[0], 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, score double")
    out = pii.digest(pii.find_pii(docs)).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain_spans(PII_TEXTS[r["doc_id"] or 0] or "")
        assert [r[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(x[0] == k for x in base) for k in pii.BASE_KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    spans = {r["doc_id"]: r["spans"] for r in out}
    assert "iban:5:32" in spans[4] and "secret:9:49" in spans[5] and "short_card:5:20" in spans[8]
    assert spans[6].count("national_id") == 2
    clean = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs).collect()}
    assert clean[0].startswith("mail [EMAIL] or [EMAIL]") and clean[10] is None and clean[9] == ""
    assert not any(plain_spans(t) for t in clean.values() if t)
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_sample_of_the_driver_is_held_once():
    import numpy as np
    import pyarrow as pa

    from demandlens.llm import toxicity

    cells = [np.arange(toxicity.PARTS * n, dtype=np.int32) + n for n in (2, 0, 5)]
    col = pa.chunked_array([pa.array([c.tobytes() for c in cells], pa.binary()).slice(1), pa.array([], pa.binary()),
                            pa.array([cells[0].tobytes()], pa.binary())])
    got = toxicity.in_place(col)
    assert [g.tolist() for g in got] == [c.reshape(toxicity.PARTS, -1).tolist() for c in (cells[1], cells[2], cells[0])]
    assert np.shares_memory(got[1], np.frombuffer(col.chunks[0].buffers()[2], np.uint8))
