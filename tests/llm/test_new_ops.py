"""Operators 11 to 13: whitening, packing, source divergence."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlens.llm import divergence, packing, queries, whitening
from tests.llm.test_queries import SF

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENS = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- 11: whitening

def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [-1, 0, 1], [3, 3, 3], [2, 2, 1, 1, 0, 0], [1e6, 1, 1e-6], [1, 1 + 1e-9, 1 + 2e-9, 5],
    list(range(64)), [0] * 7 + [1], [100 - 0.01 * k for k in range(40)], [7], [-2, 2, 0, 0, 0]])
def test_spectral_matches_eigh(values):
    v = spectrum(values)
    e, w = whitening.spectral(v)
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-12 * max(1, np.abs(values).max()) * len(values))
    assert np.allclose(w.T @ w, np.eye(len(values)), atol=1e-12)
    assert np.allclose(v @ w, w * e, atol=1e-11 * max(1, np.abs(values).max()))


def test_polar_is_orthogonal_and_sign_like():
    a = spectrum([3, 2, -1, -4], 3)
    u = whitening.polar(a)
    assert np.allclose(u @ u, np.eye(4), atol=1e-12) and round(np.trace(u)) == 0 and np.linalg.eigvalsh(u @ a).min() > 0
    assert whitening.polar(np.zeros((2, 2))) is None and whitening.polar(np.diag([1.0, 0.0, -1.0])) is None


def brute_whitening(rows, components=16):
    """vec_id -> (deviation, whitened up to sign, explained) from plain numpy, all vectors of one length."""
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    c = np.array(fit, float) - mean
    cov = c.T @ c / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    return n, [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - mean) @ w / np.sqrt(e)) for i, v in x], e / np.trace(cov)


def test_whitening_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    scale = np.array([9, 7, 5, 3, 2, 1.5, 1, 0.5])
    rows = [(i, (rng.standard_normal(8) * scale).round(3).tolist()) for i in range(400)]
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (501, None), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] + [0.0] * 7),
             (504, [float("inf")] * 8), (505, []), (506, [1e300] * 8)]
    rows += [(600 + k, rows[2][1]) for k in range(300)]  # a vector that a third of the rows hold
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, x string").repartition(4)
    got = whitening.whiten(df, components=5).collect()
    n, want, explained = brute_whitening(rows[:403] + rows[-300:], 5)
    assert len(got) == 5 * len(want) and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    find = {}
    for i, dev, w in want:
        find.setdefault(i, []).append((dev, w))
    signs = np.zeros(5)
    for r in got:
        dev, w = find[r["vec_id"]][0]
        k = r["component"] - 1
        assert int(r["deviation"]) == dev and abs(r["explained"] / explained[k] - 1) < 1e-9
        assert abs(abs(r["whitened"]) - abs(w[k])) < 1e-8
        if abs(w[k]) > 1e-3:
            s = np.sign(r["whitened"] / w[k])
            assert signs[k] in (0, s)
            signs[k] = s


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance
    flat = [(i, [float(i), 5.0, float(i)]) for i in range(4)]  # one direction only
    got = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12
    mixed = flat + [(10, [1.0]), (11, [2.0])]
    got = whitening.whiten(spark.createDataFrame(mixed, schema)).collect()
    assert sorted((r["vec_id"], r["n"]) for r in got) == [(0, 4), (1, 4), (2, 4), (3, 4), (10, 2), (11, 2)]
    huge = [(i, [2.0 ** 50 * i, float(i % 3)]) for i in range(5)]
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(huge, schema)).collect()}
    xs = [(64 * 2 ** 50 * i + 1_000_000, 64 * (i % 3) + 1_000_000) for i in range(5)]
    sums = [sum(c) for c in zip(*xs)]
    assert got == {i: sum((5 * c - s) ** 2 for c, s in zip(x, sums)) for i, x in enumerate(xs)}


def test_whitening_query_matches_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.read(spark, SF, "embeddings").collect()]
    n, want, explained = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.QUERIES["op11_embedding_whitening"](spark, SF).collect()}
    assert len(got) == 16 * len(want)
    for i, dev, w in want:
        for k in range(16):
            r = got[(i, k + 1)]
            assert (r["n"], r["deviation"]) == (n, dev) and abs(abs(r["whitened"]) - abs(w[k])) < 1e-6 and abs(r["explained"] / explained[k] - 1) < 1e-9


# ---- 12: packing

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80), st.sampled_from([8, 16, 24]))
def test_packer_places_every_token_once(sizes, window):
    done = []
    p = packing.Packer(window, lambda w: done.append([(d, s, len(x)) for d, s, x in w]))
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.int32))
        assert int((p.level ** 2).sum()) == sum(len(w) ** 2 for w in p.open)
    assert p.level.max(initial=0) <= 4
    p.close()
    held = {}
    for w in done:
        n = sum(x[2] for x in w)
        assert n == window or n & (n - 1) == 0
        for d, s, k in w:
            held.setdefault(d, []).append((s, k))
    assert {i: sum(k for _, k in v) for i, v in held.items()} == dict(enumerate(sizes))
    for v in held.values():
        at = 0
        for s, k in sorted(v):
            assert s == at
            at += k


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    p = packing.Packer(32, lambda w: None)
    for i, n in enumerate(rng.integers(1, 32, 400)):
        before, options = p.level.copy(), []
        for h in [0, *np.flatnonzero(before)]:
            if h + n <= 32:
                after = before.copy()
                if h:
                    after[h] -= 1
                if h + n < 32:
                    after[h + n] += 1
                options.append((after ** 2).sum())
        p.add(i, np.zeros(n, np.int32))
        assert (p.level ** 2).sum() <= min(options)


@pytest.fixture(scope="module")
def encoders():
    return packing.encoder(TOKENS, None), packing.encoder(TOKENS, RANKS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("ab Zz9'\t\n\r.,-<|>séüßŁ")), st.text()), max_size=4))
def test_faster_encoder_gives_the_same_ids(encoders, texts):
    assert [x.tolist() for x in encoders[0](texts)] == [x.tolist() for x in encoders[1](texts)]


def test_encoders_agree_on_the_table(encoders, spark):
    texts = [r["text"] or "" for r in queries.read(spark, SF, "documents").select("text").collect()]
    assert all(np.array_equal(a, b) for a, b in zip(encoders[0](texts), encoders[1](texts)))


@pytest.mark.parametrize("partitions,ranks", [(1, None), (7, RANKS)])
def test_packing_round_trip(spark, docs, rows, partitions, ranks):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENS)
    model.encode_special_tokens = True
    extra = [(400, "<|endoftext|> stays text"), (401, None), (401, None), (402, "word " * 9000)]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True).repartition(partitions)
    pieces = packing.pack(df, TOKENS, ranks, window=256, keep_ids=True).cache()
    got = pieces.collect()
    texts = [(i, model.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in [*rows, *extra]]
    assert sum(r["length"] for r in got) == sum(len(t) for _, t in texts)
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append(t)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) > 0
        assert any(t[r["start"]:r["start"] + r["length"]] == r["ids"] and len(t) == r["doc_tokens"] for t in want[r["doc_id"]])
    single = {i: v[0] for i, v in want.items() if len(v) == 1}
    back = {}
    for r in sorted(got, key=lambda r: r["start"]):
        back.setdefault(r["doc_id"], []).extend(r["ids"])
    assert {i: back[i] for i in single} == single
    made = packing.sequences(pieces, window=256).collect()
    assert all(len(s["ids"]) == 256 or len(s["ids"]) & (len(s["ids"]) - 1) == 0 for s in made) and all(s["n_pad"] == 0 for s in made)
    where = {}
    for r in got:
        where.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in where.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 256
    pieces.unpersist()


def test_packing_of_nothing(spark, empty):
    assert packing.pack(empty, TOKENS).count() == 0
    one = packing.pack(spark.createDataFrame([("a", "")], "doc_id string, text string"), TOKENS).collect()
    assert [(r["doc_id"], r["length"], r["doc_tokens"]) for r in one] == [("a", 1, 1)]


def test_sequences_pad_what_is_no_power_of_two(spark):
    p = spark.createDataFrame([(5, 0, 3, 0, [7, 8, 9]), (6, 0, 2, 1, [1, 2])], "doc_id long, start long, length long, sequence_id long, ids array<int>")
    got = {r["sequence_id"]: (r["ids"], r["n_pad"]) for r in packing.sequences(p.withColumn("offset", F.lit(0)), window=8).collect()}
    assert got == {0: ([7, 8, 9, 0, 0, 0, 0, 0], 5), 1: ([1, 2], 0)}


# ---- 13: source divergence

def brute_divergence(rows, min_docs, top):
    import re
    from collections import Counter, defaultdict

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(divergence.TERM, low)
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        names = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in names:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + (10 ** 9 * (c[t] + 2)) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: share(counts[lang, s]) for s in names}
        q = share(whole)
        for s in names:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in names if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])}
    return out


def got_rows(df):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("broadcast", [True, False])
def test_divergence_matches_brute_force(spark, broadcast, monkeypatch):
    import random

    if not broadcast:
        monkeypatch.setattr(divergence, "MAX_BROADCAST_ROWS", -1)
    for name, value in (("BLOCK_CELLS", 40), ("SLICE", 100), ("HELD", 5)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(4)
    vocab = ["Alpha", "beta", "Éa", "éa", "zz", "日本", "x", "it's", "a-b", "𐐀", "tie", "eit"]
    data = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for _ in range(160)]
    data += [("alpha " * 50, "en", "hot")] * 80 + [("only once", "fr", "s1"), (None, "fr", "s2"), ("", "fr", "s3"), ("a\x00b\x7fc", "en", "s1"),
                                                   ("Wort " * 20000, "de", "s1"), (None, "it", "s1")]
    df = spark.createDataFrame([(k, *r, 0, 0) for k, r in enumerate(data)], "doc_id long, text string, lang string, source string, at int, kept int").repartition(3)
    for min_docs, top in ((10, 10), (2, 2), (1, 1)):
        got = got_rows(divergence.source_divergence(df, min_docs=min_docs, top=top))
        assert len(got) == len(set(got)) and set(got) == brute_divergence(data, min_docs, top)


def test_divergence_edges(spark, empty):
    assert divergence.source_divergence(empty).count() == 0
    one = spark.createDataFrame([("a b", "en", "s")] * 12, "text string, lang string, source string")
    assert divergence.source_divergence(one).count() == 0  # a source alone equals its language


def test_count_terms_in_small_pieces(monkeypatch):
    import pyarrow as pa

    text = "Alpha béta it's\x00alpha " * 30 + "x" * 300
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["s", "s", "t"]), pa.array([text, "ALPHA", ""])], ["lang", "source", "text"])
    monkeypatch.setattr(divergence, "SLICE", 16)
    monkeypatch.setattr(divergence, "HELD", 2)
    out = {}
    for b in divergence.count_terms(iter([batch.slice(k, 1) for k in range(3)])):
        for r in b.to_pylist():
            n, d = out.get((r["lang"], r["source"], r["term"]), (0, 0))
            out[r["lang"], r["source"], r["term"]] = (n + r["n"], d + r["d"])
    assert out == {("en", "s", "alpha"): (61, 2), ("en", "s", "béta"): (30, 1), ("en", "s", "it"): (30, 1), ("en", "s", "s"): (30, 1),
                   ("en", "s", "x" * 300): (1, 1)}
