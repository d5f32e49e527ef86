"""Operators 3, 5, 6 and 7 against brute force, with edge cases."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from demandlens.llm import embed_dedup, fm_dedup, jaccard, regions, stage, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ordered(rows):
    """Distinct (id, text) in the operators' order; ties by text hash are checked apart."""
    return sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))


def covered(seq, length, seen):
    mask = [False] * len(seq)
    for i in range(len(seq) - length + 1):
        w = seq[i:i + length]
        if w in seen:
            mask[i:i + length] = [True] * length
        seen.add(w)
    return mask


def single(rows):
    """Rows without ids that occur with several texts."""
    n = Counter(i for i, _ in {(i, t or "") for i, t in rows})
    return [r for r in rows if n[r[0]] == 1]


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(400):
        s = np.array([rng.randint(0, rng.choice([1, 3])) for _ in range(rng.randint(0, 40))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    big = np.arange(9000) % 7 * (1 << 40)  # tuples that don't fit into one integer
    assert suffix_dedup.suffix_array(big).tolist() == sorted(range(len(big)), key=lambda i: big[i:].tolist())


def test_wavelet_tree_counts():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 37, 500)
    tree = fm_dedup.WaveletTree(s)
    for c in range(37):
        at = np.arange(501)
        got = tree.walk(np.full(501, c), at) - tree.walk(np.full(501, c), np.zeros(501, np.int64))
        assert got.tolist() == [int((s[:i] == c).sum()) for i in at]


def test_nearest_lower_value():
    rng = np.random.default_rng(3)
    for n in (2, 3, 8, 61, 200):
        v = rng.integers(0, 6, n).astype(np.uint8)
        v[0] = v[-1] = 0
        at, bound = np.repeat(np.arange(n), 6), np.tile(np.arange(1, 7), n)
        lows = fm_dedup.Lows(v)
        assert lows.nearest(at, bound, 1).tolist() == [min(j for j in range(i, n) if v[j] < b) for i, b in zip(at, bound)]
        assert lows.nearest(at, bound, -1).tolist() == [max(j for j in range(i + 1) if v[j] < b) for i, b in zip(at, bound)]


@pytest.mark.parametrize("symbols, source", [(2, 30), (3, 80), (40, 300)])
def test_matching_statistics_at_the_threshold(symbols, source):
    rng = np.random.default_rng(symbols)
    base = rng.integers(1, symbols + 1, source)
    stretches = [base[o:o + n].copy() for o, n in zip(rng.integers(0, source // 2, 120), rng.integers(5, 25, 120))]
    for x in stretches[::2]:
        x[rng.integers(0, len(x))] = rng.integers(1, symbols + 1)
    stretches = [x for x in stretches if len(x) >= 5]
    sizes = np.array([len(x) for x in stretches])
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.concatenate([np.append(x, 0) for x in stretches])
    windows = [(int(i), tuple(text[i:i + 5])) for a, n in zip(starts, sizes) for i in range(a, a + n - 4)]
    n_of = Counter(w for _, w in windows)
    at, lo = fm_dedup.FMIndex(text, 5).statistics(text, starts, sizes)
    assert sorted(at.tolist()) == [i for i, w in windows if n_of[w] > 1]
    of = dict(zip(at.tolist(), lo.tolist()))
    assert len({(of[i], w) for i, w in windows if i in of}) == len(set(of.values())) == sum(n > 1 for n in n_of.values())
    first = {}
    want = [i for i, w in windows if first.setdefault(w, i) != i]
    assert np.flatnonzero(fm_dedup.earlier_windows(text, starts, sizes, 5)).tolist() == want


def test_bits_keep_equal_words_once():
    rng = np.random.default_rng(5)
    runs = np.repeat(rng.integers(0, 2, 60).astype(bool), 700)
    bits = fm_dedup.Bits(runs)
    at = np.arange(len(runs) + 1)
    assert bits.ones(at).tolist() == [0, *np.cumsum(runs).tolist()]
    assert bits.nbytes < len(runs) / 8


def test_leftmost_minima():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 5, 300).astype(np.uint64) << np.uint64(40)
    for width in (1, 2, 7, 8, 77):
        assert regions.leftmost_minima(h, width).tolist() == [i + int(np.argmin(h[i:i + width])) for i in range(len(h) - width + 1)]


@pytest.mark.parametrize("words", [False, True])
def test_regions_fall_evenly_into_parts(words):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(75_000)).encode()
    op = fm_dedup if words else suffix_dedup
    symbols = regions.Symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)
    anchor = regions.regions(symbols, op.LENGTH, op.GRAM)[3]
    count = np.bincount((anchor >> np.uint64(58)).astype(np.int64), minlength=64)
    assert len(anchor) > 6400 and count.max() < 2 * len(anchor) / 64


def test_suffix_dedup(spark, rows):
    from tests.llm.conftest import frame
    rows = single(rows)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeated_bytes(frame(spark, rows).repartition(4)).collect()}
    seen = set()
    for i, t in ordered(rows):
        b = t.encode()
        m = covered(b, 100, seen)
        kept = bytes(x for x, gone in zip(b, m) if not gone)
        r = got[i]
        spans = sum(x and not (k and m[k - 1]) for k, x in enumerate(m))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (len(b), sum(m), spans, kept)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_fm_dedup(spark, rows):
    from tests.llm.conftest import frame
    rows = single(rows)
    got = {r["doc_id"]: r for r in fm_dedup.remove_repeated_words(frame(spark, rows).repartition(4)).collect()}
    seen = set()
    for i, t in ordered(rows):
        w = tuple(WORD.findall(t))
        m = covered(w, 20, seen)
        kept = " ".join(x for x, gone in zip(w, m) if not gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"]) == (len(w), sum(m), kept)


@pytest.mark.parametrize("words", [False, True])
def test_frequent_line_is_split(spark, words):
    from tests.llm.conftest import frame
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    line = " ".join(f"line{i:02d}" for i in range(14 if words else 12))  # shorter than a window
    ends = [text(9) for _ in range(6)]  # so that windows with the line repeat in regions that differ
    rows = [(i, f"{text(30)} {rng.choice(ends)} {line} {rng.choice(ends)} {text(30)}" if i % 3 == 0 else text(60)) for i in range(600)]
    length, gram = (fm_dedup.LENGTH, fm_dedup.GRAM) if words else (suffix_dedup.LENGTH, suffix_dedup.GRAM)
    find = (fm_dedup if words else suffix_dedup).earlier_windows

    def solve(symbols, *rest):
        if len(symbols) > 4000:
            raise ValueError(f"{len(symbols)} symbols at once")
        return find(symbols, *rest)

    docs = regions.identified(frame(spark, rows).repartition(4), "doc_id", "text")
    got = {r["doc"]: {p for off, n in r["spans"] for p in range(off, off + n)}
           for r in regions.removed_spans(docs, length, gram, words, solve, 2000).collect()}
    seen, total = set(), 0
    for i, t in ordered(rows):
        m = covered(tuple(WORD.findall(t)) if words else t.encode(), length, seen)
        assert got.get(i, set()) == {p for p, gone in enumerate(m) if gone}
        total += sum(m)
    assert total > 1000


@pytest.mark.parametrize("op", [suffix_dedup.remove_repeated_bytes, fm_dedup.remove_repeated_words])
def test_repeated_rows_and_ids(spark, op, docs, empty, rows):
    out = op(docs).collect()
    assert len(out) == len(rows)
    same = [tuple(r) for r in out if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]  # a repeated row is one document
    assert sum(r["doc_id"] is None for r in out) == 2
    twice = spark.createDataFrame([(5, "w%d " * 60 % tuple(range(60))), (5, "v " + "w%d " * 60 % tuple(range(60)))], "doc_id long, text string")
    removed = sorted(r["n_removed"] for r in op(twice).collect())
    assert removed[0] == 0 and removed[1] > 0  # one id, two texts: one is first
    assert op(empty).count() == 0


def shingles(t, n):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def union_find(ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find, join


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, rows, n, percent):
    from tests.llm.conftest import frame
    rng = random.Random(n)
    rows = [r for r in single(rows) if r[0] is not None]
    base = [f"w{i}" for i in range(60)]
    for k in range(40):  # chains of near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 9)}"
        rows.append((1000 + k, " ".join(w)))
    for k in range(30):  # small sets
        rows.append((2000 + k, " ".join(f"q{j}" for j in range(rng.randint(0, 3), 9 + rng.randint(0, 6)))))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard.jaccard_components(frame(spark, rows).repartition(3), n, percent).collect()}
    sets = {i: shingles(t, n) for i, t in rows}
    find, join = union_find(sets)
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    join(a, b)
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(got) - 20


def test_jaccard_edges(docs, empty, rows):
    out = jaccard.jaccard_components(docs).collect()
    assert len(out) == len(rows)
    assert {r["n_shingles"] for r in out if r["doc_id"] in (300, 301, 302)} == {0}
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[0] == 1 and ids[100] == 0 and ids[300] == 1 and ids[None] == 2


def test_jaccard_null_ids(spark):
    text = lambda c, *more: " ".join([*(f"{c}{i}" for i in range(60)), *more])
    rows = [(None, text("a")), (1, text("a", "x")), (2, text("a", "y")),  # a group with a null id: that row stays
            (None, text("b")), (3, text("b", "x")), (4, text("c")), (5, text("c", "x")), (-7, text("d")),
            (None, text("e")), (6, text("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard.jaccard_components(df).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in out) == Counter(
        [(None, None)] * 3 + [(1, None), (2, None), (3, None), (4, 4), (5, 4), (-7, -7), (6, 6)])
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(df).collect())
    assert kept == Counter([rows[0], rows[3], rows[5], rows[7], rows[8], rows[9]])


def test_jaccard_null_ids_are_nodes_of_their_own(spark, monkeypatch):
    seen, make = [], jaccard.components
    monkeypatch.setattr(jaccard, "components", lambda e: seen.append(make(e)) or seen[-1])
    rows = [(i, " ".join([*(f"{c}{k}" for k in range(60)), *([f"x{i}"] if i else [])])) for c, ids in (("a", (None, 1, 2)), ("b", (None, 3))) for i in ids]
    jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["id"]: r["component"] for r in seen[-1].collect()}
    assert found[1] == found[2] != found[3]  # not linked, so not one component


@pytest.mark.parametrize("percent", [85, 80])
def test_partenum_signatures_meet(percent):
    """Every pair at the threshold shares a signature, also with empty parts."""
    rng = random.Random(9)
    for _ in range(300):
        size = rng.choice([1, 3, 6, 7, 12, 13, 20, 40, 90])
        a = [f"f{rng.random()}" for _ in range(size + 3)]
        drop = rng.randint(0, max(0, size * (100 - percent) // (100 + percent)))
        b = a[:len(a) - drop] + [f"g{rng.random()}" for _ in range(rng.randint(0, drop))]
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        offs = np.cumsum([0, *map(len, texts)])
        s = jaccard.Sets(np.frombuffer(b"".join(texts), np.uint8), offs, 4)
        x, y = (set(s.hash[s.bounds[i]:s.bounds[i + 1]].tolist()) for i in (0, 1))
        if 100 * len(x & y) >= percent * len(x | y):
            sig, row = s.signatures(np.array([0, 1]), percent)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(500, k) for k in range(501, 560)]
    find, join = union_find({x for e in edges for x in e})
    for a, b in edges:
        join(a, b)
    got = {r["id"]: r["component"] for r in stage.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.4])).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)] + [rows[0]]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [1.0, None] * 8, 1),
             (305, rows[1][1], None), (306, [1.0, 2.0], 0), (307, [2.0, 4.0], 0), (308, [1e-200] * 16, 0), (309, [1e300] * 16, 0),
             (None, rows[2][1], rows[2][2])]
    schema = "vec_id long, embedding array<double>, label int, id int, rep string, v int, copies int"
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema).repartition(3)
    got = [tuple(r) for r in embed_dedup.embedding_duplicates(df, 0.93, block=32).collect()]
    uniq = {}
    for i, v, label in rows:
        uniq[i] = (v, label)
    low = -1  # the null id sorts first
    find, join = union_find([low if i is None else i for i in uniq])
    links = Counter()

    def unit(v):
        m = max(abs(x) for x in v)
        n = math.sqrt(sum((x / m) ** 2 for x in v))
        return np.array([x / m / n for x in v])
    ok = {(low if i is None else i): (unit(v), label) for i, (v, label) in uniq.items()
          if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= 0.93:
                links[a] += 1
                links[b] += 1
                join(a, b)
    null = lambda x: None if x == low else x
    want = [(i, links[low if i is None else i], null(find(low if i is None else i)), find(low if i is None else i) == (low if i is None else i)) for i, _, _ in rows]
    assert Counter(got) == Counter(want)
    assert sum(links.values()) > 100
    assert embed_dedup.embedding_duplicates(df.limit(0)).count() == 0


def test_an_id_with_several_vectors_links_nothing_by_itself(spark):
    e = lambda k, x=0.0: [1.0 if i == k else x * (i == 7) for i in range(8)]
    rows = [(1, e(0), 0), (1, e(1), 0), (1, e(2), 1), (2, e(0, 0.1), 0), (3, e(1, 0.1), 0), (4, e(2, 0.1), 1), (5, e(3), 1), (0, e(1, 0.05), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in embed_dedup.embedding_duplicates(df, 0.93).collect())
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), (1, 2, 0, False), (3, 2, 0, False), (0, 2, 0, True),
                           (1, 1, 1, True), (4, 1, 1, False), (5, 0, 5, True)])


def test_tile_bound_drops_nothing():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(60, 12)), rng.normal(size=(50, 12))
    b[:30] = a[:30] + rng.normal(size=(30, 12)) * 0.3
    basis = embed_dedup.axes(list(a))[12]
    i, j = embed_dedup.tile_links(a, b, basis, 0.9, False)
    full = embed_dedup.unit(a) @ embed_dedup.unit(b).T >= 0.9
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(full))))
