"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (lower-cased run of letters, digits and non-ASCII bytes) has three hashed embeddings: of
the whole word and of its first 6 and 8 bytes.  Stems so share weights between their
inflections, and words that share one bucket still differ in the others.  Filters of widths 1, 2
and 3 slide over the whole text.  Each is max-pooled over the windows at 0, 1 and 2 modulo 3;
the three maxima, sorted, tell one strong window from several, and go into a logistic layer.  Only the text is an
input of the score.  The model is fitted on all labelled documents, each taken whole.  Up to ``SHARD_DOCS``
of them (and ``SHARD_BYTES`` of text) are fitted on the driver.  More are dealt by a hash of the id into shards of
about that size, written once as bucket numbers; in each epoch every shard is descended in a task of its own from the
common model, and the shards' changes are averaged (iterative parameter mixing): an embedding over the shards that
changed it, everything else over all.  Embedding buckets seen in fewer than ``MIN_DF`` training documents stay zero, so rare words
can't be memorised.  A fold is held back to calibrate the score as a
probability and to set one decision threshold per language: its own best one, drawn towards the common
one by the number of its calibration rows.

Scoring reads every text once, in Arrow batches, without a shuffle.

Edge cases: a null or empty text is scored as a text without words; very long texts are
scored whole; repeated rows get equal scores; further columns are ignored; an empty documents
table gives no rows; without labelled rows of both classes the score is the share of
label 1 (0 without any labels).
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm import textpack as tp
from demandlens.llm.stage import partitions, small_batches
from demandlens.session import materialize

BUCKETS = 1 << 18
PREFIXES = (None, 6, 8)  # bytes of a word that an embedding sees; None: all
PARTS = len(PREFIXES)
DIM = 6           # of each embedding
STRIDE = 3        # windows are pooled by their position modulo STRIDE
WIDTHS = (1, 2, 3)
FILTERS = 8       # of each width
PAD = 2           # zero words after each text, so that no window spans two texts
SHARD_DOCS = 10000
SHARD_BYTES = 48 << 20  # of text; a word takes 12 bytes as bucket numbers
MAX_BROADCAST_LABELS = 2_000_000
MAX_CALIBRATION = 1 << 20  # different calibration rows; beyond, logits are rounded to 1 / 1024
BLOCKS = 16       # of the buckets, when the shards' changes are added up
MIN_DF = 5
EPOCHS = 4
BATCH = 64
SHRINK = 20       # rows that the common threshold counts for against a language's own


@dataclass
class Model:
    emb: list[np.ndarray]                # per part: (BUCKETS + 1, DIM); the last row is the pad
    conv: list[np.ndarray]               # per width: (width, PARTS * DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    base: float | None = None            # constant score when nothing could be learned
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5


def buckets(words: tp.Words) -> np.ndarray:
    """(PARTS, n) int32 buckets of words."""
    out = np.empty((PARTS, len(words.start)), np.int32)
    for i, size in enumerate(PREFIXES):
        h = words.hash if size is None else tp.range_hash(words.prefix, words.start, np.minimum(words.start + size, words.end))
        out[i] = tp.mix(h + np.uint64(i)) & np.uint64(BUCKETS - 1)
    return out


def layout(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of the words of texts with these word counts when at least PAD zero words
    follow each text, the first block of STRIDE windows of each text, and the size."""
    blocks = -(-(np.maximum(counts, 1) + PAD) // STRIDE)
    begin = np.cumsum(blocks) - blocks
    return tp.segment_ranges(begin * STRIDE, counts), begin, int(blocks.sum()) * STRIDE


def features(model: Model, b: np.ndarray, counts: np.ndarray, keep: bool = False):
    """(texts, STRIDE, filters) pooled filter outputs; with keep also what the gradient needs.
    Only windows that start on a word count (on the first pad in a text without words)."""
    at, begin, size = layout(counts)
    e = np.zeros((size + max(WIDTHS), PARTS * DIM), np.float32)
    for i in range(PARTS):
        e[at, i * DIM:(i + 1) * DIM] = model.emb[i][b[i]]
    inside = np.zeros(size + 1, bool)
    inside[at] = True
    inside[begin * STRIDE] = True
    conv, pooled = [], []
    for w, k in zip(WIDTHS, model.conv):
        o = e[:size] @ k[0]
        for j in range(1, w):
            o += e[j:size + j] @ k[j]
        o[~inside[:size]] = -1e9
        if keep:
            conv.append(o)
        pooled.append(np.maximum.reduceat(o.reshape(-1, STRIDE, FILTERS), begin, axis=0))
    x = np.concatenate(pooled, axis=2) + model.bias
    return (x, at, e, conv, begin) if keep else x


def ranked(x: np.ndarray) -> np.ndarray:
    """Inputs of the logistic layer: rectified maxima, largest first."""
    return np.maximum(-np.sort(-x, axis=1), 0).reshape(len(x), -1)


def logits(model: Model, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = ranked(features(model, b, counts)) @ model.out[:-1] + model.out[-1]
    return x * model.scale[0] + model.scale[1]


def scores(model: Model, b: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if model.base is not None:
        return np.full(len(counts), model.base)
    return 1 / (1 + np.exp(-np.clip(logits(model, b, counts).astype(np.float64), -30, 30)))


def _first_hits(o: np.ndarray, begin: np.ndarray, top: np.ndarray) -> np.ndarray:
    """(texts, STRIDE, filters): first window of each text and residue with the pooled value."""
    o = o.reshape(-1, STRIDE, FILTERS)
    n = np.diff(np.append(begin, len(o)))
    row = np.repeat(np.arange(len(n)), n)
    block, r, f = np.nonzero(o == top[row])
    first = np.zeros(top.shape, np.int64)
    back = slice(None, None, -1)  # the last write is the first window
    first[row[block][back], r[back], f[back]] = (block * STRIDE + r)[back]
    return first


@dataclass
class Descent:
    """Moments of Adam (dense parameters) and AdaGrad (embeddings)."""
    m1: list[np.ndarray]
    m2: list[np.ndarray]
    g2: list[np.ndarray]
    step: int = 0


def dense(model: Model) -> list[np.ndarray]:
    return [*model.conv, model.bias, model.out]


def empty() -> Model:
    zero = lambda *s: np.zeros(s, np.float32)
    return Model([zero(BUCKETS + 1, DIM) for _ in PREFIXES], [zero(w, PARTS * DIM, FILTERS) for w in WIDTHS],
                 zero(len(WIDTHS) * FILTERS), zero(STRIDE * len(WIDTHS) * FILTERS + 1))


def doc_counts(docs: list[np.ndarray], y: np.ndarray, train: np.ndarray) -> list[np.ndarray]:
    """Per part: (2, BUCKETS) training documents of each class that have the bucket."""
    out = []
    for half in range(PARTS):
        df = np.zeros((2, BUCKETS))
        for i in train:
            df[int(y[i]), np.unique(docs[i][half])] += 1
        out.append(df)
    return out


def start(df: list[np.ndarray], n: list[int], rng: np.random.Generator) -> tuple[Model, Descent]:
    """Model and state before the first epoch, from the training documents with each bucket and of each class.
    First dimension = smoothed log odds of the bucket, others small; rare buckets zero."""
    model = empty()
    for d, emb in zip(df, model.emb):
        odds = np.log((d[1] + 0.5) / (n[1] + 1)) - np.log((d[0] + 0.5) / (n[0] + 1))
        often = d.sum(0) >= MIN_DF
        emb[:-1] = rng.normal(0, 0.05, (BUCKETS, DIM)) * often[:, None]
        emb[:-1, 0] = odds * often * 0.5
    model.conv = [rng.normal(0, 0.2, (w, PARTS * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in model.conv:  # half of the filters start on the log odds
        k[0, ::DIM, :FILTERS // 2] = 0.5
    model.out[:-1] = rng.normal(0, 0.1, len(model.out) - 1)
    share = n[1] / (n[0] + n[1])
    model.out[-1] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    return model, Descent([np.zeros_like(p) for p in dense(model)], [np.zeros_like(p) for p in dense(model)],
                          [np.full(BUCKETS + 1, 1e-8) for _ in PREFIXES])


def epoch(model: Model, state: Descent, docs: list[np.ndarray], y: np.ndarray, rows: np.ndarray) -> None:
    """One pass over these rows in this order, in batches; changes model and state."""
    for part in np.array_split(rows, max(1, len(rows) // BATCH)):
        counts = np.array([docs[i].shape[1] for i in part])
        b = np.concatenate([docs[i] for i in part], axis=1)
        x, at, e, conv, begin = features(model, b, counts, keep=True)
        order = np.argsort(-x, axis=1, kind="stable")
        act = ranked(x)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out[:-1] + model.out[-1], -30, 30)))
        d = ((p - y[part]) / len(part)).astype(np.float32)
        grads = [np.zeros_like(k) for k in model.conv] + [None, np.append(act.T @ d, d.sum()).astype(np.float32)]
        dx = np.zeros_like(x)
        np.put_along_axis(dx, order, (d[:, None] * model.out[:-1]).reshape(x.shape), axis=1)
        dx *= x > 0
        grads[len(WIDTHS)] = dx.sum((0, 1))
        ge = np.zeros_like(e)
        for c, w in enumerate(WIDTHS):
            cols = slice(c * FILTERS, (c + 1) * FILTERS)
            first = _first_hits(conv[c], begin, x[:, :, cols] - model.bias[cols])
            for j in range(w):
                for f in range(FILTERS):
                    pos, g = first[:, :, f].ravel() + j, dx[:, :, cols][:, :, f].ravel()
                    pos, g = pos[g != 0], g[g != 0]
                    grads[c][j, :, f] += g @ e[pos]
                    np.add.at(ge, pos, g[:, None] * model.conv[c][j, :, f])
        state.step += 1
        for q, m1, m2, g in zip(dense(model), state.m1, state.m2, grads):  # Adam
            g = g + 1e-4 * q
            m1[:] = 0.9 * m1 + 0.1 * g
            m2[:] = 0.99 * m2 + 0.01 * g * g
            q -= 0.01 * (m1 / (1 - 0.9 ** state.step)) / (np.sqrt(m2 / (1 - 0.99 ** state.step)) + 1e-8)
        used = np.flatnonzero(np.abs(ge[at]).sum(1))
        for half, emb in enumerate(model.emb):  # AdaGrad on the touched rows
            rows_, inv = np.unique(b[half, used], return_inverse=True)
            g = np.zeros((len(rows_), DIM), np.float32)
            np.add.at(g, inv, ge[at[used], half * DIM:(half + 1) * DIM])
            g *= (np.abs(emb[rows_]).sum(1) > 0)[:, None]  # rare buckets and the pad stay zero
            state.g2[half][rows_] += (g * g).mean(1)
            emb[rows_] -= (0.02 * g / np.sqrt(state.g2[half][rows_])[:, None]).astype(np.float32)


def fit(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], fold: np.ndarray, seed: int = 7) -> Model:
    """docs: (PARTS, n) buckets per text; fold True: held back for calibration."""
    rng = np.random.default_rng(seed)
    train = np.flatnonzero(~fold)
    if not len(y) or y[train].min(initial=1) == y[train].max(initial=0) or len(train) == 0:
        model = empty()
        model.base = float(y.mean()) if len(y) else 0.0
        return model
    model, state = start(doc_counts(docs, y, train), [int((y[train] == c).sum()) for c in (0, 1)], rng)
    for _ in range(EPOCHS):
        epoch(model, state, docs, y, rng.permutation(train))
    held = np.flatnonzero(fold) if y[fold].min(initial=1) < y[fold].max(initial=0) else np.arange(len(y))
    calibrate(model, raw_logits(model, docs, held), y[held], np.array([str(langs[i]) for i in held]))
    return model


def raw_logits(model: Model, docs: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(logits(model, docs[i], np.array([docs[i].shape[1]])) for i in rows)]).astype(np.float64)


def calibrate(model: Model, raw: np.ndarray, y: np.ndarray, lang: np.ndarray, n: np.ndarray | None = None) -> None:
    """Sets scale and thresholds from logits, labels and languages of the calibration rows; n: how often each row comes."""
    n = np.ones(len(y)) if n is None else n
    model.scale = _platt(raw, y, n)
    s = 1 / (1 + np.exp(-np.clip(raw * model.scale[0] + model.scale[1], -30, 30)))
    model.threshold = _best_threshold(s, y, n)
    odds = lambda t: np.log(np.clip(t, 1e-6, 1 - 1e-6) / (1 - np.clip(t, 1e-6, 1 - 1e-6)))
    for name in np.unique(lang):
        own = lang == name
        # a language's own best threshold counts by the rows of its rarer class against SHRINK rows of the common one
        few = min((n * y)[own].sum(), (n * (1 - y))[own].sum())
        share = few / (few + SHRINK)
        mixed = odds(model.threshold) if not few else share * odds(_best_threshold(s[own], y[own], n[own])) + (1 - share) * odds(model.threshold)
        model.thresholds[str(name)] = float(1 / (1 + np.exp(-mixed)))


def _platt(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets, by Newton's method."""
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - t) * x).sum() + 1e-3 * (a - 1), (n * (p - t)).sum()])
        w = n * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]]) + 1e-9 * np.eye(2)
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _best_threshold(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Middle of the score gap whose cut has the best F1."""
    order = np.argsort(-s, kind="stable")
    tp_ = np.cumsum((n * y)[order])
    f1 = 2 * tp_ / (np.cumsum(n[order]) + (n * y).sum())
    last = np.append(s[order][1:] < s[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[order][k] + (s[order][k + 1] if k + 1 < len(s) else 0.0)) / 2)


# --- labelled documents beyond one shard -------------------------------------------

_SUMS = "part int, shard int, place binary, value binary"
_DENSE = PARTS * BLOCKS   # the part of the values that belong to no bucket
_BLOCK = BUCKETS // BLOCKS


def _shard(batches) -> tuple[int, list[np.ndarray], np.ndarray, list[str | None], np.ndarray]:
    """(shard, docs, y, langs, fold) of rows (shard, id, text hash, words, buckets, lang, y) in order of id and text hash;
    rows that repeat both are one."""
    shard, docs, y, langs, fold, last = -1, [], [], [], [], None
    for b in batches:
        cells = b.column(4)
        for r, (s, i, h, n, lang, label) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6)))):
            if (i, h) == last:
                continue
            shard, last = s, (i, h)
            docs.append(np.frombuffer(pa.decompress(cells[r].as_buffer(), 4 * PARTS * n, codec="zstd"), np.int32).reshape(PARTS, n)
                        if n else np.zeros((PARTS, 0), np.int32))
            y.append(label)
            langs.append(lang)
            fold.append(hash_id(i) % 5 == 0)
    return shard, docs, np.array(y, np.float64), langs, np.array(fold, bool)


def _told(shard: int, parts) -> pa.RecordBatch:
    """A batch of (part, places, values at them) as rows of _SUMS."""
    part, place, value = zip(*parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array([shard] * len(part), pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in place], pa.binary()),
         pa.array([v.astype(np.float32).tobytes() for v in value], pa.binary())], ["part", "shard", "place", "value"])


def _by_block(half: int, at: np.ndarray, value: np.ndarray):
    """(part, places, values) of each block that has some of the sorted buckets ``at``."""
    cut = np.searchsorted(at, np.arange(BLOCKS + 1) * _BLOCK)
    for k in np.flatnonzero(np.diff(cut)):
        own = slice(cut[k], cut[k + 1])
        yield half * BLOCKS + int(k), at[own] - k * _BLOCK, value[own]


def added(sums: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """part -> (places, sums of the values there, number of shards that gave one).  Shards are added in their order,
    one block of places at a time; the driver gets a row for each part."""
    def add(batches):
        def row():
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at, total[at], n[at]))],
                                              ["part", "place", "value", "n"])
        now = total = n = None
        for b in batches:
            for part, place, value in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                at = np.frombuffer(place, np.int32)
                value = np.frombuffer(value, np.float32).reshape(len(at), -1)
                if part != now:
                    if now is not None:
                        yield row()
                    now, total, n = part, np.zeros((_BLOCK, value.shape[1])), np.zeros(_BLOCK, np.int64)
                total[at] += value
                n[at] += 1
        if now is not None:
            yield row()

    tasks = min(partitions(sums.sparkSession), _DENSE + 1)
    got = (sums.repartitionById(tasks, "part").sortWithinPartitions("part", "shard")
           .mapInArrow(add, "part int, place binary, value binary, n binary").toArrow())
    out = {}
    for part, place, value, n in zip(*(c.to_pylist() for c in got.columns)):
        at = np.frombuffer(place, np.int64)
        half = 0 if part == _DENSE else part % BLOCKS
        out[part] = at + half * _BLOCK, np.frombuffer(value, np.float64).reshape(len(at), -1), np.frombuffer(n, np.int64)
    return out


def _count_shard(batches):
    shard, docs, y, _, fold = _shard(batches)
    if not docs:
        return
    own = [float(((y == c) & (fold == f)).sum()) for f in (False, True) for c in (0, 1)]
    parts = [(_DENSE, np.arange(4), np.array(own))]
    for half, df in enumerate(doc_counts(docs, y, np.flatnonzero(~fold))):
        at = np.flatnonzero(df.sum(0))
        parts += _by_block(half, at, df[:, at].T)
    yield _told(shard, parts)


def _mixed(model: Model, state: Descent, changes: dict) -> None:
    """Applies the mean changes of an epoch."""
    for part, (at, value, n) in changes.items():
        mean = value / n[:, None]
        if part < _DENSE:
            half = part // BLOCKS
            model.emb[half][at] += mean[:, :DIM].astype(np.float32)
            state.g2[half][at] += mean[:, DIM]
            continue
        flat, at = mean[:, 0], 0
        for kind in (dense(model), state.m1, state.m2):
            for x in kind:
                x += flat[at:at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        state.step += round(float(flat[at]))


def fit_shards(rows: DataFrame, seed: int = 7) -> Model:
    """fit() of rows (shard, id, text hash, words, buckets, lang, y), a shard in each partition, in order of id and text hash."""
    sc = rows.sparkSession.sparkContext
    counts = added(rows.mapInArrow(_count_shard, _SUMS))
    n = counts[_DENSE][1][:, 0].reshape(2, 2) if counts else np.zeros((2, 2))   # fold, class
    if not n[0].all():
        model = empty()
        model.base = float(n[:, 1].sum() / n.sum()) if n.sum() else 0.0
        return model
    df = [np.zeros((2, BUCKETS)) for _ in PREFIXES]
    for part, (at, value, _) in counts.items():
        if part < _DENSE:
            df[part // BLOCKS][:, at] = value.T
    model, state = start(df, [int(x) for x in n[0]], np.random.default_rng(seed))
    for k in range(EPOCHS):
        shared = sc.broadcast((model, state))

        def descend(batches):
            shard, docs, y, _, fold = _shard(batches)
            train = np.flatnonzero(~fold)
            if not len(train):
                return
            was_m, was_s = shared.value
            m, s = copy.deepcopy(shared.value)   # a worker's next task gets the same value
            epoch(m, s, docs, y, np.random.default_rng([seed, k, shard]).permutation(train))
            pairs = [*zip(dense(m), dense(was_m)), *zip(s.m1, was_s.m1), *zip(s.m2, was_s.m2)]
            flat = np.concatenate([*((x - was).ravel() for x, was in pairs), [s.step - was_s.step]])
            parts = [(_DENSE, np.arange(len(flat)), flat)]
            for half in range(PARTS):
                at = np.flatnonzero(s.g2[half] != was_s.g2[half])
                moved = np.column_stack([m.emb[half][at] - was_m.emb[half][at], s.g2[half][at] - was_s.g2[half][at]])
                parts += _by_block(half, at, moved)
            yield _told(shard, parts)

        _mixed(model, state, added(rows.mapInArrow(descend, _SUMS)))
        shared.destroy()
    own_fold, many = bool(n[1].all()), (n[1] if n[1].all() else n).sum() > MAX_CALIBRATION
    shared = sc.broadcast(model)

    def judge(batches):
        _, docs, y, langs, fold = _shard(batches)
        held = np.flatnonzero(fold) if own_fold else np.arange(len(y))
        raw = raw_logits(shared.value, docs, held)
        raw = np.round(raw * 1024) / 1024 if many else raw
        yield pa.RecordBatch.from_arrays([pa.array([str(langs[i]) for i in held], pa.string()), pa.array(y[held]), pa.array(raw)], ["l", "y", "raw"])

    got = (rows.mapInArrow(judge, "l string, y double, raw double").groupBy("l", "y", "raw").agg(F.count(F.lit(1)).cast("double").alias("n"))
           .toArrow().sort_by([("l", "ascending"), ("raw", "ascending"), ("y", "ascending")]))
    calibrate(model, got["raw"].to_numpy(), got["y"].to_numpy(), np.array(got["l"].to_pylist()), got["n"].to_numpy())
    shared.destroy()
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", label_col: str = "toxic", max_train: int | None = None,
          max_words: int | None = None, usable=None) -> Model:
    """Fit on all labelled documents (those for which the column ``usable`` holds; by default those whose
    crc32(id) mod 4 is not 2).  Rows that repeat an id and text are one; documents are taken whole.  Beyond one
    shard, only counts and mean changes of the parameters travel to the driver.

    ``max_train`` and ``max_words`` ask for less: documents in the order of a hash, until a bound is reached,
    fitted on the driver."""
    small_batches(docs.sparkSession)
    usable = held_out(id_col) == F.lit(False) if usable is None else usable
    chosen = (labels.filter(usable).filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y")))
    bounded = max_train is not None or max_words is not None
    if max_train is not None:
        chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    if chosen.count() <= MAX_BROADCAST_LABELS:
        chosen = F.broadcast(chosen)
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.col(lang_col).cast("string").alias("_l"))
            .join(chosen, "_id").withColumn("_y", F.col("_y").cast("int")))
    table = tp.letter_table()
    kind = "string" if rows.schema["_id"].dataType.simpleString() == "string" else "bigint"

    def found(column):
        """(PARTS, n) buckets of every text."""
        for lo, hi, buf, offs in tp.chunks(column):
            w = tp.Words(buf, offs, table)
            b = buckets(w)
            for r in range(hi - lo):
                yield b[:, w.bounds[r]:w.bounds[r + 1]]

    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("b")).first()
    shards = 1 if bounded else max(1, -(-size["n"] // SHARD_DOCS), -(-size["b"] // SHARD_BYTES))
    if shards > 1:
        def packed(batches):
            seen = set()   # copies go where they are read, as far as a task sees them
            for b in batches:
                keys = list(zip(*(b.column(c).to_pylist() for c in (1, 2, 4))))
                new = [r for r, key in enumerate(keys) if not (key in seen or seen.add(key))]
                b = b.take(pa.array(new, pa.int32()))
                cells = list(found(b.column(3)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([c.shape[1] for c in cells], pa.int32()),
                     pa.array([pa.compress(c.tobytes(), codec="zstd", asbytes=True) for c in cells], pa.binary()), b.column(4), b.column(5)],
                    ["s", "id", "h", "n", "b", "l", "y"])

        parts = (rows.select(F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int").alias("s"), F.col("_id").cast(kind), F.xxhash64("_t"), "_t", "_l", "_y")
                 .mapInArrow(packed, f"s int, id {kind}, h bigint, n int, b binary, l string, y int"))
        return fit_shards(materialize(parts.repartitionById(shards, "s").sortWithinPartitions("id", "h", F.asc_nulls_last("l"))))

    def hashed(batches):
        for b in batches:
            cells = [c.tobytes() for c in found(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), b.column(2), b.column(3)],
                                             ["id", "b", "l", "y"])

    once = rows.groupBy("_id", "_t").agg(F.min("_l").alias("_l"), F.min("_y").alias("_y"))
    sample = once.mapInArrow(hashed, f"id {kind}, b binary, l string, y int").withColumn("h", F.xxhash64("id", "b"))
    if max_train is not None:
        sample = sample.orderBy("h", "id").limit(max_train)
    if max_words is not None:
        upto = F.sum(F.octet_length("b")).over(Window.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
        sample = sample.withColumn("upto", upto).filter(F.col("upto") <= 4 * PARTS * max_words)
    got = sample.select("id", "b", "l", "y", "h").toArrow()
    # the rows are held once: the rest is put in order, the bucket numbers are read where they are
    order = pc.sort_indices(got, sort_keys=[("id", "ascending"), ("h", "ascending")])
    cells = in_place(got["b"])
    data = [cells[i] for i in order.to_pylist()]
    rest = got.select(["id", "l", "y"]).take(order)
    y = np.array(rest["y"].to_pylist(), np.float64)
    ids = np.array([hash_id(x) for x in rest["id"].to_pylist()])
    return fit(data, y, rest["l"].to_pylist(), ids % 5 == 0)


def in_place(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The bucket numbers of every row of a binary column, (PARTS, n), as views of its memory."""
    out = []
    for chunk in column.chunks:
        _, at, values = chunk.buffers()
        wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        at = np.frombuffer(at, wide)[chunk.offset:chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, wide)
        flat = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        out += [flat[lo:hi].view(np.int32).reshape(PARTS, -1) for lo, hi in zip(at[:-1], at[1:])]
    return out


def hash_id(x) -> int:
    import zlib
    return zlib.crc32(f"fold:{x}".encode())


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> DataFrame:
    """(id, score, threshold, rejected): rejected when the score reaches the threshold of the row's
    language (the common one for a language that the calibration rows lack)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = tp.letter_table()

    def run(batches):
        m = shared.value
        for b in batches:
            out = [np.zeros(0)]
            for _, _, buf, offs in tp.chunks(b.column(1)):
                w = tp.Words(buf, offs, table)
                out.append(scores(m, buckets(w), np.diff(w.bounds)))
            s = np.concatenate(out)
            limit = np.array([m.thresholds.get(str(x.as_py()), m.threshold) for x in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(limit, pa.float64()),
                                              pa.array(s >= limit)], [id_col, "score", "threshold", "rejected"])

    rows = docs.select(F.col(id_col), F.col(text_col), F.col(lang_col).cast("string"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, threshold double, rejected boolean")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The rows of docs (all columns) whose score stays below their language's threshold.
    The text is scored where it is read; no join brings the decision back."""
    model = train(docs, labels, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    table = tp.letter_table()
    t, g = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        m = shared.value
        for b in batches:
            out = [np.zeros(0)]
            for _, _, buf, offs in tp.chunks(b.column(t)):
                w = tp.Words(buf, offs, table)
                out.append(scores(m, buckets(w), np.diff(w.bounds)))
            limit = np.array([m.thresholds.get(str(x.as_py()), m.threshold) for x in b.column(g)])
            yield b.filter(pa.array(np.concatenate(out) < limit))

    return docs.mapInArrow(run, docs.schema)
