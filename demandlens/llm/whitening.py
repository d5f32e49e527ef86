"""Embedding whitening by QDWH spectral divide-and-conquer.

Entries become whole numbers x = floor(grid * c) + offset.  The fit list is each distinct
x-vector once; its exact sums S and its covariance V (divisor n, centred before multiplying) are
aggregations over Spark tasks, of which the driver receives d (d + 1) / 2 numbers for vectors
of length d.  There the eigenvectors of V come from polar decompositions: the unitary polar
factor U of V - s I, by QR-based dynamically weighted Halley iterations, gives the projector
(U + I) / 2 on the invariant subspace of the eigenvalues above the shift s; an orthonormal
basis of it and of its complement splits V into two smaller blocks, which are split in turn,
down to single components or multiples of the identity.  The leading components (at most
``components`` x d numbers) then travel to the tasks, which project the rows.

``whitened`` is (x - S / n) . v / sqrt(e) for the unit eigenvector v of eigenvalue e, numbered by
falling e; the largest entry of v in absolute value (the first on ties) is positive.
``identity_error`` is the largest absolute entry of the whitened fit list's covariance less the
identity, from two more aggregations over the fit list.

Edge cases: vectors that are null, empty, hold null or non-finite entries, or entries whose x
passes 2^62 are dropped; repeated rows and null ids are kept and get their result each, while
the fit list holds their vector once; vectors of different length (at most ``MAX_LENGTHS`` lengths, of at
most ``MAX_LENGTH`` entries; more is an error) are spaces of their own, each with its own n and
components; components whose eigenvalue is 0 to double precision (below d * 2^-50 of the
largest) have no whitening and are left out, so that equal vectors alone give no rows; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.stage import staged

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_LENGTH, MAX_LENGTHS = 4096, 64
EPS = 2.0 ** -52


def polar(a: np.ndarray) -> np.ndarray | None:
    """Unitary polar factor of a symmetric matrix by QR-based QDWH iterations; None where a is
    singular to double precision (the factor is then not unique)."""
    n = len(a)
    alpha = np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    if not alpha > 0:
        return None
    x, low, eye = a / alpha, EPS / 4, np.eye(n)
    for _ in range(30):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2)) if low < 1 else 0.0
        ha = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * np.sqrt(1 + d)))
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(hc) * x, eye]))
        new = hb / hc * x + (ha - hb / hc) / np.sqrt(hc) * q[:n] @ q[n:].T
        new = (new + new.T) / 2
        low = min(1.0, low * (ha + hb * l2) / (1 + hc * l2))
        done = np.linalg.norm(new - x) <= 1e-14 * n and 1 - low < 1e-15
        x = new
        if done:
            break
    return x if np.linalg.norm(x @ x - eye) <= 1e-10 * n else None


def split(a: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None for a
    multiple of the identity (relative to scale)."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * EPS * scale * np.sqrt(n):
        return None
    step = spread / np.sqrt(n)
    shifts = [float(np.median(np.diag(a))), mean] + [mean + k * step for k in (0.1, -0.1, 0.23, -0.23, 0.37, -0.37, 0.51, -0.51)]
    best = None
    for s in shifts:
        u = polar(a - s * np.eye(n))
        if u is None:
            continue
        p = (u + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        q = np.linalg.qr(p @ rng.standard_normal((n, n)))[0]
        for _ in range(2):  # subspace iterations on the projector and on its complement
            up = np.linalg.qr(p @ q[:, :k])[0]
            rest = q[:, k:] - p @ q[:, k:]
            rest = np.linalg.qr(rest - up @ (up.T @ rest))[0]
            q = np.linalg.qr(np.hstack([up, rest]))[0]
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = (left, q[:, :k], q[:, k:])
        if left <= 64 * EPS * n * np.linalg.norm(a, 2):
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    return best[1], best[2]


def spectral(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    n = len(v)
    scale, rng = float(np.linalg.norm(v)), np.random.default_rng(n)
    todo, found = [np.eye(n)], []
    while todo:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        parts = split(a, scale, rng) if len(a) > 1 else None
        if parts is None:
            found.append(basis)
        else:
            todo += [np.linalg.qr(basis @ part)[0] for part in parts]
    vectors = np.hstack(found)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    return values[order], vectors * sign


def matrix(column: pa.Array, dtype=np.int64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, rows as a matrix) for each length of list in an Arrow column."""
    o = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy()
    size = np.diff(o)
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out.append((int(d), at, flat[o[:-1][at][:, None] + np.arange(d)].astype(dtype, copy=False)))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision: the whole part of the mean is subtracted exactly."""
    whole, part = np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def product_sums(rows: DataFrame, values) -> dict[int, np.ndarray]:
    """length -> symmetric matrix of sums of products of values(length, x) over the rows."""

    def partial(batches):
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in matrix(b.column(0)):
                w = values(d, x)
                got[d] = got.get(d, 0) + w.T @ w
        for d, g in got.items():
            i, j = np.triu_indices(len(g))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                              pa.array(g[i, j])], ["d", "i", "j", "v"])

    sums = rows.select("x").mapInArrow(partial, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    d, i, j, v = (sums.column(k).to_numpy() for k in range(4))
    out = {}
    for k in np.unique(d):
        at = d == k
        m = np.zeros((i[at].max() + 1,) * 2)
        m[i[at], j[at]] = m[j[at], i[at]] = v[at]
        out[int(k)] = m
    return out


class Fit:
    """Fitted spaces by length: n, sums S (exact), eigenvalues, eigenvectors, trace, identity_error."""

    def __init__(self, distinct: DataFrame, components: int):
        # 32-bit halves of the difference to the offset add up exactly in longs
        parts = distinct.select(F.size("x").alias("d"), F.posexplode(F.transform("x", lambda c: c - OFFSET)).alias("i", "y"))
        sums = (parts.groupBy("d", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.shiftright("y", 32)).alias("hi"),
                                            F.sum(F.col("y").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")))
        lengths = distinct.select(F.size("x").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect()
        if len(lengths) > MAX_LENGTHS or any(r["d"] > MAX_LENGTH for r in lengths):
            raise ValueError(f"more than {MAX_LENGTHS} lengths of vectors, or a vector of more than {MAX_LENGTH} entries")
        self.n: dict[int, int] = {}
        self.sums: dict[int, list[int]] = {}
        for r in sorted(sums.collect(), key=lambda r: (r["d"], r["i"])):
            self.n[r["d"]] = r["n"]
            self.sums.setdefault(r["d"], []).append((r["hi"] << 32) + r["lo"] + r["n"] * OFFSET)
        n, s = self.n, self.sums
        self.values, self.vectors, self.trace, self.identity_error = {}, {}, {}, {}
        for d, m in product_sums(distinct, lambda d, x: centred(x, n[d], s[d])).items():
            e, v = spectral(m / n[d])
            use = (e > max(e[0], 0) * d * 2.0 ** -50)[:components]
            self.values[d], self.vectors[d] = e[:components][use], v[:, :components][:, use]
            self.trace[d] = float(np.trace(m) / n[d])
        self.check(distinct)

    def whiten(self, d: int, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n[d], self.sums[d]) @ self.vectors[d] / np.sqrt(self.values[d])

    def check(self, distinct: DataFrame) -> None:
        """identity_error: the whitened list's covariance, centred by its own mean."""
        whiten, n = self.whiten, self.n
        ones = lambda d, x: np.hstack([np.ones((len(x), 1)), whiten(d, x)])
        mean = {d: m[0, 1:] / n[d] for d, m in product_sums(distinct, ones).items()}
        for d, m in product_sums(distinct, lambda d, x: np.hstack([np.ones((len(x), 1)), whiten(d, x) - mean[d]])).items():
            cov = m[1:, 1:] / n[d]
            self.identity_error[d] = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else 0.0

    def deviations(self, d: int, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact at any size."""
        n, s = self.n[d], self.sums[d]
        whole = np.array([v // n for v in s], np.int64)
        y = x - whole  # n x - S = n y - (S mod n)
        most = n * (int(np.abs(y).max(initial=0)) + 1)
        rest = [v % n for v in s]
        if most * most * d < 1 << 63:
            z = n * y - np.array(rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        return [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest)) for row in y]


def grid_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 62) / GRID))
    return rows.filter(F.coalesce((F.size("v") > 0) & good, F.lit(False))).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * GRID).cast("long") + OFFSET).alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38, 0), whitened, explained, identity_error) for each usable row and component."""
    rows = grid_vectors(vectors, id_col, vector_col)
    kind = rows.schema["vec_id"].dataType
    fit = Fit(staged(rows.select("x").distinct(), "fit"), components)
    n, values, trace, error = fit.n, fit.values, fit.trace, fit.identity_error

    def project(batches):
        for b in batches:
            for d, at, x in matrix(b.column(1)):
                k = len(values[d])
                if not k:
                    continue
                for lo in range(0, len(at), 2048):
                    part = slice(lo, lo + 2048)
                    w, m = fit.whiten(d, x[part]), len(at[part])
                    ids = b.column(0).take(pa.array(np.repeat(at[part], k)))
                    dev = pa.array([str(v) for v in fit.deviations(d, x[part])], pa.string()).take(pa.array(np.repeat(np.arange(m), k)))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n[d], np.int64)), dev,
                         pa.array(w.reshape(-1)), pa.array(np.tile(values[d] / trace[d], m)), pa.array(np.full(m * k, error[d]))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = rows.mapInArrow(project, f"vec_id {kind.simpleString()}, component int, n bigint, deviation string, whitened double, "
                                   "explained double, identity_error double")
    return out.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38, 0))"))
