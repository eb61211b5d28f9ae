"""Whitening of vectors by QDWH spectral divide and conquer.

The fit list, each distinct integer vector once, is a written table; its sums and its centred products are added up in tasks
and by one aggregation over (row, column), so the driver gets d x d numbers whatever the number of rows. There the covariance
is split without an eigensolver: the polar factor U of the covariance less a shift, by the QR form of the dynamically weighted
Halley iteration, has eigenvalues -1 and 1 on the two sides of the shift, so (U + I) / 2 projects on the invariant subspace
of the upper eigenvalues. Subspaces are split again until they are components, or one eigenvalue to rounding. The mean and the
leading components, d x 5 numbers at most, are broadcast, and each task whitens its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray, lower: float) -> np.ndarray:
    """The orthogonal polar factor of symmetric ``a``, of norm at most 1, whose singular values are at least ``lower``."""
    x, low, eye = a, max(lower, EPS), np.eye(len(a))
    for _ in range(40):
        d = np.cbrt(4.0 * (1.0 - low * low) / low**4)
        wa = np.sqrt(1.0 + d) + 0.5 * np.sqrt(max(0.0, 8.0 - 4.0 * d + 8.0 * (2.0 - low * low) / (low * low * np.sqrt(1.0 + d))))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        q1, q2 = q[: len(a)], q[len(a) :]
        y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q1 @ q2.T)
        y = (y + y.T) / 2.0
        low = min(1.0, low * (wa + wb * low * low) / (1.0 + wc * low * low))
        moved, x = np.linalg.norm(y - x), y
        if moved <= 10 * EPS * np.sqrt(len(a)) or (abs(1.0 - low) < 10 * EPS and moved < np.cbrt(EPS)):
            break
    return x


def _bases(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; None if an eigenvalue is too near to it."""
    n = len(a)
    b = a - shift * np.eye(n)
    u = polar(b / np.linalg.norm(b), EPS)
    p = (u + np.eye(n)) / 2.0
    k = int(round(np.trace(p)))
    if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-10 * n:
        return None
    # the projector's columns span the subspace: two rounds of orthogonal iteration from a fixed start
    q = np.random.default_rng(1).normal(size=(n, n))
    for _ in range(2):
        q, _ = np.linalg.qr(np.hstack([p @ q[:, :k], q[:, k:]]))
    if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) > 1e-12 * n * np.linalg.norm(a):
        return None
    return q[:, :k], q[:, k:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of symmetric ``v``, by falling eigenvalue.

    In a subspace whose block is a multiple of the identity up to rounding any basis serves, so ties give some orthonormal basis.
    """
    scale = np.linalg.norm(v)
    found: list[tuple[float, np.ndarray]] = []
    open_ = [np.eye(len(v))]
    while open_:
        q = open_.pop()
        a = q.T @ v @ q
        a = (a + a.T) / 2.0
        middle = np.trace(a) / len(a)
        if len(a) == 1 or np.linalg.norm(a - middle * np.eye(len(a))) <= 4 * EPS * scale * len(a):
            found += [(float(a[i, i]), q[:, i]) for i in range(len(a))]
            continue
        values = np.sort(np.diag(a))
        radius = np.linalg.norm(a - middle * np.eye(len(a)))
        # the mean of the eigenvalues lies between them; others are tried where an eigenvalue is too near to be told apart
        for shift in (middle, float(np.median(values)), *(middle + radius * s for s in (0.013, -0.017, 0.071, -0.083, 0.23, -0.29, 0.41, -0.47))):
            if sides := _bases(a, shift):
                open_ += [q @ side for side in sides]
                break
        else:  # eigenvalues apart by rounding only
            found += [(float(a[i, i]), q[:, i]) for i in range(len(a))]
    found.sort(key=lambda x: -x[0])
    return np.array([e for e, _ in found]), np.array([c for _, c in found]).T.reshape(len(v), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches, size: int = 8192):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            if (part := batch.slice(at, size)).num_rows:
                yield part


def _products(centre: np.ndarray, axes: np.ndarray | None = None):
    """For each task: (i, j, s), the sums of products of centred entries, or of their projections on ``axes``."""

    def run(batches):
        total = 0.0
        for batch in _blocks(batches):
            y = _matrix(batch.column(0)).astype(np.float64) - centre
            y = y if axes is None else y @ axes
            total = total + y.T @ y
        if isinstance(total, np.ndarray):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def _covariance(fit: DataFrame, n: int, centre: np.ndarray, axes: np.ndarray | None = None) -> np.ndarray:
    d = len(centre) if axes is None else axes.shape[1]
    parts = fit.select("x").mapInArrow(_products(centre, axes), "i long, j long, s double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"] / n
    return (out + out.T) / 2.0


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): the rows whose vector has only finite entries, as floor(256 * entry); a value that no long holds is an error."""
    x = F.transform("embedding", lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return vectors.where(good & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def fit(rows: DataFrame, d: int, components: int = 4) -> dict:
    """The whitening of rows (x) of length ``d``: n, S, mean, leading axes, eigenvalues, shares of the trace, identity error.

    Entries are centred before they are multiplied. A component without variance can't be whitened and has eigenvalue 0 here.
    """
    distinct = written(rows.select("x").distinct(), "fit-list")
    sums = distinct.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, total = sums["n"], [int(sums[f"s{i}"]) for i in range(d)]
    centre = np.array([s / n for s in total])
    cov = _covariance(distinct, n, centre)
    e, axes = spectrum(cov)
    trace, k = float(np.trace(cov)), min(components, d)
    e, axes = e[:k], axes[:, :k]
    flat = e <= 16 * EPS * max(trace, 0.0)
    e = np.where(flat, 0.0, e)
    scaled = axes / np.sqrt(np.where(flat, 1.0, e))
    white = _covariance(distinct, n, centre, scaled)[~flat][:, ~flat]
    error = float(np.abs(white - np.eye(len(white))).max()) if len(white) else 0.0
    return {"n": n, "sums": total, "centre": centre, "scaled": scaled, "eigenvalues": e, "explained": e / trace if trace > 0 else np.zeros(k), "error": error}


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(shared):
    def run(batches):
        m = shared.value
        k = len(m["eigenvalues"])
        for batch in _blocks(batches):
            x = _matrix(batch.column(1))
            rows = len(x)
            # exact in longs if the bound holds, else in Python's integers, where a result that no long holds is an error
            most = m["n"] * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, m["sums"]))
            kind = np.int64 if most * most * len(m["sums"]) < 1 << 63 else object
            off = x.astype(kind) * m["n"] - np.array(m["sums"], dtype=kind)
            deviation = (off * off).sum(axis=1)
            z = (x.astype(np.float64) - m["centre"]) @ m["scaled"]
            flat = np.tile(m["eigenvalues"] == 0, rows)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, m["n"], dtype=np.int64)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                pa.array(z.ravel(), mask=flat), pa.array(np.tile(m["explained"], rows)), pa.array(np.full(rows * k, m["error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 4, lengths: int = 16) -> DataFrame:
    """One row per vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries have no row, nor have empty ones; a null vec_id stays. Vectors of
    each length are fitted by themselves, with an error beyond ``lengths`` different ones. Repeated rows give repeated results
    but count once in the fit. ``whitened`` is null where a component has no variance, as for a single distinct vector; ties
    between eigenvalues give some orthonormal basis of their space. Other columns are ignored; an empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = integers(vectors)
    sizes = sorted(r["d"] for r in rows.groupBy(F.size("x").alias("d")).count().limit(lengths + 1).collect())
    if len(sizes) > lengths:
        raise ValueError(f"vectors of more than {lengths} lengths")
    out = spark.createDataFrame([], OUT)
    for d in sizes:
        own = rows.where(F.size("x") == d)
        model = spark.sparkContext.broadcast(fit(own, d, components))
        out = out.unionByName(own.mapInArrow(_whiten(model), OUT))
    return out
