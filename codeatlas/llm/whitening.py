"""Whitening of embeddings by matrix-free block subspace iteration.

Vectors become integers x = floor(scale * c). The covariance V of the distinct x vectors is never formed: each Spark pass
sends a block Q of orthonormal directions to the tasks and sums X'(XQ) over the centred rows. Blocks and their images are
kept, so that a Rayleigh-Ritz step over all directions tried so far (orthonormalised by QR, twice) gives eigenvalues,
vectors and their true residuals without another pass; the images, made orthogonal to what was tried, are the next block.
It ends when the residuals of all k components certify them, or when they fall no more. Beyond `most_columns` directions
the basis shrinks to its best Ritz vectors, whose residuals the next block holds.

Rows with a null vector, or null or non-finite entries, take no part; nor do rows whose length is not the most frequent
one (of equally frequent ones the shortest), or is 0. Entries whose integer is beyond 64 bits are held at its ends. Copies
count once in the fit and each get their rows; a null vec_id is carried; a component whose eigenvalue is 0 up to
rounding has no rows, so an empty table or one distinct vector gives an empty result; a deviation that doesn't fit into a
long is null. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LONG = 2**63


@dataclass
class Whitening:
    """n distinct vectors with sums S; components as columns, their eigenvalues, the trace; how it was certified."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float


def integers(table: DataFrame, column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """`table` with x array<long>, without the rows that take no part."""
    finite = F.forall(F.col(column), lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(math.inf), F.lit(False)))
    rows = table.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(finite)
    x = rows.withColumn("x", F.transform(column, lambda c: F.floor(c.cast("double") * scale)))
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return x.where(F.size("x") == (sizes["d"] if sizes else 0))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of one length."""
    if not len(column):
        return np.zeros((0, 0), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """How many rows there are, and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, None
        for b in batches:
            x = matrix(b.column("x"), np.int64)
            if len(x):
                small = np.abs(x.astype(float)).max() * len(x) < LONG // 4
                part = x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
                n, total = n + len(x), part if total is None else total + part
        if total is not None:
            # Sums in two parts: each part's sum over all tasks fits into a decimal, whatever the values.
            yield pa.RecordBatch.from_pydict({"i": range(len(total)), "n": [n] * len(total), "high": [int(t) >> 32 for t in total], "low": [int(t) & 0xFFFFFFFF for t in total]}, schema)

    schema = pa.schema([("i", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = fit.select("x").mapInArrow(run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), whole("high"), whole("low")).orderBy("i").collect()
    return (rows[0]["n"] if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n; the mean's whole part is taken off as integers."""
    whole = np.array([s // n for s in sums], np.float64)
    return (x - whole) - np.array([(s % n) / n for s in sums])


def product(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> tuple[np.ndarray, float]:
    """VQ, and V's trace: one pass over the centred rows. Each task sends a matrix of Q's shape, which Spark sums by row."""
    width = q.shape[1]

    def run(batches):
        total, squares = np.zeros(q.shape), 0.0
        for b in batches:
            y = centred(matrix(b.column("x")), n, sums)
            if len(y):
                total += y.T @ (y @ q)
                squares += float(np.einsum("ij,ij->", y, y))
        rows = [list(r) for r in total / n]
        yield pa.RecordBatch.from_pydict({"i": range(len(rows)), "v": rows, "t": [squares / n, *[0.0] * (len(rows) - 1)]}, schema)

    schema = pa.schema([("i", pa.int32()), ("v", pa.list_(pa.float64())), ("t", pa.float64())])
    parts = fit.select("x").mapInArrow(run, "i int, v array<double>, t double")
    rows = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)], F.sum("t").alias("t")).orderBy("i").collect()  # a row for each dimension
    return np.array([[r[f"v{j}"] for j in range(width)] for r in rows]), sum(r["t"] for r in rows)


def fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal directions of `block` that `basis` doesn't hold; what is left of a column by rounding alone doesn't count."""
    room = len(basis) - basis.shape[1]
    for _ in range(2):
        before = np.linalg.norm(block, axis=0)
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        held = norms > 1e-13 * before
        block = (block[:, held] / norms[held])[:, :room]
        if not block.shape[1]:
            return block
        q, r = np.linalg.qr(block)
        block = q[:, np.abs(np.diag(r)) > 1e-10]
    return block


def components(fit: DataFrame, n: int, sums: list[int], k: int, tolerance: float = 1e-14, block: int = 16, most_columns: int = 256, most_passes: int = 500) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, int]:
    """The first k eigenvalues and vectors, the trace, residual norms over the first eigenvalue, and the passes that it took."""
    d = len(sums)
    k = min(k, d)
    width = min(d, max(block, 2 * k))
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((d, width)))[0]
    best, stale, out = math.inf, 0, None
    for passes in range(1, most_passes + 1):
        vq, trace = product(fit, n, sums, q)
        basis, image = np.hstack([basis, q]), np.hstack([image, vq])
        h = basis.T @ image
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        top = min(k, len(values))
        ritz, scale = basis @ y[:, :top], max(values[0], 0.0)
        left = np.linalg.norm(image @ y[:, :top] - ritz * values[:top], axis=0) / (scale or 1.0)
        worst = float(left.max()) if top == k else math.inf
        if worst < 0.5 * best:
            best, stale = worst, 0
        else:
            stale += 1
        if out is None or worst <= best:
            out = values[:top], ritz, trace, left, passes
        next_q = fresh(vq, basis)
        if worst <= tolerance or worst < 1e-11 and stale >= 2 or not next_q.shape[1]:
            break
        if basis.shape[1] + next_q.shape[1] > most_columns:
            keep = min(len(values), most_columns // 2)
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]  # the next block, orthogonal to all, holds their residuals
        q = next_q
    return out


def fit(rows: DataFrame, k: int = 4, **options) -> Whitening | None:
    """Whitening of the distinct x vectors of `rows`; None if there is none. They are written once and read in each pass."""
    spark, at = rows.sparkSession, f"{common.scratch_dir(rows.sparkSession)}-vectors"
    distinct = common.save(rows.select("x").distinct(), at)
    n, sums = moments(distinct)
    if not n:
        common.remove(spark, at)
        return None
    values, vectors, trace, residuals, passes = components(distinct, n, sums, k, **options)
    held = values > 1e-12 * max(trace, 0.0)
    values, vectors, residuals = values[held], vectors[:, held], residuals[held]
    error = identity_error(distinct, n, sums, values, vectors) if len(values) else 0.0
    common.remove(spark, at)
    return Whitening(n, sums, values, vectors, trace, residuals, passes, error)


def identity_error(fit: DataFrame, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, from a pass of its own."""
    scaled = vectors / np.sqrt(values)
    image, _ = product(fit, n, sums, scaled)
    return float(np.abs(scaled.T @ image - np.eye(len(values))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n*x - S)^2 for each row, exact; null beyond a long."""
    if not len(x):
        return []
    most = int(np.abs(x.astype(float)).max()) * n + max(map(abs, sums))
    if most**2 * len(sums) < LONG:
        away = x * n - np.array(sums, np.int64)
        return np.einsum("ij,ij->i", away, away).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < LONG else None for e in exact]


def apply(rows: DataFrame, w: Whitening | None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of `rows` and component of `w`."""
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], shape)
    scaled, k = w.vectors / np.sqrt(w.values), len(w.values)
    explained = w.values / w.trace

    def run(batches):
        for b in batches:
            x = matrix(b.column("x"), np.int64)
            m = len(x)
            if not m:
                continue
            white = centred(x.astype(np.float64), w.n, w.sums) @ scaled
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(pa.array(at)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": np.full(m * k, w.n, np.int64),
                "deviation": pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(at)), "whitened": white.ravel(),
                "explained": np.tile(explained, m), "identity_error": np.full(m * k, w.identity_error),
            }, schema)

    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, shape)


def whiten(table: DataFrame, k: int = 4, column: str = "embedding", scale: float = 256.0, **options) -> DataFrame:
    """Fit on the distinct vectors of `table` (vec_id, `column`) and whiten every row."""
    rows = integers(table.select("vec_id", column), column, scale)
    return apply(rows, fit(rows, k, **options))
