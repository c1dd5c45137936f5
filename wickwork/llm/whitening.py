"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed, centred products.

The covariance is never formed. Every product of it with a block of vectors is one pass over the stored vectors, in which a task multiplies its
centred rows with the block and back and returns the small product; Spark adds these up. A few Lanczos steps bound the spectrum; then polynomial
filters damp all of it below the block's smallest Ritz value, and QR and Rayleigh-Ritz follow until every wanted pair's residual certifies it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickwork.llm.common import stored

#: Columns of the block beyond the wanted components; they make the gap behind the last wanted one wide.
GUARD = 16
#: Degree of a filter, Lanczos steps before the first, filters at most.
DEGREE, LANCZOS, CYCLES = 10, 8, 80
#: Residual, against the largest eigenvalue, that certifies a component.
CERTIFIED = 2e-13
#: Components below this share of the largest eigenvalue have no variance but rounding and cannot be whitened.
NO_VARIANCE = 1e-10
#: Entries of this size and more (after scaling) are treated as not finite.
LARGEST = float(1 << 52)


def scaled_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x array of longs): floor(scale * c) + shift of every vector without null or non-finite entries and of the commonest length (ties: the longest)."""
    c = F.col(vector_col)
    inside = vectors.select(F.col(id_col).alias("vec_id"), c.alias("_c")).where(F.col("_c").isNotNull() & (F.size("_c") > 0))
    inside = inside.where(F.forall("_c", lambda e: e.isNotNull() & (F.abs(e.cast("double")) * scale < LARGEST)))
    return inside.select("vec_id", F.transform("_c", lambda e: F.floor(e.cast("double") * scale).cast("long") + shift).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(rows: DataFrame, shape: tuple[int, ...], product) -> np.ndarray:
    """Sum over all rows of product(matrix of longs), an array of doubles of this shape; one pass, added up by Spark cell by cell."""
    size = int(np.prod(shape))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                total, any_rows = total + product(_matrix(b.column(0))), True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.reshape(-1))], ["cell", "v"])

    cells = rows.select("x").mapInArrow(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for cell, v in cells:
        out[cell] = v
    return out.reshape(shape)


def _exact_sums(rows: DataFrame) -> list[tuple[int, int]]:
    """(count, exact sum) of every dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                high, low = x >> 26, x & ((1 << 26) - 1)  # neither sum can overflow
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x))), pa.array(high.sum(0)), pa.array(low.sum(0))], ["dim", "n", "high", "low"])

    sums = rows.select("x").mapInArrow(part, "dim long, n long, high long, low long").groupBy("dim")
    found = sums.agg(F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low")).orderBy("dim").collect()
    return [(r["n"], int(r["high"]) * (1 << 26) + int(r["low"])) for r in found]


def _spread(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: longs where they hold it, else Python integers."""
    if int(np.abs(x).max(initial=0)) * n < 1 << 61 and max(map(abs, sums.tolist()), default=0) < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _deviations(y: np.ndarray) -> list[int]:
    """Exact sums of squares by row."""
    if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 62:
        return (y * y).sum(1).tolist()
    y = y.astype(object)
    return (y * y).sum(1).tolist()


def _centred(n: int, sums: np.ndarray):
    """Function from longs to x - S / n, each entry rounded once."""
    return lambda x: (_spread(x, n, sums) / n).astype(float)


def _eigen(rows: DataFrame, n: int, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the covariance, falling, with their vectors as columns."""
    d, centred = len(sums), _centred(n, sums)

    def times(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(rows, q.shape, product) / n

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        aq = times(q)
        h = q.T @ aq
        e, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-e, kind="stable")
        return e[order], q @ u[:, order], aq @ u[:, order]

    rng, block = np.random.default_rng(7), min(d, k + GUARD)
    q = np.eye(d) if block == d else np.linalg.qr(rng.standard_normal((d, block)))[0]
    lowest = _lowest(times, rng.standard_normal((d, 1))) if block < d else 0.0
    best, still = np.inf, 0
    for _ in range(CYCLES):
        e, q, aq = ritz(q)
        if e[0] <= 0:
            return np.zeros(0), np.zeros((d, 0))
        wanted = min(k, int((e > NO_VARIANCE * e[0]).sum()))
        residual = np.linalg.norm(aq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max() / e[0]
        still = still + 1 if residual > best / 2 else 0
        best = min(best, residual)
        if block == d or residual <= CERTIFIED or (still >= 3 and best <= 50 * CERTIFIED):
            sign = np.sign(q[np.abs(q).argmax(0), np.arange(block)])
            return e[:wanted], (q * sign)[:, :wanted]
        cut = e[-1] if e[-1] > NO_VARIANCE * e[0] else e[e > NO_VARIANCE * e[0]].min() / 2
        low = min(lowest, cut / 2) if lowest >= cut else lowest
        middle, half = (cut + low) / 2, (cut - low) / 2
        # p0 = q, p1 = (A - c) q / h, then the three-term recurrence; scaled by the growth at the largest Ritz value
        growth = half / (e[0] - middle)
        before, now, scale = q, (aq - middle * q) / half * growth, growth
        for _ in range(DEGREE - 1):
            next_scale = 1 / (2 / growth - scale)
            before, now, scale = now, 2 * next_scale / half * (times(now) - middle * now) - scale * next_scale * before, next_scale
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"eigenvectors not certified after {CYCLES} filters: residual {best}")


def _lowest(times, v: np.ndarray) -> float:
    """A lower bound of the spectrum from Lanczos steps: the smallest Ritz value less its residual, at least 0."""
    basis, diagonal, beside = [v / np.linalg.norm(v)], [], []
    for _ in range(min(LANCZOS, len(v))):
        w = times(basis[-1])
        diagonal.append(float((basis[-1].T @ w).item()))
        for _ in range(2):
            for b in basis:
                w = w - b * (b.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            return 0.0  # an invariant subspace was met: nothing is known of the rest
        basis.append(w / beside[-1])
    e, u = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
    return max(0.0, e[0] - 2 * beside[-1] * abs(u[-1, 0]))


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error): one row for each vector and component.

    Entries become x = floor(1024 * c) + 100000. n counts the fitted vectors, deviation is the exact sum of (n * x - S)^2, whitened the projection of x - S / n on
    the component over the root of its eigenvalue, explained the eigenvalue's share of the trace, identity_error the largest entry of |covariance of whitened - identity|.

    Vectors that are null or empty, that hold null or non-finite entries or entries of 2^52 / 1024 and more, or whose length is not the commonest one, have no rows and are not
    fitted. Components without variance (rank below components, one vector, equal vectors) have no rows. Repeated rows and ids, null ids too, are vectors of their own.
    An empty table gives an empty result; other columns are left out, whatever their names. The driver holds dimensions times (components + GUARD) doubles, no vector.
    """
    rows = stored(scaled_rows(vectors, id_col, vector_col), "whiten")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if len(lengths) > 1:
        rows = rows.where(F.size("x") == lengths[0]["d"])
    return _whitened(rows, _exact_sums(rows) if lengths else [], components)


def _whitened(rows: DataFrame, totals: list[tuple[int, int]], components: int) -> DataFrame:
    schema = T.StructType.fromDDL("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([rows.schema["vec_id"], *schema.fields])
    if not totals:
        return rows.sparkSession.createDataFrame([], schema)
    n, d = totals[0][0], len(totals)
    sums = np.array([s for _, s in totals], dtype=object)
    e, q = _eigen(rows, n, sums, components)
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    centred, onto = _centred(n, sums), q / np.sqrt(e)
    k = len(e)

    def moments(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        w = c @ onto
        return np.concatenate([(w.T @ w).reshape(-1), w.sum(0), [(c * c).sum()]])

    found = _summed(rows, (k * k + k + 1,), moments)
    mean, trace = found[k * k : k * k + k] / n, found[-1] / n
    error = float(np.abs(found[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    shares = e / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for b in batches:
            if not b.num_rows:
                continue
            y = _spread(_matrix(b.column(1)), n, sums)
            exact = pa.array([Decimal(v) for v in _deviations(y)], pa.decimal128(38, 0))
            w = (y / n).astype(float) @ onto
            at = np.repeat(np.arange(len(w)), k)
            cells = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), pa.array(np.full(len(at), n)), exact.take(pa.array(at)), pa.array(w.reshape(-1)), pa.array(np.tile(shares, len(w))), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *cells], schema.names)

    return rows.select("vec_id", "x").mapInArrow(project, schema)
