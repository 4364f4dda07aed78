"""Whitening of embeddings by shifted CholeskyQR over distributed rows.

The rows X, centred on their exact mean, are never gathered; each pass sums d x d products where they lie.

1. The first pass gives X'X. A shift that covers its rounding error makes its Cholesky factor R1 exist even
   if X is singular or nearly so.
2. Every further pass solves Q R = X triangularly through all factors so far, sums Q'Q, and adds its
   factor, until the columns of Q are orthonormal, apart from directions in which X has no extent.
3. The square root of the last Q'Q takes the place of one more factor, so that the composed
   R = sqrt(Q'Q) ... R2 R1 has R'R = X'X also where such directions exist and Q keeps no unit column.
4. The singular values and right vectors of R are those of X: components, their variances, and the scale
   that whitens. One more pass sums the products of the whitened rows, which are compared with the identity.

X'X by itself would square the spread of the singular values and lose the small ones; solving the rows
through R again wins them back. What reaches the driver is d x d numbers a pass, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize
from .vectors import floors, matrices

SCALE, PLUS = 1024.0, 100_000  # an entry c becomes floor(SCALE * c) + PLUS
ROWS = 4_096  # worked on at once
UNIT = 2.0**-53
MOST_PASSES = 6
_LOW = (1 << 32) - 1


@dataclass
class Mean:
    """Exact mean of `n` rows of integers: `whole` + `rest` / n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over the entries of (n * x - sum)^2, exactly."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max()) if off.size else 0) + self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            y = off * self.n - self.rest
            return pa.array((y * y).sum(1)).cast(pa.decimal128(38, 0), safe=False)
        y = off.astype(object) * self.n - self.rest.astype(object)
        return pa.array([None if (v := int(r.dot(r))) >= 10**38 else v for r in y], pa.decimal128(38, 0))


def _pieces(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for rows, x in matrices(b.column(at)):
            if x.shape[1] == dim:
                for lo in range(0, len(rows), ROWS):
                    yield b, rows[lo : lo + ROWS], floors(x[lo : lo + ROWS], SCALE, PLUS)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums by dimension for every length of vector in the task; sums in two halves of 32 bits."""
    held: dict[int, list] = {}
    for b in batches:
        for rows, x in matrices(b.column(0)):
            x = floors(x, SCALE, PLUS)
            s = held.setdefault(x.shape[1], [0, 0, 0])
            s[0] += len(rows)
            s[1] = s[1] + (x >> 32).sum(0)
            s[2] = s[2] + (x & _LOW).sum(0)
    for d, (n, high, low) in held.items():
        if d:
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": [n] * d, "high": pa.array(high), "low": pa.array(low)})


def mean_of(df: DataFrame, vector: str) -> tuple[int, Mean] | None:
    """Dimension and mean of the usable vectors; where lengths differ, of those of the commonest one."""
    sums = materialize(map_batches(df.select(vector), _sums, "d int, i int, n bigint, high bigint, low bigint"))
    most = sums.where("i = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    per = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums.where(F.col("d") == most["d"]).groupBy("i").agg(*whole).collect()}
    total = [per[i] for i in range(most["d"])]
    return most["d"], Mean(most["n"], np.array([t // most["n"] for t in total], np.int64), np.array([t % most["n"] for t in total], np.int64))


def solved(x: np.ndarray, r: np.ndarray, block: int = 32) -> np.ndarray:
    """Q of Q R = X for an upper triangular R, from the first column to the last."""
    q = np.empty_like(x)
    for b in range(0, r.shape[1], block):
        e = min(b + block, r.shape[1])
        q[:, b:e] = x[:, b:e] - q[:, :b] @ r[:b, b:e]
        for j in range(b, e):
            q[:, j] = (q[:, j] - q[:, b:j] @ r[b:j, j]) / r[j, j]
    return q


def _products(batches: Iterator[pa.RecordBatch], dim: int, mean: Mean, factors: list[np.ndarray], onto: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    total = None
    for _, _, x in _pieces(batches, 0, dim):
        q = mean.centred(x)
        for r in factors:
            q = solved(q, r)
        q = q if onto is None else q @ onto
        total = q.T @ q if total is None else total + q.T @ q
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "g": [row[: i + 1].tolist() for i, row in enumerate(total)]})


def gram(df: DataFrame, vector: str, dim: int, mean: Mean, factors: list[np.ndarray], onto: np.ndarray | None = None) -> np.ndarray:
    """Q'Q of the centred rows solved through `factors` (and projected `onto` columns)."""
    part = map_batches(df.select(vector), partial(_products, dim=dim, mean=mean, factors=factors, onto=onto), "i int, g array<double>")
    cells = part.select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    size = dim if onto is None else onto.shape[1]
    out = np.zeros((size, size))
    for r in cells:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


@dataclass
class Components:
    """Unit vectors as columns, by falling variance; `trace` of the covariance; triangular `factors`."""

    dim: int
    mean: Mean
    vectors: np.ndarray
    variances: np.ndarray
    trace: float
    factors: list[np.ndarray]

    def onto(self, k: int) -> np.ndarray:
        return self.vectors[:, :k] / np.sqrt(self.variances[:k])


def fit(df: DataFrame, vector: str) -> Components | None:
    """Components of the usable vectors with any extent; None without rows or extent."""
    found = mean_of(df, vector)
    if found is None:
        return None
    dim, mean = found
    factors: list[np.ndarray] = []
    composed = np.eye(dim)
    error = 11 * (mean.n * dim + dim * (dim + 1)) * UNIT  # of the products, relative to their norm
    while True:
        g = gram(df, vector, dim, mean, factors)
        size, turn = np.linalg.eigh(g)
        if size[-1] <= 0:
            return None
        kept = size[size > 0.5]
        if factors and (len(factors) == MOST_PASSES or (len(kept) == np.sum(size > error) and np.abs(kept - 1).max() < 1e-12 * dim + error)):
            break
        shift = 0.0 if factors and size[0] > 0.5 else error * size[-1]
        r = np.linalg.cholesky(g + shift * np.eye(dim)).T
        factors.append(r)
        composed = r @ composed
    composed = (turn * np.sqrt(np.maximum(size, 0))) @ turn.T @ composed
    _, s, v = np.linalg.svd(composed)
    real = s > s[0] * 16 * dim * UNIT
    return Components(dim, mean, v.T[:, real], s[real] ** 2 / mean.n, float((s**2).sum() / mean.n), factors)


def _whitened(batches: Iterator[pa.RecordBatch], c: Components, k: int, error: float) -> Iterator[pa.RecordBatch]:
    onto = c.onto(k)
    k = onto.shape[1]
    for b, rows, x in _pieces(batches, 1, c.dim):
        m = len(rows)
        each = np.repeat(np.arange(m), k)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0).take(pa.array(rows[each])),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, c.mean.n)),
                c.mean.deviation(x).take(pa.array(each)),
                pa.array((c.mean.centred(x) @ onto).ravel()),
                pa.array(np.tile(c.variances[:k] / c.trace, m)),
                pa.array(np.full(m * k, error)),
            ],
            names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whitened(df: DataFrame, id: str, vector: str, k: int = 8) -> DataFrame:
    """For each usable row and each of the first `k` components: `id`, component (from 1), n, deviation
    (sum of (n*x - sum)^2, decimal(38,0), exact), whitened, explained (share of all variance),
    identity_error (largest entry of the whitened covariance minus the identity).

    Vectors that are null or hold null or non-finite entries take no part; where lengths differ, those of
    the commonest length (of two, the longer) are used, and vectors without entries never are. Entries
    beyond the range of long end at its ends; a deviation of more than 38 digits is null. Components
    without extent are left out, so equal rows, a single row or an empty table give no rows. Repeated rows
    and ids count as often as they are there; a null id is passed on. Other columns are not looked at.
    """
    schema = f"id {df.schema[id].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    c = fit(df, vector)
    if c is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    onto = c.onto(k)
    error = float(np.abs(gram(df, vector, c.dim, c.mean, [], onto) / c.mean.n - np.eye(onto.shape[1])).max())
    return map_batches(df.select(id, vector), partial(_whitened, c=c, k=k, error=error), schema).withColumnRenamed("id", id)
