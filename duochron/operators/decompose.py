"""Principal components and latent semantic axes of sparse long-form matrices.

Randomised subspace iteration (Halko, Martinsson, Tropp 2011) on rows (entity, feature,
value). The kept features are a bounded list (thousands), so the feature-side matrix is small;
entities only ever appear as distributed rows, and a matrix with implicit zeros is centred by a
rank-one correction instead of being filled in. Entities without any kept feature never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shipped

MAX_FEATURES = 100_000
OVERSAMPLE = 10
POWER_STEPS = 7  # fixed value: power iterations


def feature_index(features: DataFrame) -> tuple[DataFrame, int]:
    """Kept features with a dense index in name order. Refuses an unbounded feature list."""
    names = [r[0] for r in features.select("feature").distinct().orderBy("feature").limit(MAX_FEATURES + 1).collect()]
    if len(names) > MAX_FEATURES:
        raise ValueError("choose features first: the factor matrix must stay small")
    table = features.sparkSession.createDataFrame(pd.DataFrame({"feature": names, "f": np.arange(len(names), dtype="int32")}), f"feature {features.schema['feature'].dataType.simpleString()}, f int")
    return table, len(names)


def sparse_rows(values: DataFrame, index: DataFrame, entities: DataFrame, value: str = "value") -> DataFrame:
    """One row per entity: feature positions and values, at most one entry per kept feature."""
    packed = values.join(F.broadcast(index), "feature").groupBy("entity").agg(F.collect_list(F.struct("f", F.col(value).alias("x"))).alias("c"))
    full = entities.select("entity").join(packed, "entity", "left")
    return full.select("entity", F.transform("c", lambda s: s["f"]).alias("f"), F.transform("c", lambda s: s["x"]).alias("x"))


def _blocks(pdf: pd.DataFrame):
    has = [i for i, f in enumerate(pdf["f"]) if f is not None and len(f)]
    rows = np.repeat(has, [len(pdf["f"].iat[i]) for i in has]).astype(int) if has else np.zeros(0, int)
    f = np.concatenate([pdf["f"].iat[i] for i in has]).astype(int) if has else np.zeros(0, int)
    x = np.concatenate([pdf["x"].iat[i] for i in has]).astype(float) if has else np.zeros(0)
    return rows, f, x


def _sums(at: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Rows of `y` added up by their place `at` in 0..n-1."""
    out = np.zeros((n, y.shape[1]))
    if len(at):
        if (at[1:] < at[:-1]).any():
            order = np.argsort(at, kind="stable")
            at, y = at[order], y[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.add.reduceat(y, first, axis=0)
    return out


def _times(pdf: pd.DataFrame, q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    rows, f, x = _blocks(pdf)
    return _sums(rows, x[:, None] * q[f], len(pdf)) - mean @ q


def _gram_times(rows: DataFrame, q: np.ndarray, mean: np.ndarray, empty: int = 0) -> np.ndarray:
    """A'A q for the (centred) matrix A: partial sums per task, summed per feature by Spark. `empty` rows of
    zeros beside `rows` are added here: centred, all of them are the same."""
    shared = rows.sparkSession.sparkContext.broadcast((q, mean))
    d, b = q.shape

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qq, mu = shared.value
        acc, total = np.zeros((d, b)), np.zeros(b)
        for pdf in batches:
            y = _times(pdf, qq, mu)
            r, f, x = _blocks(pdf)
            acc += _sums(f, x[:, None] * y[r], d)
            total += y.sum(0)
        acc -= np.outer(mu, total)
        yield pd.DataFrame({"f": np.arange(d, dtype="int32"), "z": list(acc)})

    summed = shipped(rows).mapInPandas(part, "f int, z array<double>").groupBy("f").agg(F.array(*[F.sum(F.col("z")[i]) for i in range(b)]).alias("z")).toPandas()
    found = np.stack(summed.sort_values("f")["z"].to_numpy()) if len(summed) else np.zeros((d, b))
    return found + empty * np.outer(mean, mean @ q)


def factor(values: DataFrame, features: DataFrame, entities: DataFrame, k: int, center: bool, value: str = "value", seed: int = 785, steps: int = POWER_STEPS) -> tuple[DataFrame, pd.DataFrame, pd.DataFrame]:
    """Scores (entity, scores array), loadings per feature and explained variance per axis.

    Axes are signed so that the largest loading is positive.
    """
    index, d = feature_index(features)
    rows = materialize(sparse_rows(values, index, entities, value))
    held, bare = rows.where(F.size("f") > 0), rows.where(~F.coalesce(F.size("f") > 0, F.lit(False)))
    n, empty = rows.count(), bare.count()
    k = min(k, d, n)
    stats = rows.select(F.posexplode(F.arrays_zip("f", "x")).alias("_p", "e")).groupBy(F.col("e.f").alias("f")).agg(F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("q")).toPandas()
    mean, square = np.zeros(d), np.zeros(d)
    mean[stats["f"]] = stats["s"] / n
    square[stats["f"]] = stats["q"] / n
    total_var = float((square - mean**2).sum())
    mu = mean if center else np.zeros(d)
    b = min(d, k + OVERSAMPLE)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, b)))
    for _ in range(steps):
        q, _ = np.linalg.qr(_gram_times(held, q, mu, empty))
    small = q.T @ _gram_times(held, q, mu, empty)
    lam, w = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-lam)[:k]
    load = q @ w[:, top]
    load *= np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    shared = rows.sparkSession.sparkContext.broadcast((load, mu))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"entity": pdf["entity"], "scores": list(_times(pdf, *shared.value))})

    scores = shipped(held).mapInPandas(project, f"entity {rows.schema['entity'].dataType.simpleString()}, scores array<double>")
    scores = scores.unionByName(bare.select("entity", F.array(*[F.lit(float(v)) for v in -(mu @ load)]).alias("scores")))
    score_mean = np.zeros(k) if center else mean @ load
    variance = lam[top] / n - score_mean**2
    axes = pd.DataFrame({"axis": np.arange(1, k + 1), "singular_value": np.sqrt(np.maximum(lam[top], 0)), "explained_variance_ratio": variance / total_var if total_var > 0 else np.nan})
    names = index.toPandas().sort_values("f")["feature"].to_numpy()
    loadings = pd.DataFrame({"feature": np.repeat(names, k), "axis": np.tile(np.arange(1, k + 1), d), "loading": load.ravel()})
    return scores, loadings, axes
