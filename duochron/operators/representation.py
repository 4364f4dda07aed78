"""Vectors per entity: standardising, centring, axis filters, geometry, quality grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import distance, doubles, mean_vector, norm
from ..session import materialize
from .ordered import rank_rows, same_keys
from .stats import quantiles, spearman

# Correlation at which an axis counts as technical, rows a centroid needs.
AXIS_RHO = 0.8
LABELS_PER_TILE = 512
MIN_CENTROID_ROWS = 20


def dims_as_columns(df: DataFrame, vec: str, first: int, count: int, prefix: str = "d") -> DataFrame:
    """Add columns <prefix>1.. from `count` elements starting at 1-based `first`."""
    return df.select("*", *[F.element_at(vec, first + i).cast("double").alias(f"{prefix}{i + 1}") for i in range(count)])


def zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Population z-score of each column; a constant column becomes zeros.

    One aggregation gives a single row of moments, which is broadcast.
    """
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in cols}
    return df.crossJoin(F.broadcast(m)).withColumns(z).select(*df.columns)


def zscore_vector(df: DataFrame, vec: str, dims: int) -> DataFrame:
    """The same on an array column of fixed width."""
    v = doubles(F.col(vec))
    m = df.agg(F.array(*[F.avg(v[i]) for i in range(dims)]).alias("_m"), F.array(*[F.stddev_pop(v[i]) for i in range(dims)]).alias("_s"))
    z = F.array(*[(v[i] - F.col("_m")[i]) / F.when(F.col("_s")[i] > 0, F.col("_s")[i]).otherwise(1.0) for i in range(dims)])
    return df.crossJoin(F.broadcast(m)).withColumn(vec, z).drop("_m", "_s")


def centroids(df: DataFrame, label: Sequence[str], vec: str, dims: int, min_rows: int = 1) -> DataFrame:
    return df.groupBy(*label).agg(F.count(F.lit(1)).alias("n"), mean_vector(doubles(F.col(vec)), dims).alias("centroid")).where(F.col("n") >= min_rows)


def centroid_distances(df: DataFrame, label: Sequence[str], vec: str, dims: int, min_rows: int = MIN_CENTROID_ROWS) -> DataFrame:
    """Distance of every pair of label centroids (labels with enough rows), pairs in name order.

    The pairs are the result. Labels are dealt into tiles of a few hundred, and a pair of labels meets in
    the one pair of tiles that holds it, so the pairs are made by an ordinary join.
    """
    c = centroids(df, label, vec, dims, min_rows).select(F.concat_ws("||", *[F.col(l).cast("string") for l in label]).alias("name"), "centroid")
    c = materialize(c)
    tiles = max(1, -(-c.count() // LABELS_PER_TILE))
    tile, every = F.pmod(F.xxhash64("name"), F.lit(tiles)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tiles - 1).cast("bigint")))
    a = c.select(F.col("name").alias("a"), F.col("centroid").alias("ca"), tile.alias("ta"), every.alias("tb"))
    b = c.select(F.col("name").alias("b"), F.col("centroid").alias("cb"), tile.alias("tb"), every.alias("ta"))
    return a.join(b, ["ta", "tb"]).where(F.col("a") < F.col("b")).select("a", "b", distance(F.col("ca"), F.col("cb")).alias("distance"))


def geometry_rho(raw: DataFrame, rescued: DataFrame, label: Sequence[str], vec: str, dims: int, min_rows: int = MIN_CENTROID_ROWS) -> DataFrame:
    """Spearman of the pairwise centroid distances before and after; NULL under three pairs."""
    x = centroid_distances(raw, label, vec, dims, min_rows).withColumnRenamed("distance", "before")
    y = centroid_distances(rescued, label, vec, dims, min_rows).withColumnRenamed("distance", "after")
    both = x.join(y, ["a", "b"]).select(F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))
    rho = spearman(both, "before", "after", (), "rho")
    return both.agg(F.count(F.lit(1)).alias("n_pairs")).crossJoin(rho).withColumn("rho", F.when(F.col("n_pairs") >= 3, F.col("rho")))


def stage_centering(df: DataFrame, stage: str, sample: str, vec: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """Move each sample's centroid to its stage's centroid, where a stage has several samples.

    Centroid tables hold one row per (stage, sample); they join back on those keys. Returns
    the corrected rows and the size of each shift.
    """
    v = doubles(F.col(vec))
    by_sample = df.groupBy(stage, sample).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v[i]) for i in range(dims)]).alias("_s"))
    by_stage = by_sample.groupBy(stage).agg(
        F.count(F.lit(1)).alias("_samples"), F.array(*[F.sum(F.col("_s")[i]) / F.sum("n") for i in range(dims)]).alias("_stage")
    )
    table = by_sample.join(by_stage, stage)
    applied = F.col("_samples") > 1
    shift = F.array(*[F.when(applied, F.col("_s")[i] / F.col("n") - F.col("_stage")[i]).otherwise(0.0) for i in range(dims)])
    table = table.select(stage, sample, "n", applied.alias("applied"), shift.alias("_shift"))
    moved = df.join(table.select(stage, sample, "_shift"), [stage, sample]).withColumn(vec, F.zip_with(v, F.col("_shift"), lambda a, b: a - b)).select(*df.columns)
    return moved, table.select(stage, sample, "n", "applied", norm(F.col("_shift")).alias("shift_norm"))


def axis_correlations(df: DataFrame, vec: str, covariates: Sequence[str], dims: int | None = None) -> DataFrame:
    """Spearman of every vector dimension with every covariate, long form (dimension, covariate)."""
    v = doubles(F.col(vec)) if dims is None else doubles(F.slice(F.col(vec), 1, dims))
    long = df.select(*covariates, F.posexplode(v).alias("_p", "x")).select((F.col("_p") + 1).alias("dimension"), "x", *covariates)
    melted = long.select("dimension", "x", F.inline(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("y")) for c in covariates])))
    rho = spearman(melted, "x", "y", ["dimension", "covariate"], "rho")
    return rho.withColumn("abs_rho", F.abs("rho"))


def technical_axes(correlations: DataFrame, threshold: float = AXIS_RHO) -> DataFrame:
    """Dimensions and whether any covariate reaches the threshold in absolute value."""
    return correlations.groupBy("dimension").agg(F.max("abs_rho").alias("max_abs_rho")).withColumn("technical", F.col("max_abs_rho") >= threshold)


def drop_axes(df: DataFrame, vec: str, axes: Sequence[int]) -> DataFrame:
    """Vector without the listed 1-based dimensions (a short list of flagged axes)."""
    flagged = F.array(*[F.lit(int(a)) for a in axes]) if axes else F.array().cast("array<int>")
    return df.withColumn(vec, F.filter(F.col(vec), lambda x, i: ~F.array_contains(flagged, i + 1)))


def root_medoid(df: DataFrame, id: str, vec: str, dims: int, pool: Column, center: str = "mean") -> DataFrame:
    """Entity of the pool nearest its mean (or coordinate-wise median) centre; ties by id."""
    rows = df.where(pool).select(F.col(id).alias("id"), doubles(F.col(vec)).alias("v"))
    if center == "mean":
        c = rows.agg(mean_vector(F.col("v"), dims).alias("c"))
    else:
        long = rows.select(F.posexplode(F.slice("v", 1, dims)).alias("p", "x"))
        q = quantiles(long, ["p"], "x", {"m": 0.5})
        c = q.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("c"))  # one value per dimension
    d = distance(F.slice("v", 1, dims), F.col("c"))
    return rows.crossJoin(F.broadcast(c)).agg(F.min(F.struct(d.alias("d"), "id")).alias("s"), F.count(F.lit(1)).alias("n_pool")).select(
        F.col("s.id").alias("root_id"), F.col("s.d").alias("root_distance"), "n_pool"
    )


def batch_shift(df: DataFrame, label: str, batch: str, clock: str) -> DataFrame:
    """Absolute difference of the two batch medians per label; labels with another batch count
    are left out."""
    sizes = df.where(F.col(clock).isNotNull()).groupBy(label, batch).agg(F.count(F.lit(1)).alias("n"))
    m = same_keys(quantiles(df, [label, batch], clock, {"median": 0.5}), sizes, [label, batch])
    b = F.col(batch).cast("string")
    g = m.groupBy(label).agg(
        F.min(b).alias("group_1"), F.max(b).alias("group_2"), F.min_by("n", b).alias("n_1"), F.max_by("n", b).alias("n_2"),
        F.min_by("median", b).alias("median_1"), F.max_by("median", b).alias("median_2"), F.count(F.lit(1)).alias("_g"),
    ).where("_g = 2").drop("_g")
    return g.withColumn("absolute_difference", F.abs(F.col("median_1") - F.col("median_2")))


def pairwise_overlap(q: DataFrame, label: str, low: str, high: str, order: Sequence[str]) -> DataFrame:
    """Overlap over union of the intervals of consecutive labels; q has one row per label."""
    at = lambda l, c: F.max(F.when(F.col(label) == l, F.col(c)))
    rows = []
    for a, b in zip(order[:-1], order[1:]):
        left, right = F.greatest(at(a, low), at(b, low)), F.least(at(a, high), at(b, high))
        union = F.greatest(at(a, high), at(b, high)) - F.least(at(a, low), at(b, low))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(union > 0, F.greatest(F.lit(0.0), right - left) / union).alias("overlap")))
    return q.agg(F.array(*rows).alias("r")).select(F.inline("r"))


# ------------------------------------------------------------------- QC classes
def biology_ratio(technical: Column, biology: Column) -> Column:
    """Biology's share of variance over the technical one; infinite where nothing technical is found."""
    return F.when((technical > 0) & ~F.isnan(technical), F.try_divide(biology, technical)).otherwise(F.lit(float("inf")))


def qc_label(technical: Column, biology: Column, mixing: Column) -> Column:
    """PASS / WARN / REVIEW of a representation; a measure that is not a number passes nothing."""
    known = ~F.isnan(technical) & ~F.isnan(biology) & ~F.isnan(mixing)
    wins = known & (biology > technical)
    return F.when((technical < 0.05) & wins & (mixing >= 0.70), "PASS").when((technical < 0.10) & wins & (mixing >= 0.50), "WARN").otherwise("REVIEW")


def qc_class(technical: Column, ratio: Column, mixing: Column) -> Column:
    """STRONG / ACCEPTABLE / CAUTION / REVIEW of a rescued representation, `ratio` as `biology_ratio` gives it.
    Spark ranks NaN above all numbers, the method below: a measure that is not a number passes nothing."""
    known = ~F.isnan(technical) & ~F.isnan(ratio) & ~F.isnan(mixing)
    return (
        F.when(known & (technical < 0.05) & (ratio >= 4) & (mixing >= 0.70), "STRONG")
        .when(known & (technical < 0.08) & (ratio >= 3) & (mixing >= 0.55), "ACCEPTABLE")
        .when(known & (technical < 0.10) & (ratio >= 2) & (mixing >= 0.40), "CAUTION")
        .otherwise("REVIEW")
    )


def reindex(df: DataFrame, label: str, keep: Sequence[str], order: str) -> DataFrame:
    """Rows with a listed label, with their own dense index along `order`."""
    return rank_rows(df.where(F.col(label).isin(list(keep))), [order], (), "row_index")
