"""Long-form counts (entity, feature, count): depth, normalisation, feature choice, group effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Library target, scale clip, kept features, pseudocounts, candidate limits.
LIBRARY_TARGET = 10_000.0
SCALE_CLIP = 10.0
TOP_FEATURES_A = 2_500
TOP_FEATURES_B = 25_000
CPM_PSEUDOCOUNT = 0.5
FRACTION_PSEUDOCOUNT = 1e-4
A_MIN_FRACTION = 0.05
A_MIN_CPM = 2.0
A_MIN_LOG2FC = 0.5
A_MIN_DELTA = 0.02
B_MIN_GAIN = 0.05
B_MIN_FRACTION = 0.05


def collapse(df: DataFrame, entity: str, feature: str, count: Column) -> DataFrame:
    """One row per (entity, feature) with a positive total; a negative count is an error."""
    checked = F.when(count < 0, F.raise_error(F.lit("negative count")).cast("double")).otherwise(count.cast("double"))
    summed = df.groupBy(F.col(entity).alias("entity"), F.col(feature).alias("feature")).agg(F.sum(checked).alias("count"))
    return summed.where("count > 0")


def depth(counts: DataFrame) -> DataFrame:
    """Total count and detected features per entity."""
    return counts.groupBy("entity").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("n_detected"))


def log_normalized(counts: DataFrame, target: float = LIBRARY_TARGET) -> DataFrame:
    """log1p(count / library * target)."""
    lib = counts.groupBy("entity").agg(F.sum("count").alias("_lib"))
    return counts.join(lib, "entity").select("entity", "feature", F.log1p(F.col("count") / F.col("_lib") * target).alias("value"))


def feature_moments(values: DataFrame, n_entities: int, sample: bool) -> DataFrame:
    """Mean and variance per feature with the unstored zeros counted in.

    `sample` picks the n - 1 divisor of the one branch, otherwise the n divisor of the other.
    """
    s, q, n = F.sum("value"), F.sum(F.col("value") * F.col("value")), F.lit(float(n_entities))
    var = (q - s * s / n) / (n - (1 if sample else 0))
    return values.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_detected"), (s / n).alias("mean"), F.greatest(var, F.lit(0.0)).alias("variance")
    )


def top_features(moments: DataFrame, k: int, by: str = "variance") -> DataFrame:
    """The k features with the largest `by`; equal values keep the smaller feature id."""
    return moments.orderBy(F.col(by).desc(), "feature").limit(k)


def scaled(values: DataFrame, moments: DataFrame, clip: float = SCALE_CLIP) -> DataFrame:
    """z-scores of the kept features, clipped, stored relative to the score of a zero count.

    `delta` is the clipped z minus the clipped z of zero, so unstored zeros stay unstored and
    centring gives exactly the scaled matrix.
    """
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    bound = lambda z: F.greatest(F.least(z, F.lit(clip)), F.lit(-clip))
    m = moments.select("feature", "mean", sd.alias("_sd"))
    z = bound((F.col("value") - F.col("mean")) / F.col("_sd"))
    zero = bound(-F.col("mean") / F.col("_sd"))
    return values.join(m, "feature").select("entity", "feature", z.alias("z"), (z - zero).alias("delta"))


def tfidf(presence: DataFrame, n_entities: int) -> DataFrame:
    """Binary presence: tf = 1 / features of the entity, idf = log1p(N / (1 + df)).

    Entities without any feature have no row and must be refused by the caller's depth check.
    """
    hit = presence.select("entity", "feature").distinct()
    row = hit.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"))
    df = hit.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    return hit.join(row, "entity").join(df, "feature").select(
        "entity", "feature", "df", (F.lit(1.0) / F.col("_n") * F.log1p(F.lit(float(n_entities)) / (1 + F.col("df")))).alias("value")
    )


def require_depth(entities: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Entities with no count at all; callers raise when this is not empty."""
    return entities.join(counts.select(F.col("entity").alias(key)).distinct(), key, "left_anti")


# --------------------------------------------------------------- group contrasts
def group_effects(counts: DataFrame, groups: DataFrame, names: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Per feature and group: count, CPM, detected fraction; adjacent log2 ratios and deltas.

    `groups` maps entity -> group. Group libraries are the group totals over all features.
    """
    tagged = counts.join(groups, "entity")
    per = tagged.groupBy("feature").agg(
        *[F.coalesce(F.sum(F.when(F.col("group") == g, F.col("count"))), F.lit(0.0)).alias(f"{g}_count") for g in names],
        *[F.count_if(F.col("group") == g).alias(f"{g}_detected") for g in names],
    )
    libs = tagged.groupBy().agg(*[F.sum(F.when(F.col("group") == g, F.col("count"))).alias(f"{g}_lib") for g in names])
    wide = per.crossJoin(F.broadcast(libs))  # a single row of group totals
    for g in names:
        wide = wide.withColumn(f"{g}_cpm", F.col(f"{g}_count") / F.col(f"{g}_lib") * 1e6)
        wide = wide.withColumn(f"{g}_fraction", F.try_divide(F.col(f"{g}_detected"), F.lit(float(sizes[g]))))  # NULL for an empty group
    for a, b in zip(names[:-1], names[1:]):
        wide = wide.withColumn(f"log2fc_{b}_vs_{a}", F.log2((F.col(f"{b}_cpm") + CPM_PSEUDOCOUNT) / (F.col(f"{a}_cpm") + CPM_PSEUDOCOUNT)))
        wide = wide.withColumn(f"delta_{b}_vs_{a}", F.col(f"{b}_fraction") - F.col(f"{a}_fraction"))
    return wide.drop(*[f"{g}_lib" for g in names])


def presence_effects(counts: DataFrame, groups: DataFrame, names: Sequence[str], sizes: dict[str, int]) -> DataFrame:
    """Per feature and group: presence fraction, total, mean; deltas and log2 ratios of fractions."""
    tagged = counts.join(groups, "entity")
    aggs = []
    for g in names:
        mine = F.col("group") == g
        aggs += [
            F.count_if(mine).alias(f"{g}_entities"),
            F.try_divide(F.count_if(mine), F.lit(float(sizes[g]))).alias(f"{g}_fraction"),
            F.coalesce(F.sum(F.when(mine, F.col("count"))), F.lit(0.0)).alias(f"{g}_sum"),
        ]
    wide = tagged.groupBy("feature").agg(*aggs)
    for g in names:
        wide = wide.withColumn(f"{g}_mean", F.try_divide(F.col(f"{g}_sum"), F.lit(float(sizes[g]))))
    for a, b in zip(names[:-1], names[1:]):
        fa, fb = F.col(f"{a}_fraction"), F.col(f"{b}_fraction")
        wide = wide.withColumn(f"delta_{b}_vs_{a}", fb - fa)
        wide = wide.withColumn(f"log2ratio_{b}_vs_{a}", F.log2((fb + FRACTION_PSEUDOCOUNT) / (fa + FRACTION_PSEUDOCOUNT)))
    return wide


def a_candidates(effects: DataFrame, names: Sequence[str]) -> DataFrame:
    """Prevalence-aware increases of the last and of the middle group over the one before."""
    parts = []
    for label, (a, b) in (("later_increase", names[1:3]), ("event_increase", names[0:2])):
        keep = (
            (F.col(f"{b}_fraction") >= A_MIN_FRACTION) & (F.col(f"{b}_cpm") >= A_MIN_CPM)
            & (F.col(f"log2fc_{b}_vs_{a}") >= A_MIN_LOG2FC) & (F.col(f"delta_{b}_vs_{a}") >= A_MIN_DELTA)
        )
        parts.append(effects.where(keep).select(F.lit(label).alias("candidate_class"), "*"))
    return parts[0].unionByName(parts[1])


def b_candidates(effects: DataFrame, names: Sequence[str]) -> DataFrame:
    a, b = names[0:2]
    return effects.where((F.col(f"delta_{b}_vs_{a}") >= B_MIN_GAIN) & (F.col(f"{b}_fraction") >= B_MIN_FRACTION))


def ranked_top(df: DataFrame, label: str, keys: Sequence[Column], n: int) -> DataFrame:
    """The top n rows by sort keys, tagged (a report table; n is its size)."""
    return df.orderBy(*keys).limit(n).select(F.lit(label).alias("candidate_class"), "*")
