"""Ordered-series primitives that never put a whole series into one task.

Spark's window functions sort a whole window partition in one task, which an un-partitioned
rank, lag or cumulative sum turns into "the table in one task". Everything ordered in this
library goes through three building blocks instead:

* `rank_rows`    global or per-group position by range partitioning;
* `neighbors`    lag and lead over a dense position, by fixed-size blocks with a halo;
* `running`      cumulative sum, minimum or maximum, in blocks plus block totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize

BLOCK = 16_384


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal `keys` where NULL equals NULL, as in a grouping; the keys of `left` stay."""
    if not keys:
        return left.crossJoin(right)  # a table without groups has one row of totals
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on = on & left[k].eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def rank_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "rk") -> DataFrame:
    """0-based position of each row along `order` (a total order) within `by`; NULL is a group.

    The rows are range-partitioned on (by, order) into spark.sql.shuffle.partitions ranges, written
    once, and each range adds the count of its group's earlier ranges. The range key holds the
    tie-breaking column, so one repeated order value is split over many tasks.
    """
    keys = [*by, *order]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialize(
        df.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_local", local)
    )
    per_range = ranged.groupBy(*by, "_range").agg(F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = per_range.select(*by, "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return same_keys(ranged, base, [*by, "_range"]).withColumn(out, F.col("_base") + F.col("_local") - F.col("_first")).drop("_range", "_local", "_first", "_base")


def neighbors(
    df: DataFrame, by: Sequence[str], idx: str, cols: Sequence[str], offset: int = 1, block: int = BLOCK
) -> DataFrame:
    """Add prev_<c> and next_<c>: the values `offset` positions away on a dense `idx`.

    Rows at a block edge are also sent to the adjacent block, so each block is an ordinary
    bounded window partition and the whole series needs one shuffle.
    """
    home = F.floor(F.col(idx) / block).cast("bigint")
    within = F.col(idx) % block
    targets = F.filter(
        F.array(home, F.when(within < offset, home - 1), F.when(within >= block - offset, home + 1)),
        lambda b: b.isNotNull() & (b >= 0),
    )
    w = Window.partitionBy(*by, "_block").orderBy(idx)
    spread = df.withColumn("_block", F.explode(targets))
    for c in cols:
        spread = spread.withColumn(f"prev_{c}", F.lag(c, offset).over(w)).withColumn(f"next_{c}", F.lead(c, offset).over(w))
    return spread.where(F.col("_block") == home).drop("_block")


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(
    df: DataFrame,
    by: Sequence[str],
    idx: str,
    outputs: dict[str, tuple[str, Column]],
    reverse: bool = False,
    block: int = BLOCK,
    stored: bool = False,
) -> DataFrame:
    """Inclusive cumulative aggregates along `idx`: out -> ("sum" | "min" | "max", expression).

    Two levels: one row of totals per block, a window over those few rows, and a window
    inside each block. NULL values are skipped and NULL is a group. The input is written once,
    so that what led to it is not run again for the totals; with `stored` it stands on written rows
    already, such as those of `rank_rows`, and is read twice instead.
    """
    df = df if stored else materialize(df)
    direction = F.col(idx).desc() if reverse else F.col(idx).asc()
    block_order = F.col("_block").desc() if reverse else F.col("_block").asc()
    blocked = df.withColumn("_block", F.floor(F.col(idx) / block).cast("bigint"))
    for o, (_, expr) in outputs.items():
        blocked = blocked.withColumn(f"_v_{o}", expr)
    totals = blocked.groupBy(*by, "_block").agg(*[_COMBINE[k][0](f"_v_{o}").alias(f"_t_{o}") for o, (k, _) in outputs.items()])
    before = Window.partitionBy(*by).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_block", *[_COMBINE[k][0](f"_t_{o}").over(before).alias(f"_b_{o}") for o, (k, _) in outputs.items()])
    inner = Window.partitionBy(*by, "_block").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    joined = same_keys(blocked, offsets, [*by, "_block"])
    for o, (k, _) in outputs.items():
        joined = joined.withColumn(o, _COMBINE[k][1](F.col(f"_b_{o}"), _COMBINE[k][0](f"_v_{o}").over(inner)))
    extra = [f"_{p}_{o}" for o in outputs for p in ("v", "b")]
    return joined.drop("_block", *extra)


def adjacent(df: DataFrame, by: Sequence[str], idx: str, col: str) -> DataFrame:
    """Add d_<col>: value minus the previous value (NULL on the first row)."""
    near = neighbors(df, by, idx, [col])
    return near.withColumn(f"d_{col}", F.col(col) - F.col(f"prev_{col}")).drop(f"prev_{col}", f"next_{col}")


def not_increasing(df: DataFrame, by: Sequence[str], idx: str, col: str) -> DataFrame:
    """Per series: number of steps, and how many of them do not strictly increase."""
    steps = adjacent(df.select(*by, idx, col), by, idx, col)
    return steps.groupBy(*by).agg(
        F.count(f"d_{col}").alias("n_steps"),
        F.count_if(F.col(f"d_{col}") <= 0).alias("n_not_increasing"),
    )


def contiguous_strata(rk: Column, n: Column | int, parts: int) -> Column:
    """array_split rule: `parts` contiguous strata, the first n mod parts one row longer."""
    n = n if isinstance(n, Column) else F.lit(n)
    small = F.floor(n / parts)
    extra = n % parts
    edge = extra * (small + 1)
    return F.when(rk < edge, F.floor(rk / (small + 1))).otherwise(extra + F.floor((rk - edge) / F.greatest(small, F.lit(1)))).cast("int")


def fixed_strata(rk: Column, size: int) -> Column:
    """Chunks of `size` consecutive ranks, the last one shorter."""
    return F.floor(rk / size).cast("int")
