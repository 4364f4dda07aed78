"""Change of the window centroid along a clock: this library's own statistic."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, square_distance
from .ordered import neighbors
from .windows import Design, window_ids


def transition_energy(ranked: DataFrame, vec: str, dims: int, d: Design, n: int) -> DataFrame:
    """Squared distance between the centroids of the windows before and after, over the mean
    within-window variance of the two. Pane sums only; the two end windows take their one side
    as zero change."""
    pane = math.gcd(d.size, d.step)
    v = doubles(F.col(vec))
    sums = ranked.groupBy(F.floor(F.col("rk") / pane).alias("_pane")).agg(
        *[F.sum(v[i]).alias(f"s{i}") for i in range(dims)], sum((F.sum(v[i] * v[i]) for i in range(dims)), F.lit(0.0)).alias("q")
    )
    spread = sums.withColumn("window_index", F.explode(window_ids(F.col("_pane") * pane, d, n, span=pane)))
    m = F.array(*[F.sum(f"s{i}") / d.size for i in range(dims)])
    win = spread.groupBy("window_index").agg(m.alias("m"), (F.sum("q") / d.size).alias("q2"))
    spread_var = F.col("q2") - F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x)
    win = win.select("window_index", "m", spread_var.alias("s2"))
    near = neighbors(win, [], "window_index", ["m", "s2"])
    both = F.col("prev_m").isNotNull() & F.col("next_m").isNotNull()
    pooled = (F.col("prev_s2") + F.col("next_s2")) / 2
    energy = F.when(both & (pooled > 0), square_distance(F.col("prev_m"), F.col("next_m")) / pooled).otherwise(0.0)
    return near.select("window_index", energy.alias("transition_energy"))
