"""Score curves over window positions: rows (series, idx, x, y), idx dense from 0 in each series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shipped
from .ordered import neighbors, rank_rows, running
from .stats import correlation, quantiles, spearman

S = ["series"]
WHOLE = 1 << 19  # points of the longest curve that one task may take whole


def complete(p: DataFrame, key: Sequence[str], whole: int = WHOLE) -> bool:
    """Whether each curve has at most `whole` points, none without x or y, and idx dense from 0."""
    gap = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y") | (F.col("idx") < 0)
    ends = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"), F.bool_or(gap).alias("gap"))
    return ends.where(F.col("gap") | (F.col("n") > whole) | ~F.col("last").eqNullSafe(F.col("n") - 1)).isEmpty()


def extent(p: DataFrame) -> DataFrame:
    """Per series: points, range of x and y, first position of the maximum."""
    return p.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.avg("y").alias("y_mean"),
        F.max_by("idx", F.struct("y", -F.col("idx"))).alias("top_idx"),
        F.max_by("x", F.struct("y", -F.col("idx"))).alias("top_x"),
    )


def spacing(p: DataFrame) -> DataFrame:
    """Median distance between adjacent positions per series."""
    steps = neighbors(p.select("series", "idx", "x"), S, "idx", ["x"]).withColumn("dx", F.col("x") - F.col("prev_x"))
    return quantiles(steps, S, "dx", {"median_spacing": 0.5})


def family_tolerance(p: DataFrame, floor: float = 0.02, multiple: float = 3.0) -> DataFrame:
    """Resolution-derived tolerance: a multiple of the median spacing, at least `floor`."""
    return spacing(p).withColumn("tolerance", F.greatest(F.lit(floor), F.lit(multiple) * F.col("median_spacing")))


def summarize(p: DataFrame) -> DataFrame:
    """Extent, median score, and rank correlation of score with position."""
    return extent(p).join(quantiles(p, S, "y", {"y_median": 0.5}), S).join(spearman(p, "x", "y", S, "rho_position"), S)


def shape(p: DataFrame) -> DataFrame:
    """Slope signs, total variation and net change per series.

    A slope is flat when its size is at most a hundredth of the median absolute slope.
    """
    near = neighbors(p, S, "idx", ["x", "y"])
    steps = near.where(F.col("prev_x").isNotNull()).select(
        "series",
        ((F.col("y") - F.col("prev_y")) / (F.col("x") - F.col("prev_x"))).alias("slope"),
        F.abs(F.col("y") - F.col("prev_y")).alias("dy"),
    ).withColumn("size", F.abs("slope"))
    eps = quantiles(steps, S, "size", {"median_abs_slope": 0.5}).withColumn(
        "_eps", F.greatest(F.lit(1e-12), F.lit(0.01) * F.col("median_abs_slope"))
    )
    signs = steps.join(eps, S).groupBy("series").agg(
        F.avg((F.col("slope") > F.col("_eps")).cast("int")).alias("fraction_positive"),
        F.avg((F.col("slope") < -F.col("_eps")).cast("int")).alias("fraction_negative"),
        F.avg((F.col("size") <= F.col("_eps")).cast("int")).alias("fraction_flat"),
        F.sum("dy").alias("total_variation"),
        F.max("median_abs_slope").alias("median_abs_slope"),
        F.max("size").alias("max_abs_slope"),
    )
    ends = p.groupBy("series").agg((F.max_by("y", "idx") - F.min_by("y", "idx")).alias("net_change"))
    return signs.join(ends, S).withColumn(
        "variation_to_net", F.when(F.abs("net_change") > 1e-12, F.col("total_variation") / F.abs("net_change"))
    )


def envelopes(p: DataFrame, levels: Sequence[float]) -> DataFrame:
    """For each level of the range: the unbroken stretch above it that holds the maximum.

    Its ends are the nearest points below the threshold on either side of the maximum, so one
    aggregation replaces a walk along the curve.
    """
    ext = extent(p)
    rows = p.join(ext, S).withColumn("level", F.explode(F.array(*[F.lit(float(l)) for l in levels])))
    rows = rows.withColumn("threshold", F.col("y_min") + F.col("level") * (F.col("y_max") - F.col("y_min")))
    below = F.col("y") < F.col("threshold")
    keys = ["series", "level"]
    ends = rows.groupBy(*keys, "threshold", "top_idx", "top_x", "n_points").agg(
        F.coalesce(F.max(F.when(below & (F.col("idx") < F.col("top_idx")), F.col("idx"))) + 1, F.lit(0)).alias("start_idx"),
        F.coalesce(F.min(F.when(below & (F.col("idx") > F.col("top_idx")), F.col("idx"))) - 1, F.col("n_points") - 1).alias("end_idx"),
    )
    pos = p.select("series", F.col("idx").alias("start_idx"), F.col("x").alias("start_x"))
    pos2 = p.select("series", F.col("idx").alias("end_idx"), F.col("x").alias("end_x"))
    out = ends.join(pos, ["series", "start_idx"]).join(pos2, ["series", "end_idx"])
    return out.select(
        "series", "level", "threshold", "top_x", "start_idx", "end_idx", "start_x", "end_x",
        (F.col("end_x") - F.col("start_x")).alias("width"),
        (F.col("end_idx") - F.col("start_idx") + 1).alias("n_inside"),
        ((F.col("end_idx") - F.col("start_idx") + 1) / F.col("n_points")).alias("fraction_points"),
    )


def contiguous_component(p: DataFrame, mask: Column, target: Column) -> DataFrame:
    """Inclusive ends of the unbroken true stretch around a target index, per series.

    The target's own flag must be true: the result is empty for a series where it is not.
    """
    rows = p.withColumn("_t", target).withColumn("_m", mask)
    out = rows.groupBy("series").agg(
        F.max("_t").alias("target"),
        F.max("idx").alias("_last"),
        F.bool_or(F.col("_m") & (F.col("idx") == F.col("_t"))).alias("_inside"),
        F.max(F.when(~F.col("_m") & (F.col("idx") < F.col("_t")), F.col("idx"))).alias("_lo"),
        F.min(F.when(~F.col("_m") & (F.col("idx") > F.col("_t")), F.col("idx"))).alias("_hi"),
    )
    return out.where("_inside").select(
        "series", "target", F.coalesce(F.col("_lo") + 1, F.lit(0)).alias("start_idx"),
        F.coalesce(F.col("_hi") - 1, F.col("_last")).alias("end_idx"),
    )


# ------------------------------------------------------------- interpolation
def segments(x: np.ndarray, gx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position of `gx`: the points of a curve (by idx) it lies between and its share of the way from
    the first to the second. The first is the last of the points at or before it; outside the curve they are one."""
    order = np.argsort(x, kind="stable")
    lo = np.concatenate(([-1], np.maximum.accumulate(order)))[np.searchsorted(x[order], gx, side="right")]
    here, nxt = np.maximum(lo, 0), np.minimum(lo + 1, len(x) - 1)
    step = x[nxt] - x[here]
    t = np.divide(gx - x[here], step, out=np.zeros(len(gx)), where=step != 0)
    inner = (lo >= 0) & (lo + 1 < len(x))
    return here, np.where(inner, nxt, here), np.where(inner, t, 0.0)


def _read_whole(points: DataFrame, curve: DataFrame, key: list[str]) -> DataFrame:
    """`interpolate` where a task takes a curve and its points."""
    columns = points.columns

    def read(points, curve):
        gx = points["gx"].cast(pa.float64()).to_numpy()
        rows = curve.sort_by("_at")
        x, y = rows["_x"].to_numpy(), rows["_y"].to_numpy()
        if len(x):
            here, nxt, t = segments(x, gx)
            gy = y[here] + t * (y[nxt] - y[here])
        else:
            points, gy = points.slice(0, 0), np.empty(0)
        return pa.table({**{c: points[c] for c in columns}, "gy": pa.array(gy)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", gy double"
    # renamed: both sides of the co-group may come from the same table
    names = [f"_key_{i}" for i in range(len(key))]
    other = curve.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("idx").alias("_at"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    return shipped(points).groupBy(*key).cogroup(other.groupBy(*names)).applyInArrow(read, schema)


def interpolate(points: DataFrame, curve: DataFrame, key: Sequence[str], whole: int = WHOLE) -> DataFrame:
    """np.interp over many curves: `points` (key, gx) read off `curve` (key, idx, x, y).

    Curve and distinct points are ranked together by position; a running maximum of the curve
    index then tells each point which segment it lies on, and the two ends come by equi-join.
    Cost stays linear however unevenly the positions are spread. Outside the curve the end
    values hold. Complete curves of up to `whole` points, with up to as many to read, are a task each.
    """
    key = list(key)
    if complete(curve, key, whole):
        many = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("gx").isNull() | F.isnan("gx")).alias("gap"))
        if many.where(F.col("gap") | (F.col("n") > whole)).isEmpty():
            return _read_whole(points, curve, key)
    both = curve.select(*key, "x", F.lit(0).alias("_kind"), F.col("idx").alias("_seg")).unionByName(
        points.select(*key, F.col("gx").alias("x")).distinct().select(*key, "x", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_seg"))
    )
    ranked = rank_rows(both, ["x", "_kind"], key, "_pos")
    placed = running(ranked, key, "_pos", {"_lo": ("max", F.col("_seg"))}).where("_kind = 1").select(*key, F.col("x").alias("gx"), "_lo")
    near = neighbors(curve.select(*key, "idx", "x", "y"), key, "idx", ["x", "y"])
    seg = near.select(*key, F.col("idx").alias("_lo"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("next_x").alias("_ex"), F.col("next_y").alias("_ey"))
    first = curve.groupBy(*key).agg(F.min_by("y", "idx").alias("_first"))
    t = F.coalesce(F.try_divide(F.col("gx") - F.col("_x"), F.col("_ex") - F.col("_x")), F.lit(0.0))
    value = F.when(F.col("_lo").isNull(), F.col("_first")).when(F.col("_ex").isNull(), F.col("_y")).otherwise(F.col("_y") + t * (F.col("_ey") - F.col("_y")))
    read = placed.join(seg, [*key, "_lo"], "left").join(first, key).select(*key, "gx", value.alias("gy"))
    return points.join(read, [*key, "gx"])


def compare(reference: DataFrame, alternative: DataFrame, key: Sequence[str]) -> DataFrame:
    """Alternative curve read at the reference positions in the shared range.

    Per `key` + alternative `series`: points compared, Pearson, Spearman, mean absolute
    difference and shift of the maximum. Interpolation never leaves the shared range.
    """
    ref_ext = extent(reference.withColumn("series", F.concat_ws("|", *key))).select(
        F.col("series").alias("_ref"), F.col("x_min").alias("r0"), F.col("x_max").alias("r1"), F.col("top_x").alias("reference_top_x")
    )
    alt_ext = extent(alternative).select("series", F.col("x_min").alias("a0"), F.col("x_max").alias("a1"), F.col("top_x").alias("alternative_top_x"))
    links = alternative.select("series", *key).distinct().withColumn("_ref", F.concat_ws("|", *key))
    bounds = links.join(ref_ext, "_ref").join(alt_ext, "series").select(
        "series", "_ref", "reference_top_x", "alternative_top_x",
        F.greatest("r0", "a0").alias("shared_min"), F.least("r1", "a1").alias("shared_max"),
    )
    grid = reference.withColumn("_ref", F.concat_ws("|", *key)).select("_ref", F.col("x").alias("gx"), F.col("y").alias("ry"))
    grid = grid.join(bounds, "_ref").where(F.col("gx").between(F.col("shared_min"), F.col("shared_max"))).select("series", "gx", "ry")
    both = materialize(interpolate(grid, alternative.select("series", "idx", "x", "y"), S))
    stats = both.groupBy("series").agg(F.count(F.lit(1)).alias("n_compared"), F.avg(F.abs(F.col("ry") - F.col("gy"))).alias("mae"))
    out = bounds.drop("_ref").join(stats, S).join(correlation(both, "ry", "gy", S, "pearson"), S)
    out = out.join(spearman(both.select("series", F.round("ry", 9).alias("ry"), F.round("gy", 9).alias("gy")), "ry", "gy", S, "spearman"), S)
    return out.withColumn("top_shift", F.abs(F.col("alternative_top_x") - F.col("reference_top_x")))


# ------------------------------------------------------------- mass and timing
def mass_location(p: DataFrame, q: float = 0.5) -> DataFrame:
    """Position where the cumulative share of the clipped score reaches q (linear between points)."""
    rows = p.withColumn("_m", F.greatest(F.col("y"), F.lit(0.0)))
    total = rows.groupBy("series").agg(F.sum("_m").alias("_total"))
    cum = running(rows, S, "idx", {"_c": ("sum", F.col("_m"))}).join(total, S)
    return _crossing(cum.where("_total > 0").withColumn("_c", F.col("_c") / F.col("_total")), {"q": q}).withColumnRenamed("q", "location")


def area_quantiles(p: DataFrame, qs: dict[str, float]) -> DataFrame:
    """Positions at which the trapezoid area above the curve's own minimum reaches each share."""
    base = p.groupBy("series").agg(F.min("y").alias("baseline"))
    rows = neighbors(p.join(base, S).withColumn("_e", F.col("y") - F.col("baseline")), S, "idx", ["x", "_e"])
    trap = F.coalesce((F.col("x") - F.col("prev_x")) * (F.col("_e") + F.col("prev__e")) / 2, F.lit(0.0))
    cum = running(rows, S, "idx", {"_c": ("sum", trap)})
    total = cum.groupBy("series").agg(F.max("_c").alias("area"), F.max("baseline").alias("baseline")).where("area > 0")
    share = cum.drop("baseline").join(total, S).withColumn("_c", F.col("_c") / F.col("area"))
    return total.join(_crossing(share.drop("prev_x", "next_x"), qs), S)


def _crossing(cum: DataFrame, qs: dict[str, float]) -> DataFrame:
    """np.interp(q, cumulative, x): the last point at or below q, then linear to the next one.

    The bracketing points are found by two max/min aggregates per quantile; no sort is needed.
    """
    aggs = []
    for o, q in qs.items():
        low, high = F.col("_c") <= q, F.col("_c") > q
        aggs.append(F.max(F.when(low, F.struct("idx", "x", "_c"))).alias(f"_l_{o}"))
        aggs.append(F.min(F.when(high, F.struct("idx", "x", "_c"))).alias(f"_h_{o}"))
    got = cum.groupBy("series").agg(*aggs)
    cols = []
    for o, q in qs.items():
        l, h = F.col(f"_l_{o}"), F.col(f"_h_{o}")
        t = (F.lit(float(q)) - l["_c"]) / (h["_c"] - l["_c"])
        cols.append(F.when(l.isNull(), h["x"]).when(h.isNull(), l["x"]).otherwise(l["x"] + t * (h["x"] - l["x"])).alias(o))
    return got.select("series", *cols)


def js_divergence(pairs: DataFrame, key: Sequence[str], a: str, b: str) -> DataFrame:
    """Base-2 Jensen-Shannon divergence and distance of two clipped, normalised score columns."""
    key = list(key)
    rows = pairs.withColumn("_a", F.greatest(F.col(a), F.lit(0.0))).withColumn("_b", F.greatest(F.col(b), F.lit(0.0)))
    # with sa, sb the totals: sum p log2(p/m) expands into per-row terms once the totals are known
    tot = rows.groupBy(*key).agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb")).where("_sa > 0 and _sb > 0")
    n = rows.join(tot, key).withColumn("_p", F.col("_a") / F.col("_sa")).withColumn("_q", F.col("_b") / F.col("_sb"))
    m = (F.col("_p") + F.col("_q")) / 2
    part = lambda p: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    js = F.greatest((F.sum(part(F.col("_p"))) + F.sum(part(F.col("_q")))) / 2, F.lit(0.0))
    return n.groupBy(*key).agg(js.alias("js_divergence")).withColumn("js_distance", F.sqrt("js_divergence"))
