"""Local maxima of score curves, their prominence and half-height width, and peak families.

Curves are rows (series, idx, x, y) with idx dense from 0. All steps work on blocks of a
curve, so a curve of any length is spread over tasks:

1. equal neighbours collapse to runs; a peak is a run above both neighbouring runs;
2. prominence needs, on each side, the lowest point before the first higher one. A peak's own
   block answers that when it can; the rest climb levels of block extremes until a group holds a
   higher value, and descend to it again, by one join a level.

Where every curve is complete and has at most `WHOLE` points, as in bootstraps with very many curves,
the peak tables take each curve in one task instead: one shuffle in place of some twenty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shipped
from .ordered import BLOCK, neighbors, rank_rows, running, same_keys
from .profiles import WHOLE, complete, extent, spacing
from .stats import quantiles

S = ["series"]
QUERIES_PER_TASK = 65_536

# Fixed values of the discovery rule: relative prominence, minimum distance in windows.
RELATIVE_PROMINENCE = 0.05
MIN_DISTANCE = 3
# Fixed values of the validation rule: prominence floor, share of range, edge points and spacings.
PROMINENCE_FLOOR = 0.005
PROMINENCE_SHARE = 0.05
EDGE_POINTS = 3
EDGE_SPACINGS = 2.0
# Family tolerances and robustness limits.
DISCOVERY_TOLERANCE = 0.08
DISCOVERY_MAX_SPREAD = 0.10


# ----------------------------------------------------------------- local maxima
def runs(p: DataFrame, block: int = BLOCK) -> DataFrame:
    """Equal neighbours as one row: (series, run, y, first, last), run dense from 0."""
    near = neighbors(p.select("series", "idx", "y"), S, "idx", ["y"], block=block)
    change = F.when(F.col("prev_y").isNotNull() & (F.col("y") != F.col("prev_y")), 1).otherwise(0)
    numbered = running(near, S, "idx", {"run": ("sum", change)}, block=block)
    return numbered.groupBy("series", "run").agg(F.first("y").alias("y"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def local_maxima(p: DataFrame, block: int = BLOCK) -> DataFrame:
    """Runs strictly above both neighbours, at the middle index; the ends never count."""
    near = neighbors(runs(p, block), S, "run", ["y"], block=block)
    is_peak = (F.col("y") > F.col("prev_y")) & (F.col("y") > F.col("next_y"))
    return near.where(is_peak).select("series", F.floor((F.col("first") + F.col("last")) / 2).cast("bigint").alias("idx"), "y")


# ------------------------------------------------------- first point beyond a height
_QUERY = "series string, idx bigint, side int, h double, low double, low_idx bigint, pos bigint, at bigint"


def _reach(top: np.ndarray, low: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the first place from there on with top > h (the length if none), and the place of
    the least `low` passed on the way (-1 if none), of equal ones the first.

    Places are passed in steps of falling powers of two, over which largest and least are known."""
    n = len(top)
    tops, lows = [top], [np.arange(n)]
    while 2 << (len(tops) - 1) <= n:
        half, t, a = 1 << (len(tops) - 1), tops[-1], lows[-1]
        m = n - 2 * half + 1
        tops.append(np.fmax(t[:m], t[half : half + m]))
        lows.append(np.where(low[a[half : half + m]] < low[a[:m]], a[half : half + m], a[:m]))
    at, least = start.copy(), np.full(len(start), -1)
    for k in range(len(tops) - 1, -1, -1):
        go = np.flatnonzero(at + (1 << k) <= n)
        go = go[~(tops[k][at[go]] > h[go])]
        seen = lows[k][at[go]]
        better = (least[go] < 0) | (low[seen] < low[least[go]])
        least[go[better]] = seen[better]
        at[go] += 1 << k
    return at, least


def _scan(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Queries of one group of nodes: `at` becomes the first node beyond `pos` on the query's side (a NULL
    `pos` stands before the whole group) that holds a value above `h`, else NULL."""
    nodes = nodes.sort_values("n")
    n, top, low = nodes["n"].to_numpy(), nodes["top"].to_numpy(float), nodes["low"].to_numpy(float)
    at = np.full(len(queries), -1, np.int64)
    lows, places = queries["low"].to_numpy(float).copy(), queries["low_idx"].to_numpy(np.int64).copy()
    pos, sides, h = queries["pos"].to_numpy(float), queries["side"].to_numpy(), queries["h"].to_numpy(float)
    for side, name, turn in ((1, "low_first", slice(None)), (-1, "low_last", slice(None, None, -1))):
        mine = np.flatnonzero((sides > 0) == (side > 0))
        if not len(mine):
            continue
        order, where = n[turn] * side, nodes[name].to_numpy(np.int64)[turn]
        start = np.where(np.isnan(pos[mine]), 0, np.searchsorted(order, pos[mine] * side, side="right")).astype(np.int64)
        found, least = _reach(top[turn], low[turn], start, h[mine])
        hit = found < len(n)
        at[mine[hit]] = n[turn][found[hit]]
        better = (least >= 0) & (low[turn][least] < lows[mine])
        lows[mine[better]], places[mine[better]] = low[turn][least[better]], where[least[better]]
    found = pd.Series(at, index=queries.index, dtype="Int64").mask(at < 0)
    return queries.assign(low=lows, low_idx=places, pos=queries["pos"].astype("Int64"), at=found)[[f.split()[0] for f in _QUERY.split(", ")]]


def _ask(queries: DataFrame, group: Column, nodes: DataFrame, block: int) -> DataFrame:
    """Each query in its group of `block` nodes. Very many queries may aim at one group: they are dealt
    into shares, and the group is copied for each share."""
    keys = ["series", "g"]
    asked = queries.withColumn("g", group)
    shares = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_TASK).cast("int").alias("shares"))
    asked = asked.join(shares, keys).withColumn("part", F.pmod(F.xxhash64("idx", "side", "h"), F.col("shares")).cast("int")).drop("shares")
    split = shares.select(*keys, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("part"))
    copies = nodes.withColumn("g", F.floor(F.col("n") / block).cast("bigint")).join(split, keys)
    # renamed: both sides of the co-group may come from the same table
    copies = copies.select(F.col("series").alias("s"), F.col("g").alias("b"), F.col("part").alias("r"), "n", "top", "low", "low_first", "low_last")
    return shipped(asked).groupBy(*keys, "part").cogroup(copies.groupBy("s", "b", "r")).applyInPandas(_scan, _QUERY)


def _extremes(nodes: DataFrame, block: int) -> DataFrame:
    """The level above: per group of nodes the maximum, the minimum, and its positions from either end."""
    return nodes.groupBy("series", F.floor(F.col("n") / block).cast("bigint").alias("n")).agg(
        F.max("top").alias("top"),
        F.min("low").alias("low"),
        F.min(F.struct(F.col("low").alias("k"), F.col("low_first").alias("i")))["i"].alias("low_first"),
        F.max(F.struct((-F.col("low")).alias("k"), F.col("low_last").alias("i")))["i"].alias("low_last"),
    )


def first_beyond(curve: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """For queries (series, idx, side, h): nearest position on that side with y > h (`hit`,
    NULL when the curve ends first) and the lowest value passed on the way (`low`, `low_idx`).

    Levels of block extremes over the curve form a tree of fan `block`. A query climbs until the rest of
    its group holds a higher value, then descends to it; every move is a join with one level. A curve of
    up to `block` points has one level.
    """
    nodes = curve.select("series", F.col("idx").alias("n"), F.col("y").alias("top"), F.col("y").alias("low"), F.col("idx").alias("low_first"), F.col("idx").alias("low_last"))
    levels, size = [nodes], (curve.agg(F.max("idx")).first()[0] or 0) + 1
    while size > block:
        size = -(-size // block)
        levels.append(materialize(_extremes(levels[-1], block)))
    up = F.floor(F.col("pos") / block).cast("bigint")
    moving = queries.select(
        "series", "idx", "side", "h", F.lit(float("inf")).alias("low"), F.col("idx").alias("low_idx"), F.col("idx").alias("pos"), F.lit(None).cast("bigint").alias("at"),
    )
    found: list[DataFrame] = []  # by level: queries that know the node to look into
    for level in levels:
        got = _ask(moving, up, level, block)
        if len(levels) == 1:
            return got.select("series", "idx", "side", "h", "low", "low_idx", F.col("at").alias("hit"))
        got = materialize(got)
        found.append(got.where(F.col("at").isNotNull()))
        moving = got.where(F.col("at").isNull()).withColumn("pos", up)
    down = found.pop()
    for level in levels[-2::-1]:
        inside = _ask(down.withColumn("pos", F.lit(None).cast("bigint")), F.col("at"), level, block)
        down = found.pop().unionByName(materialize(inside))
    return down.unionByName(moving).select("series", "idx", "side", "h", "low", "low_idx", F.col("at").alias("hit"))


def both_sides(df: DataFrame, h: Column) -> DataFrame:
    return df.select("series", "idx", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), h.alias("h"))


def prominences(p: DataFrame, peaks: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Peaks with prominence and the bases: height above the higher of the two side minima."""
    peaks = local_maxima(p, block) if peaks is None else peaks
    side = first_beyond(p, both_sides(peaks, F.col("y")), block)
    left, right = F.col("side") == -1, F.col("side") == 1
    return side.groupBy("series", "idx").agg(
        F.max("h").alias("y"),
        F.max(F.when(left, F.col("low"))).alias("left_low"),
        F.max(F.when(right, F.col("low"))).alias("right_low"),
        F.max(F.when(left, F.col("low_idx"))).alias("left_base"),
        F.max(F.when(right, F.col("low_idx"))).alias("right_base"),
    ).withColumn("prominence", F.col("y") - F.greatest("left_low", "right_low"))


# -------------------------------------------------------------- distance pruning
def spaced(peaks: DataFrame, distance: int) -> DataFrame:
    """Keep the highest peaks first, dropping any peak closer than `distance` to a kept one.

    For distances up to 4 only adjacent peaks can conflict (peaks lie at least 2 apart), so
    conflicts form chains. Going down from a chain's summits every second peak survives, and a
    valley between two descents survives when neither neighbour does: running maxima instead
    of a height-ordered loop. Equal heights: the later peak goes first.
    """
    if distance <= 2:
        return peaks
    if distance > 4:
        raise ValueError("adjacent-only pruning holds for distances up to 4 windows")
    ranked = rank_rows(peaks, ["idx"], S, "_k")
    near = neighbors(ranked, S, "_k", ["idx", "y"])
    left_close = F.coalesce(F.col("idx") - F.col("prev_idx") < distance, F.lit(False))
    right_close = F.coalesce(F.col("next_idx") - F.col("idx") < distance, F.lit(False))
    up_left = left_close & (F.col("prev_y") > F.col("y"))
    up_right = right_close & (F.col("next_y") >= F.col("y"))
    marked = near.withColumn("_ul", up_left).withColumn("_ur", up_right).withColumn("_top", ~up_left & ~up_right)
    below = running(marked, S, "_k", {"_tl": ("max", F.when(F.col("_top"), F.col("_k")))})
    both = running(below, S, "_k", {"_tr": ("min", F.when(F.col("_top"), F.col("_k")))}, reverse=True)
    slope = F.when(F.col("_top"), True).when(F.col("_ul") & F.col("_ur"), None).when(F.col("_ul"), (F.col("_k") - F.col("_tl")) % 2 == 0).otherwise((F.col("_tr") - F.col("_k")) % 2 == 0)
    kept = neighbors(both.withColumn("_keep", slope), S, "_k", ["_keep"])
    valley = ~F.coalesce(F.col("prev__keep"), F.lit(False)) & ~F.coalesce(F.col("next__keep"), F.lit(False))
    return kept.where(F.coalesce(F.col("_keep"), valley)).select(*peaks.columns)


def found_peaks(p: DataFrame, distance: int = 1, block: int = BLOCK) -> DataFrame:
    """Peaks at least `distance` apart with prominence and bases."""
    return prominences(p, spaced(local_maxima(p, block), distance), block)


# ----------------------------------------------------------------- whole curves
def _spaced_places(at: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which peaks of one curve `spaced` keeps, by the same rule."""
    k = np.arange(len(at))
    close = np.diff(at) < distance
    up_left = np.concatenate(([False], close & (y[:-1] > y[1:])))
    up_right = np.concatenate((close & (y[1:] >= y[:-1]), [False]))
    top = ~up_left & ~up_right
    top_left = np.maximum.accumulate(np.where(top, k, -1))
    top_right = np.minimum.accumulate(np.where(top, k, len(k))[::-1])[::-1]
    kept = top | (up_left & ~up_right & ((k - top_left) % 2 == 0)) | (up_right & ~up_left & ((top_right - k) % 2 == 0))
    beside = np.concatenate(([False], kept[:-1])) | np.concatenate((kept[1:], [False]))
    return kept | (up_left & up_right & ~beside)


_FOUND = {
    "idx": "bigint", "x": "double", "y": "double", "prominence": "double", "left_base": "bigint", "right_base": "bigint",
    "n_points": "bigint", "x_min": "double", "x_max": "double", "y_min": "double", "y_max": "double", "top_idx": "bigint", "median_spacing": "double",
}


def _whole_peaks(p: DataFrame, distance: int, columns: list[str]) -> DataFrame:
    """`found_peaks` of complete curves with their positions and what `extent` and `spacing` tell about the
    curve, a task a curve: (series, columns...). Memory: 16 bytes a point and power of two in its length."""

    def find(key, table):
        rows = table.sort_by("idx")
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        n = len(y)
        first = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
        last, h = np.concatenate((first[1:] - 1, [n - 1])), y[first]
        is_peak = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])) + 1
        at, h = (first[is_peak] + last[is_peak]) // 2, h[is_peak]
        if distance > 2:
            kept = _spaced_places(at, h, distance)
            at, h = at[kept], h[kept]
        # both neighbours of a peak's run are lower, so there is a base on either side
        right = _reach(y, y, at + 1, h)[1]
        left = n - 1 - _reach(y[::-1], y[::-1], n - at, h)[1]
        out = {"idx": at, "x": x[at], "y": h, "prominence": h - np.maximum(y[left], y[right]), "left_base": left, "right_base": right}
        alike = {"n_points": n, "x_min": x.min(), "x_max": x.max(), "y_min": y.min(), "y_max": y.max(), "top_idx": int(y.argmax())}
        if "median_spacing" in columns and len(at):
            alike["median_spacing"] = np.median(np.diff(x))
        out.update({c: np.full(len(at), v) for c, v in alike.items()})
        series = pa.repeat(pa.scalar(key[0].as_py(), pa.string()), len(at))
        empty = np.empty(0)
        return pa.table({"series": series, **{c: pa.array(out.get(c, empty)).cast(_ARROW[_FOUND[c]]) for c in columns}})

    if distance > 4:
        raise ValueError("adjacent-only pruning holds for distances up to 4 windows")
    schema = "series string, " + ", ".join(f"{c} {_FOUND[c]}" for c in columns)
    return shipped(p.select("series", "idx", F.col("x").cast("double"), F.col("y").cast("double"))).groupBy("series").applyInArrow(find, schema)


_ARROW = {"bigint": pa.int64(), "double": pa.float64()}


# ------------------------------------------------------------ the two peak tables
def discovery_peaks(p: DataFrame, min_share: float = RELATIVE_PROMINENCE, distance: int = MIN_DISTANCE, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """Peaks kept at least `distance` apart, then at least `min_share` of the range prominent."""
    if complete(p, S, whole):
        found = _whole_peaks(p, distance, ["idx", "x", "y", "prominence", "y_min", "y_max"]).withColumn("range", F.col("y_max") - F.col("y_min"))
        return materialize(found.where((F.col("range") > 0) & (F.col("prominence") >= min_share * F.col("range"))).select(
            "series", "idx", "x", "y", "prominence", (F.col("prominence") / F.col("range")).alias("relative_prominence")
        ))
    ext = extent(p).select("series", (F.col("y_max") - F.col("y_min")).alias("range")).where("range > 0")
    # distance pruning acts on all local maxima; prominence is then judged on the survivors
    found = found_peaks(p, distance, block).join(ext, S).where(F.col("prominence") >= min_share * F.col("range"))
    return materialize(found.join(p.select("series", "idx", "x"), ["series", "idx"]).select(
        "series", "idx", "x", "y", "prominence", (F.col("prominence") / F.col("range")).alias("relative_prominence")
    ))


def validation_peaks(p: DataFrame, block: int = BLOCK, whole: int = WHOLE, stored: bool = True) -> DataFrame:
    """Every local maximum with prominence, bases, material and edge flags, written once unless a
    single reader says `stored` = False."""
    if complete(p, S, whole):
        found = _whole_peaks(p, 1, list(_FOUND))
    else:
        ext = extent(p).join(spacing(p), S)
        found = found_peaks(p, 1, block).join(ext.drop("y_mean"), S).join(p.select("series", "idx", "x"), ["series", "idx"])
    rng = F.col("y_max") - F.col("y_min")
    threshold = F.greatest(F.lit(PROMINENCE_FLOOR), F.lit(PROMINENCE_SHARE) * rng)
    by_point = (F.col("idx") < EDGE_POINTS) | (F.col("idx") >= F.col("n_points") - EDGE_POINTS)
    by_position = F.least(F.col("x") - F.col("x_min"), F.col("x_max") - F.col("x")) <= EDGE_SPACINGS * F.col("median_spacing")
    out = found.select(
        "series", "idx", "x", "y", "prominence", "left_base", "right_base",
        F.when(rng > 0, F.col("prominence") / rng).alias("prominence_share"),
        (F.col("prominence") >= threshold).alias("material"),
        by_point.alias("point_edge"),
        by_position.alias("position_edge"),
        (by_point | by_position).alias("edge"),
        (F.col("idx") == F.col("top_idx")).alias("is_global_max"),
    )
    return materialize(out) if stored else out


def half_height(p: DataFrame, peaks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Interpolated positions where each peak has lost half its prominence, and the width.

    The nearest point below the half height is the nearest one above it on the negated curve.
    """
    level = F.col("y") - F.col("prominence") / 2
    drops = first_beyond(p.select("series", "idx", (-F.col("y")).alias("y")), both_sides(peaks, -level), block)
    ends = drops.groupBy("series", "idx").agg(
        (-F.max("h")).alias("level"),
        F.max(F.when(F.col("side") == -1, F.col("hit"))).alias("li"),
        F.max(F.when(F.col("side") == 1, F.col("hit"))).alias("ri"),
    )
    pair = neighbors(p.select("series", "idx", "x", "y"), S, "idx", ["x", "y"], block=block)
    lft = pair.select("series", F.col("idx").alias("li"), F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col("next_x").alias("_lx2"), F.col("next_y").alias("_ly2"))
    rgt = pair.select("series", F.col("idx").alias("ri"), F.col("x").alias("_rx"), F.col("y").alias("_ry"), F.col("prev_x").alias("_rx2"), F.col("prev_y").alias("_ry2"))
    full = ends.join(lft, ["series", "li"]).join(rgt, ["series", "ri"])
    tl = (F.col("level") - F.col("_ly")) / (F.col("_ly2") - F.col("_ly"))
    tr = (F.col("level") - F.col("_ry")) / (F.col("_ry2") - F.col("_ry"))
    lx = F.col("_lx") + tl * (F.col("_lx2") - F.col("_lx"))
    rx = F.col("_rx") + tr * (F.col("_rx2") - F.col("_rx"))
    return full.select("series", "idx", lx.alias("left_x"), rx.alias("right_x"), (rx - lx).alias("half_width"))


# --------------------------------------------------------------------- families
def _pieces(peaks: DataFrame, by: str, gap: Column) -> DataFrame:
    """Peaks ranked by position within `by` (_k), cut where neighbours lie more than `gap` apart: no
    family reaches across such a gap, so the pieces (_piece, the rank of their first peak) are independent."""
    ranked = rank_rows(peaks.withColumn("_tie", F.concat_ws("|", "series", "idx")), ["x", "_tie"], [by], "_k")
    near = neighbors(ranked, [by], "_k", ["x"])
    opens = F.col("prev_x").isNull() | (F.col("x") - F.col("prev_x") > gap)
    return running(near.withColumn("_opens", opens).drop("prev_x", "next_x"), [by], "_k", {"_piece": ("max", F.when(F.col("_opens"), F.col("_k")))}).drop("_opens", "_tie")


def _numbered(heads: DataFrame, by: str, base: int) -> DataFrame:
    """family_id from the flag _head (a family's first peak): families counted along the positions."""
    return materialize(running(heads, [by], "_k", {"family_id": ("sum", F.col("_head").cast("bigint"))}).withColumn("family_id", F.col("family_id") + (base - 1)).drop("_k", "_piece", "_head"))


def _by_piece(pieces: DataFrame, by: str, heads) -> DataFrame:
    """Add _head to every peak, from `heads`: (rows of one piece in order) -> family of each row. A
    family's first row is its head; each piece is one short group."""

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        family = heads(pdf)
        return pdf.assign(_head=np.concatenate(([True], family[1:] != family[:-1])))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _head boolean"
    return shipped(pieces).groupBy(by, "_piece").applyInPandas(mark, schema)


def greedy_families(peaks: DataFrame, tolerance: float = DISCOVERY_TOLERANCE) -> DataFrame:
    """Add family_id (from 0) per modality: in position order, a peak joins the latest family while it
    is within `tolerance` of that family's running median, else it opens the next family.

    Sorted positions make the latest family the nearest one, and its median the element half way.
    """

    def heads(pdf: pd.DataFrame) -> np.ndarray:
        x, start, family = pdf["x"].to_numpy(float), 0, np.zeros(len(pdf), np.int64)
        for j in range(1, len(x)):
            median = (x[(start + j - 1) // 2] + x[(start + j) // 2]) / 2
            if x[j] - median > tolerance:
                start = j
            family[j] = start
        return family

    return _numbered(_by_piece(_pieces(peaks, "modality", F.lit(float(tolerance))), "modality", heads), "modality", 0)


def linked_rounds(x: np.ndarray, tol: np.ndarray) -> np.ndarray:
    """Complete linkage of sorted positions: the index of each one's first cluster member.

    On a line the closest cluster is an adjacent one, at a distance of the width of the union. Clusters
    that are each other's closest (ties to the left) merge at the same time without changing the tree;
    rounds repeat until none merge. A cluster keeps the tolerance of its first member.
    """
    first, lo, hi, tol = np.arange(len(x)), x.astype(float), x.astype(float), tol.astype(float)
    while len(first) > 1:
        width = hi[1:] - lo[:-1]
        left, right = np.concatenate(([np.inf], width)), np.concatenate((width, [np.inf]))
        aim = np.where((left <= right) & (left <= tol), -1, np.where((right < left) & (right <= tol), 1, 0))
        grows = np.concatenate(((aim[:-1] == 1) & (aim[1:] == -1), [False]))
        if not grows.any():
            break
        hi = np.where(grows, np.concatenate((hi[1:], [np.inf])), hi)
        keep = ~np.concatenate(([False], grows[:-1]))
        first, lo, hi, tol = first[keep], lo[keep], hi[keep], tol[keep]
    return first[np.searchsorted(first, np.arange(len(x)), side="right") - 1]


def complete_linkage(peaks: DataFrame, tolerance: float | Column, by: str = "modality") -> DataFrame:
    """Add family_id (1-based, by position): complete linkage on positions, cut at `tolerance`, which may
    differ by row."""
    rows = peaks.withColumn("_tol", tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance)))
    widest = same_keys(rows, rows.groupBy(by).agg(F.max("_tol").alias("_gap")), [by])
    pieces = _pieces(widest, by, F.col("_gap")).drop("_gap")
    return _numbered(_by_piece(pieces, by, lambda pdf: linked_rounds(pdf["x"].to_numpy(float), pdf["_tol"].to_numpy(float))).drop("_tol"), by, 1)


def discovery_family_table(members: DataFrame, n_designs: int = 3, max_spread: float = DISCOVERY_MAX_SPREAD) -> DataFrame:
    keys = ["modality", "family_id"]
    base = members.groupBy(*keys).agg(
        F.count_distinct("window_config").alias("n_designs"), (F.max("x") - F.min("x")).alias("spread")
    )
    q = quantiles(members, keys, "x", {"center": 0.5}).join(quantiles(members, keys, "relative_prominence", {"median_prominence": 0.5}), keys)
    robust = (F.col("n_designs") == n_designs) & (F.col("spread") <= max_spread) & (F.col("median_prominence") >= RELATIVE_PROMINENCE)
    return base.join(q, keys).withColumn("robust", robust)


def validation_family_table(
    members: DataFrame, primary: str, n_designs: int = 3, min_designs: int = 2, region: tuple[float, float, float] | None = None
) -> DataFrame:
    """Support, extent and flags per family; `region` = (q25, median, q75) of the landmark label."""
    keys = ["modality", "family_id"]
    interior = ~F.col("edge")
    base = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
        (F.max("x") - F.min("x")).alias("span"),
        F.count_distinct("window_config").alias("n_designs"),
        F.concat_ws(",", F.array_sort(F.collect_set("window_config"))).alias("window_configs"),
        F.bool_or(F.col("window_config") == primary).alias("has_primary"),
        F.count_distinct(F.when(interior, F.col("window_config"))).alias("n_interior_designs"),
        F.max("prominence").alias("max_prominence"),
        F.avg(F.col("edge").cast("int")).alias("edge_fraction"),
    )
    q = quantiles(members, keys, "x", {"center": 0.5})
    for c, o in (("prominence", "median_prominence"), ("y", "median_height"), ("prominence_share", "median_prominence_share")):
        q = q.join(quantiles(members, keys, c, {o: 0.5}), keys)
    robust = (F.col("n_designs") >= min_designs) & F.col("has_primary")
    out = base.join(q, keys).withColumn("robust", robust).withColumn(
        "robust_interior", robust & (F.col("n_interior_designs") >= min_designs)
    ).withColumn("all_designs", F.col("n_designs") == n_designs)
    if region is not None:
        q25, median, q75 = region
        out = out.withColumn("inside_region", F.col("center").between(q25, q75)).withColumn("distance_to_landmark", F.col("center") - median)
    return out


def unique_peaks(peaks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in `order`, by a map-side minimum instead of a sort."""
    rest = [c for c in peaks.columns if c not in keys and c not in order]
    best = peaks.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in (*order, *rest)]).select(*peaks.columns)


# ---------------------------------------------------------------- event pairs
def select_family(families: DataFrame) -> DataFrame:
    """One family per modality: all designs if possible, then nearest the landmark, then more
    designs, more prominence, earlier centre."""
    key = F.struct(
        (~F.col("all_designs")).alias("k0"), F.abs("distance_to_landmark").alias("k1"), (-F.col("n_designs")).alias("k2"),
        (-F.col("median_prominence")).alias("k3"), F.col("center").alias("k4"),
    )
    eligible = families.where("robust_interior and inside_region")
    cols = [c for c in families.columns if c != "modality"]
    return eligible.groupBy("modality").agg(F.min_by(F.struct(*cols), key).alias("_s")).select("modality", "_s.*")


def assign_transition(families: DataFrame, transitions: DataFrame) -> DataFrame:
    """Families whose centre lies in exactly one transition interval, with that interval.

    Transitions are consecutive label pairs: a handful of rows, checked before broadcasting.
    """
    if transitions.limit(1001).count() > 1000:
        raise ValueError("transitions must be a short list of label pairs")
    hit = families.join(F.broadcast(transitions), F.col("center").between(F.col("lower"), F.col("upper")))
    keys = ["modality", "family_id"]
    once = hit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    return hit.join(once, keys)


def upstream_family(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each assigned family of A the latest robust family of B in [upstream limit, centre).

    Robust families per modality cover disjoint stretches of the clock, so both sides are short.
    """
    if b.where("robust").limit(10_001).count() > 10_000:
        raise ValueError("more robust families than a clock can hold; check the tolerance")
    rb = b.where("robust").select(F.col("family_id").alias("b_family_id"), F.col("center").alias("b_center"))
    cand = a.where("robust").join(F.broadcast(rb), (F.col("b_center") >= F.col("upstream_limit")) & (F.col("b_center") < F.col("center")))
    return cand.groupBy(F.col("family_id").alias("a_family_id"), F.col("center").alias("a_center"), "transition").agg(
        F.max_by("b_family_id", "b_center").alias("b_family_id"), F.max("b_center").alias("b_center"), F.count(F.lit(1)).alias("n_candidates")
    )


def design_pairs(pair: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """Both peaks of a frozen pair side by side per window design, with the lag a - b."""
    left = members.where(F.col("modality") == a).select(F.col("family_id").alias("a_family_id"), "window_config", F.col("x").alias("a_x"))
    right = members.where(F.col("modality") == b).select(F.col("family_id").alias("b_family_id"), "window_config", F.col("x").alias("b_x"))
    return pair.select("a_family_id", "b_family_id").join(left, "a_family_id").join(right, ["b_family_id", "window_config"]).select(
        "a_family_id", "b_family_id", "window_config", "a_x", "b_x", (F.col("a_x") - F.col("b_x")).alias("lag"), (F.col("b_x") < F.col("a_x")).alias("b_first")
    )


def directional_consistency(pairs: DataFrame, n_designs: int = 3) -> DataFrame:
    return pairs.groupBy("a_family_id", "b_family_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.min("lag").alias("lag_min"), F.max("lag").alias("lag_max"),
        (F.bool_and("b_first") & (F.count(F.lit(1)) == n_designs)).alias("consistent"),
    )


def track(peaks: DataFrame, centers: dict[str, float], tolerance: float, need: Column | None = None) -> DataFrame:
    """The peak of each series nearest its modality's frozen centre, within tolerance.

    Ties: more prominent, then earlier. Series without one keep a row with detected = false.
    """
    center = F.create_map(*[v for m, c in centers.items() for v in (F.lit(m), F.lit(float(c)))])[F.col("modality")]
    off = F.abs(F.col("x") - center)
    good = (off <= tolerance) if need is None else (off <= tolerance) & need
    rows = peaks.withColumn("_off", off).withColumn("_ok", good)
    best = F.min(F.when(F.col("_ok"), F.struct(F.col("_off").alias("d"), (-F.col("prominence")).alias("p"), F.col("x").alias("x"))))
    out = rows.groupBy("series", "modality").agg(F.count_if(F.col("_ok")).alias("n_eligible"), best.alias("_b"))
    return out.select(
        "series", "modality", "n_eligible", F.col("_b").isNotNull().alias("detected"), F.col("_b.x").alias("peak_x"),
        (-F.col("_b.p")).alias("peak_prominence"), F.col("_b.d").alias("distance_to_center"),
    )


def stability(p: DataFrame, peaks: DataFrame, centers: dict[str, float], tolerance: float, plateau: float = 0.9) -> DataFrame:
    """How a curve behaves around a frozen centre: local range, roughness, plateau width, peaks."""
    center = F.create_map(*[v for m, c in centers.items() for v in (F.lit(m), F.lit(float(c)))])[F.col("modality")]
    near = neighbors(p.where(F.abs(F.col("x") - center) <= tolerance), S, "idx", ["y"])
    local = near.groupBy("series", "modality").agg(
        F.count(F.lit(1)).alias("_n"), (F.max("y") - F.min("y")).alias("local_range"), F.avg(F.abs(F.col("y") - F.col("prev_y"))).alias("roughness"), F.max("y").alias("_top")
    ).where("_n >= 2")
    flat = near.join(local.select("series", "_top"), "series").where(F.col("y") >= plateau * F.col("_top"))
    width = flat.groupBy("series").agg((F.max("x") - F.min("x")).alias("plateau_width"))
    strongest = peaks.groupBy("series").agg(
        F.count(F.lit(1)).alias("n_peaks"), F.max_by("x", F.struct("y", -F.col("idx"))).alias("strongest_x")
    )
    base = p.select("series", "modality").distinct().withColumn("_center", center)
    out = base.join(track(peaks, centers, tolerance).drop("modality", "peak_prominence"), "series", "left")
    out = out.join(local.drop("modality", "_n", "_top"), "series", "left").join(width, "series", "left").join(strongest, "series", "left")
    return out.select(
        "series", "modality", F.coalesce("detected", F.lit(False)).alias("detected"), F.coalesce("n_eligible", F.lit(0)).alias("n_eligible"),
        F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), "peak_x", "strongest_x", F.abs(F.col("strongest_x") - F.col("_center")).alias("strongest_distance"),
        "local_range", "roughness", "plateau_width",
    )
