"""Paired bootstraps, block permutations and circular shifts, with hash randomness.

Every draw is a function of (seed, replicate, attempt, slot), so a lost executor redraws the
same rows and a SQL engine can reproduce them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import Hash60
from ..functions.scalars import hash60
from ..session import materialize, shipped
from .ordered import contiguous_strata, fixed_strata, not_increasing, rank_rows, running
from .profiles import _crossing, area_quantiles, complete, interpolate, js_divergence, segments
from .stats import spearman
from .windows import Design

# Seeds, replicate counts, strata and block sizes of the two branches.
DISCOVERY_SEED = 20260920
VALIDATION_SEED = 785
STRATUM_SIZE = 100
N_STRATA = 20
NULL_BLOCK = 100
MAX_ATTEMPTS = 25
GRID_POINTS = 500
ALIGNED = ("q50_a", "q50_b", "signed_gap", "absolute_gap", "spearman_rho", "js_divergence")
TILE = 16_384  # ranks in a task's share of short strata
STRETCH = 4_096  # places of a curve that are sent together
CELLS = 240  # least number of shares of a resampling, where there are as many replicates


def strata(ranked: DataFrame, n: int, size: int | None = None, parts: int | None = None, rk: str = "rk") -> DataFrame:
    """Add stratum, its first rank and its size: chunks of `size`, or `parts` near-equal ones."""
    k = F.col(rk)
    if size is not None:
        s = fixed_strata(k, size)
        first = (s * size).cast("bigint")
        count = F.least(F.lit(size), F.lit(n) - first)
    else:
        s = contiguous_strata(k, n, parts)
        base, extra = divmod(n, parts)
        first = (s * base + F.least(s, F.lit(extra))).cast("bigint")
        count = F.lit(base) + (s < extra).cast("int")
    return ranked.withColumn("stratum", s).withColumn("s_first", first).withColumn("s_size", count.cast("bigint"))


def bootstrap(
    stratified: DataFrame, values: Sequence[str], replicates: int | Sequence[int], seed: int, n: int, rk: str = "rk", attempt: int = 0
) -> DataFrame:
    """Draw with replacement inside strata and keep the drawn entities in rank order.

    Both modalities travel on the drawn row, so every replicate stays paired. Returns
    (replicate, pos, values...): `pos` is the place in the replicate's order. Repeated draws
    collapse to a multiplicity before the join, and positions come from cumulative counts.
    `n` is the number of entities.
    """
    reps = F.sequence(F.lit(0), F.lit(replicates - 1)) if isinstance(replicates, int) else F.array(*[F.lit(r) for r in replicates])
    slots = stratified.select(F.explode(reps).alias("replicate"), rk, "s_first", "s_size")
    drawn = F.col("s_first") + F.pmod(hash60(seed, F.col("replicate"), attempt, F.col(rk)), F.col("s_size"))
    times = slots.select("replicate", drawn.alias(rk)).groupBy("replicate", rk).agg(F.count(F.lit(1)).alias("m"))
    placed = running(times, ["replicate"], rk, {"_end": ("sum", F.col("m"))}).join(stratified.select(rk, *values), rk)
    copies = F.explode(F.sequence(F.col("_end") - F.col("m"), F.col("_end") - 1))
    return placed.select("replicate", copies.alias("pos"), *values)


def _numbers(replicates: int | Sequence[int]) -> list[int]:
    return list(range(replicates)) if isinstance(replicates, int) else list(replicates)


def _resampled(
    stratified: DataFrame, values: Sequence[str], replicates: Sequence[int], seed: int, attempt: int, rk: str,
    summary: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str,
) -> DataFrame:
    """Summaries of the draws of `bootstrap`, made where the draws are, so that only the entities are shuffled.

    A stratum is drawn from as often as it has rows, so its draws hold the positions of its ranks in every
    replicate. Tiles of whole neighbouring strata therefore need nothing from each other; a tile's replicates
    are dealt into shares where tiles are few. `summary` gets the drawn rows of one replicate: their places
    in the tile's columns, their positions, and the columns as double arrays (NULL as NaN in `name`, and
    whether it is there in `name?`). Memory: the values of a tile, the longer of TILE ranks and a stratum.
    """
    tiled = materialize(stratified.select(
        F.floor(F.col("s_first") / TILE).alias("tile"), F.col(rk).alias("rk"), "s_first", "s_size", *[F.col(v).cast("double").alias(v) for v in values]
    ))
    shares = min(len(replicates), -(-CELLS // max(1, tiled.select("tile").distinct().count())))

    def draw(key, table):
        rows = table.sort_by("rk")
        mine = replicates[key[1].as_py() :: shares]
        first = rows["s_first"].to_numpy()
        start, size = int(first[0]), rows["s_size"].to_numpy()
        columns = {}
        for v in values:
            columns[v] = rows[v].to_numpy()
            columns[v + "?"] = rows[v].is_valid().to_numpy()
        columns["tile"] = np.full(rows.num_rows, key[0].as_py())
        numbers, own, places = Hash60(start, start + rows.num_rows), first - start, np.arange(rows.num_rows)
        # a remainder by one number is much faster than by an array of equal ones
        sizes = [(lo, int(size[lo])) for lo in np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1])))]
        parts = []
        for r in mine:
            h = numbers(seed, r, attempt)
            for (lo, z), hi in zip(sizes, [*[lo for lo, _ in sizes[1:]], rows.num_rows]):
                np.remainder(h[lo:hi], z, out=h[lo:hi])
            drawn = np.repeat(places, np.bincount(h + own, minlength=rows.num_rows))
            got = summary(drawn, places + start, columns)
            parts.append({"replicate": np.full(len(next(iter(got.values()))), r, np.int32), **got})
        return pa.table({c: pa.concat_arrays([p[c] if isinstance(p[c], pa.Array) else pa.array(p[c]) for p in parts]) for c in parts[0]})

    cells = tiled.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(CELLS, "tile", "share")
    return shipped(cells).groupBy("tile", "share").applyInArrow(draw, "replicate int, " + schema)


def _missing(x: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(x, mask=~there)


def _window_parts(d: Design, n: int, key: str, sums: Sequence[str]) -> Callable:
    """Summary for `_resampled`: per window what the tile's positions give to its totals, and the key at its
    two middle positions where they lie in the tile."""
    pane, count = math.gcd(d.size, d.step), d.count(n)
    wide, turn = d.size // pane, d.step // pane

    def parts(drawn: np.ndarray, at: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        start, stop = int(at[0]), int(at[-1]) + 1
        lo, hi = start // pane, (stop - 1) // pane
        w = np.arange(max(0, -(-(lo - wide + 1) // turn)), min(count - 1, hi // turn) + 1)
        edges = np.maximum(np.arange(lo, hi + 1) * pane - start, 0)
        # panes of the tile between empty ones, so that every window finds all of its panes
        pad = np.zeros(wide)
        spread = lambda v: np.concatenate((pad, np.add.reduceat(v, edges), pad))
        total = lambda p: sum((p[w * turn - lo + wide + j] for j in range(wide)), np.zeros(len(w)))
        out = {"idx": w}
        for c in sums:
            there = columns[c + "?"]
            if there.all():
                out[c] = pa.array(total(spread(columns[c][drawn])))
            else:
                seen = there[drawn]
                out[c] = _missing(total(spread(np.where(seen, columns[c][drawn], 0.0))), total(spread(seen.astype(float))) > 0)
        for name, place in (("k_lo", (d.size - 1) // 2), ("k_hi", d.size // 2)):
            p = w * d.step + place - start
            inside = (p >= 0) & (p < stop - start)
            row = drawn[np.where(inside, p, 0)]
            out[name] = _missing(columns[key][row], inside & columns[key + "?"][row])
        return out

    return parts


def replicate_windows(
    stratified: DataFrame, clock: str, modalities: dict[str, str], d: Design, n: int, replicates: int | Sequence[int], seed: int, rk: str = "rk", attempt: int = 0
) -> DataFrame:
    """Window means and median position per replicate, a row a window: (replicate, idx, x, y_<modality>...),
    written once."""
    columns = list(dict.fromkeys(modalities.values()))
    schema = "idx bigint, " + ", ".join(f"`{c}` double" for c in [*columns, "k_lo", "k_hi"])
    parts = _resampled(stratified, [clock, *columns], _numbers(replicates), seed, attempt, rk, _window_parts(d, n, clock, columns), schema)
    whole = parts.groupBy("replicate", "idx").agg(*[F.sum(c).alias(c) for c in columns], F.max("k_lo").alias("k_lo"), F.max("k_hi").alias("k_hi"))
    means = [F.round(F.col(c) / F.lit(d.size), 9).alias(f"y_{m}") for m, c in modalities.items()]
    return materialize(whole.select("replicate", "idx", ((F.col("k_lo") + F.col("k_hi")) / 2).alias("x"), *means))


def replicate_profiles(wide: DataFrame, modalities: Sequence[str], d: Design) -> DataFrame:
    """Curves of `replicate_windows`: (series, replicate, modality, idx, x, y) and its other columns."""
    stacked = F.inline(F.array(*[F.struct(F.lit(m).alias("modality"), F.col(f"y_{m}").alias("y")) for m in modalities]))
    others = [c for c in wide.columns if c not in ("replicate", "idx", "x") and not c.startswith("y_")]
    long = wide.select("replicate", "idx", "x", *others, stacked)
    series = F.concat_ws("|", "modality", F.lit(d.name), F.col("replicate").cast("string"))
    return long.select(series.alias("series"), "replicate", "modality", "idx", "x", "y", *others)


def bootstrap_profiles(
    stratified: DataFrame, clock: str, modalities: dict[str, str], d: Design, n: int, replicates: int, seed: int, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Replicate profiles; a replicate whose window positions tie is redrawn, up to a limit.

    Adds `attempt`. Only replicate numbers pass through the driver.
    """
    todo: list[int] | int = replicates
    kept, attempt = None, 0
    while True:
        wide = replicate_windows(stratified, clock, modalities, d, n, todo, seed, attempt=attempt).withColumn("attempt", F.lit(attempt))
        bad = [r["replicate"] for r in not_increasing(wide, ["replicate"], "idx", "x").where("n_not_increasing > 0").select("replicate").collect()]
        good = wide.where(~F.col("replicate").isin(bad)) if bad else wide
        kept = good if kept is None else kept.unionByName(good)
        attempt += 1
        if not bad:
            return replicate_profiles(kept, list(modalities), d)
        if attempt >= max_attempts:
            raise RuntimeError(f"replicates {bad[:5]} keep tied window positions after {max_attempts} draws")
        todo = bad


def draw_totals(stratified: DataFrame, clock: str, a: str, b: str, replicates: int | Sequence[int], seed: int, rk: str = "rk") -> DataFrame:
    """Per replicate of `bootstrap`: rows, different clock values, the sum of `a` and the mean of `b` weighted
    by position. Ranks follow the clock, so equal clock values are neighbours in a replicate."""

    def totals(drawn: np.ndarray, at: np.ndarray, columns: dict[str, np.ndarray]) -> dict:
        seen = columns[clock + "?"][drawn]
        x = columns[clock][drawn][seen]
        out = {"tile": columns["tile"][:1], "n": [len(drawn)], "n_pos": [int(at.sum())], "n_distinct": [int(len(x) > 0) + int((x[1:] != x[:-1]).sum())]}
        out["k_first"], out["k_last"] = (pa.array([float(x[i]) if len(x) else None for _ in range(1)], pa.float64()) for i in (0, -1))
        for name, c, weight in (("sum_a", a, 1.0), ("sum_b", b, at)):
            there = columns[c + "?"][drawn]
            v = np.where(there, columns[c][drawn], 0.0) * weight
            out[name] = pa.array([float(v.sum()) if there.any() else None], pa.float64())
        return out

    schema = "tile bigint, n bigint, n_pos bigint, n_distinct bigint, k_first double, k_last double, sum_a double, sum_b double"
    got = _resampled(stratified, [clock, a, b], _numbers(replicates), seed, 0, rk, totals, schema)
    w = Window.partitionBy("replicate").orderBy("tile")
    # a value that reaches over tiles counts once; tiles of missing values come first
    again = F.coalesce((F.lag("k_last").over(w) == F.col("k_first")).cast("bigint"), F.lit(0))
    return got.withColumn("again", again).groupBy("replicate").agg(
        F.sum("n").alias("n"), (F.sum("n_distinct") - F.sum("again")).alias("n_distinct"), F.sum("sum_a").alias("sum_a"), (F.sum("sum_b") / F.sum("n_pos")).alias("weighted_b")
    )


def lags(tracked: DataFrame, a: str, b: str, key: str = "replicate") -> DataFrame:
    """Per replicate: both tracked positions, whether both were found, and the lag a - b."""
    is_a, is_b = F.col("modality") == a, F.col("modality") == b
    out = tracked.groupBy(key).agg(
        F.bool_and("detected").alias("paired"),
        F.max(F.when(is_a, F.col("peak_x"))).alias("a_x"),
        F.max(F.when(is_b, F.col("peak_x"))).alias("b_x"),
    )
    lag = F.col("a_x") - F.col("b_x")
    return out.withColumn("lag", lag).withColumn("b_first", lag > 0).withColumn("a_first", lag < 0).withColumn("synchronous", lag == 0)


# ------------------------------------------------------------------------ nulls
def block_permutation(n: int, block: int, replicates: int, seed: int, spark) -> DataFrame:
    """(replicate, block, first, size, start): every block of 0..n-1 and its start in a shuffled
    order. The last block may be shorter and keeps its length."""
    n_blocks = -(-n // block)
    ids = spark.range(n_blocks).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    keyed = ids.withColumn("_h", hash60(seed, F.col("replicate"), F.col("block"))).withColumn(
        "size", F.least(F.lit(block), F.lit(n) - F.col("block") * block)
    )
    order = rank_rows(keyed, ["_h", "block"], ["replicate"], "_o")
    cum = running(order, ["replicate"], "_o", {"_end": ("sum", F.col("size"))}, stored=True)
    return cum.select("replicate", "block", (F.col("block") * block).alias("first"), "size", (F.col("_end") - F.col("size")).alias("start"))


def permute_blocks(rows: DataFrame, idx: str, value: str, n: int, block: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, idx, value): the values in block-shuffled order, each kept exactly once."""
    plan = block_permutation(n, block, replicates, seed, rows.sparkSession)
    src = rows.select(F.col(idx).alias("_i"), F.col(value).alias(value)).withColumn("block", F.floor(F.col("_i") / block).cast("bigint"))
    return src.join(plan, "block").select("replicate", (F.col("start") + F.col("_i") - F.col("first")).alias(idx), value)


def block_pieces(rows: DataFrame, idx: str, value: str, n: int, block: int, d: Design) -> DataFrame:
    """(idx, value): sums over the pieces of a block that no window of `d` ever cuts, wherever the block is
    moved to, each at its first position.

    A moved block starts at a multiple of the block length, or, behind the shorter last block, at one plus
    that block's length; so window edges fall on two grids inside it. A replicate then moves two rows a
    pane instead of the entities, and its windows come from them as from entities."""
    g = math.gcd(d.size, d.step, block)
    inside = F.col(idx) % block
    turn = -(n % block) % g
    piece = F.floor(inside / g) * 2 + (inside % g >= turn).cast("int")
    return rows.groupBy(F.floor(F.col(idx) / block).alias("_b"), piece.alias("_p")).agg(F.min(idx).alias(idx), F.sum(value).alias(value)).drop("_b", "_p")


def moved_windows(
    pieces: DataFrame, idx: str, value: str, n: int, block: int, d: Design, replicates: int, seed: int, x: DataFrame | None = None, grid: np.ndarray | None = None, cells: int = CELLS
) -> DataFrame:
    """(replicate, idx, y): window means of the values of `block_pieces` with the blocks of `block_permutation`
    in their new order; NULL where a window holds no value. With `x`, the windows' positions (idx, x), none of
    them missing, (replicate, g, gy) instead: the curve of the means read at the positions `grid`.

    The replicates are dealt into cells and each cell gets the pieces, so no moved piece is a row of a table:
    the work is replicates times pieces, what is shuffled cells times pieces, and a task holds the pieces of
    one curve (two rows a pane) and its windows.
    """
    pane, count = math.gcd(d.size, d.step), d.count(n)
    wide, turn = d.size // pane, d.step // pane
    cells = max(1, min(cells, replicates))
    names = ("replicate", "idx", "y") if x is None else ("replicate", "g", "gy")

    def measure(number, table, positions=None):
        rows = table.sort_by("at")
        first, there = rows["at"].to_numpy(), rows["v"].is_valid().to_numpy()
        v = rows["v"].to_numpy(zero_copy_only=False)[there]
        own = first // block
        base, size = np.arange(-(-n // block)) * block, np.minimum(block, n - np.arange(-(-n // block)) * block)
        numbers, w = Hash60(0, len(base)), np.arange(count) * turn
        here, nxt, t = segments(positions.sort_by("idx")["x"].to_numpy(), grid) if positions is not None else (None,) * 3
        parts = []
        for r in range(number[0].as_py(), replicates, cells) if len(first) else ():
            order = np.argsort(numbers(seed, r), kind="stable")  # equal numbers: the smaller block
            start = np.empty(len(base), np.int64)
            start[order] = np.cumsum(size[order]) - size[order]
            at = (start[own] + first - base[own])[there] // pane
            panes = -(-n // pane)
            total, seen = np.bincount(at, weights=v, minlength=panes), np.bincount(at, minlength=panes)
            y, some = (sum((p[w + j] for j in range(wide)), np.zeros(count)) for p in (total, seen))
            y = pa.array(y / d.size, mask=some == 0)
            if positions is not None:
                y = y.to_numpy(zero_copy_only=False)
                y = pa.array(y[here] + t * (y[nxt] - y[here]))
            parts.append(pa.table([pa.array(np.full(len(y), r, np.int32)), pa.array(np.arange(len(y))), y], names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], k) for k in (pa.int32(), pa.int64(), pa.float64())], names=names)

    # the numbers of the cells are the short side of these products
    deal = lambda rows, cell: rows.crossJoin(F.broadcast(rows.sparkSession.range(cells).withColumnRenamed("id", cell))).repartition(cells, cell)
    dealt = deal(shipped(pieces).select(F.col(idx).cast("bigint").alias("at"), F.col(value).cast("double").alias("v")), "cell").groupBy("cell")
    schema = f"replicate int, {names[1]} bigint, {names[2]} double"
    if x is None:
        return dealt.applyInArrow(lambda key, rows: measure(key, rows), schema)
    places = deal(x.select("idx", F.col("x").cast("double").alias("x")), "_cell").groupBy("_cell")
    return dealt.cogroup(places).applyInArrow(lambda key, rows, places: measure(key, rows, places), schema)


def admissible_offsets(n: int, span: int) -> tuple[int, int]:
    """First and last shift whose circular distance from no shift is at least `span`."""
    return span, n - span


def circular_shifts(curve: DataFrame, value: str, n: int, span: int) -> DataFrame:
    """(offset, idx, value): the curve rolled by every admissible offset."""
    lo, hi = admissible_offsets(n, span)
    if hi < lo:
        return curve.where(F.lit(False)).select(F.lit(0).alias("offset"), "idx", value)  # too short for any shift
    rolled = curve.select("idx", value, F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("offset"))
    return rolled.select("offset", F.pmod(F.col("idx") + F.col("offset"), F.lit(n)).cast("bigint").alias("idx"), value)


def alignment(pairs: DataFrame, key: str) -> DataFrame:
    """Validation metrics per key from rows (key, idx, x, a, b): mass centres, Spearman, JS."""

    def center(col: str) -> DataFrame:
        rows = pairs.select(F.col(key).cast("string").alias("series"), "idx", "x", F.greatest(F.col(col), F.lit(0.0)).alias("m"))
        total = rows.groupBy("series").agg(F.sum("m").alias("_total"))
        cum = running(rows, ["series"], "idx", {"_c": ("sum", F.col("m"))}).join(total, "series").where("_total > 0")
        return _crossing(cum.withColumn("_c", F.col("_c") / F.col("_total")), {f"q50_{col}": 0.5})

    base = pairs.withColumn("series", F.col(key).cast("string"))
    rho = spearman(base, "a", "b", ["series"], "spearman_rho")
    js = js_divergence(base, ["series"], "a", "b")
    out = center("a").join(center("b"), "series").join(rho, "series").join(js, "series")
    gap = F.col("q50_a") - F.col("q50_b")
    return out.select(
        F.col("series").cast(pairs.schema[key].dataType).alias(key), "q50_a", "q50_b", gap.alias("signed_gap"), F.abs(gap).alias("absolute_gap"),
        "spearman_rho", "js_divergence",
    )


class shift_sources:
    """For a shift: which place of the curve each place takes its value from."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, offset: int) -> np.ndarray:
        return (np.arange(self.n) - offset) % self.n

    def stretch(self, offset: int, first: int, count: int) -> slice:
        """The same for `count` neighbouring places, as a slice of the curve laid out twice."""
        start = (first - offset) % self.n
        return slice(start, start + count)


def block_sources(n: int, block: int, seed: int) -> Callable[[int], np.ndarray]:
    """The same for a replicate of `block_permutation`."""
    blocks = np.arange(-(-n // block))
    first, size = blocks * block, np.minimum(block, n - blocks * block)
    numbers = Hash60(0, len(blocks))

    def sources(replicate: int) -> np.ndarray:
        order = np.argsort(numbers(seed, replicate), kind="stable")  # equal numbers: the smaller block
        ends = np.cumsum(size[order])
        return np.arange(n) + np.repeat(first[order] - (ends - size[order]), size[order])

    return sources


def _center(x: np.ndarray, mass: np.ndarray) -> float | None:
    """Where the cumulative share of the mass reaches one half, linear between places."""
    cum = np.cumsum(mass)
    if not len(cum) or not cum[-1] > 0:
        return None
    total = cum[-1]
    high = int(np.searchsorted(cum, 0.5 * total, side="right"))
    # the first share above one half, which rounding may move by a place
    while high > 0 and cum[high - 1] / total > 0.5:
        high -= 1
    while high < len(cum) - 1 and cum[high] / total <= 0.5:
        high += 1
    if high == 0:
        return float(x[0])
    below, above = cum[high - 1] / total, cum[high] / total
    t = (0.5 - below) / (above - below)
    return float(x[high - 1] + t * (x[high] - x[high - 1]))


def _ranks(codes: np.ndarray, n: int) -> np.ndarray:
    """Average ranks from the places of the values among all different values."""
    count = np.bincount(codes, minlength=n)
    return (np.cumsum(count) - (count - 1) / 2)[codes]


def _divergence(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    part = lambda v: float((v * np.log2(np.divide(v, m, out=np.ones_like(m), where=v > 0))).sum())
    return max((part(p) + part(q)) / 2, 0.0)


CLOSE = 1e-7  # divergences below it are summed term by term, where the shorter form cancels


def _entropies(v: np.ndarray) -> np.ndarray:
    """v log v, zero at zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(v > 0, v * np.log(v), 0.0)


def _quick_divergence(p: np.ndarray, own: float, mass: np.ndarray, other: float) -> float:
    """`_divergence` of the shares p and of mass, given their sums of v log v: one logarithm a place.

    p log(p / m) + q log(q / m) is p log p + q log q - s log s with s = p + q, and one bit for m = s / 2."""
    total = mass.sum()
    s = mass / total
    s += p
    logs = np.log(np.maximum(s, 1e-300))
    js = (own + other / total - math.log(total) - float(logs @ s)) / (2 * math.log(2)) + 1
    return js if js > CLOSE else _divergence(p, mass / total)


def moved_alignment(curve: DataFrame, key: str, keys: Sequence[int], sources: Callable[[int], np.ndarray], lower: float, upper: float, cells: int = CELLS) -> DataFrame:
    """`alignment` of rows (idx, x, a, b), idx dense from 0, with `b` moved along the curve for each of `keys`
    and both read where x lies in [lower, upper].

    The keys are dealt into cells and each cell gets the curve, so a moved curve is never a row of a table:
    the work is keys times windows, what is shuffled cells times windows, and a task holds one curve.
    """
    keys = np.asarray(keys, np.int64)
    cells = max(1, min(cells, len(keys)))

    def measure(number, table):
        rows = pa.Table.from_struct_array(table["rows"].combine_chunks().flatten()).sort_by("idx")
        x, a, b = (rows[c].to_numpy() for c in ("x", "a", "b"))
        has_x, has_a, has_b = (rows[c].is_valid().to_numpy() for c in ("x", "a", "b"))
        with np.errstate(invalid="ignore"):
            inside = np.flatnonzero(has_x & (x >= lower) & (x <= upper))
        x = x[inside]
        code = [np.unique(v, return_inverse=True)[1] for v in (a, b)]
        n = len(a)
        mass_a, mass_b = np.where(has_a, np.maximum(a, 0.0), 0.0)[inside], np.where(has_b, np.maximum(b, 0.0), 0.0)
        total_a, center_a = mass_a.sum(), _center(x, mass_a)
        m, whole = len(inside), bool(has_a[inside].all() and has_b.all())
        code_a, entropies = code[0][inside], _entropies(mass_b)
        if whole and m:
            # ranks less their mean: those of `b` are looked up in a table by value
            ra = _ranks(code_a, n) - (m + 1) / 2
            square_a, shares, values_b = float(ra @ ra), mass_a / total_a if total_a > 0 else mass_a, int(code[1].max()) + 1
            entropy_a = float(_entropies(shares).sum())
        if m and hasattr(sources, "stretch") and inside[-1] - inside[0] + 1 == m:
            mass_b, has_b, entropies, code_b = (np.concatenate((v, v)) for v in (mass_b, has_b, entropies, code[1]))
            places = lambda k: sources.stretch(k, int(inside[0]), m)
        else:
            places, code_b = lambda k: sources(k)[inside], code[1]
        out = []
        for k in keys[number[0].as_py() :: cells].tolist():
            place = places(k)
            mass = mass_b[place]
            center_b = _center(x, mass)
            if center_a is None or center_b is None:
                continue
            rho = None
            if whole:
                codes = code_b[place]
                count = np.bincount(codes, minlength=values_b)
                rb = np.cumsum(count) - (count - 1) / 2 - (m + 1) / 2
                square_b = float((count * rb) @ rb)
                if square_a > 0 and square_b > 0:
                    rho = float(ra @ rb[codes]) / math.sqrt(square_a) / math.sqrt(square_b)
                js = _quick_divergence(shares, entropy_a, mass, float(entropies[place].sum()))
            else:
                both = has_a[inside] & has_b[place]
                if not both.any():
                    continue
                ra, rb = (_ranks(c, n) for c in (code_a[both], code_b[place][both]))
                if ra.min() < ra.max() and rb.min() < rb.max():
                    rho = float(((ra - ra.mean()) * (rb - rb.mean())).mean() / (ra.std() * rb.std()))
                js = _divergence(mass_a / total_a, mass / mass.sum())
            gap = center_a - center_b
            out.append((k, center_a, center_b, gap, abs(gap), rho, js))
        columns = list(zip(*out)) or [[]] * 7
        return pa.table([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=[key, *ALIGNED])

    # stretches of the curve are dealt, not its rows; the numbers of the cells are the short side of this product
    places = F.struct("idx", *[F.col(c).cast("double").alias(c) for c in ("x", "a", "b")])
    packed = curve.groupBy(F.floor(F.col("idx") / STRETCH).alias("_s")).agg(F.collect_list(places).alias("rows")).select("rows")
    dealt = packed.crossJoin(F.broadcast(curve.sparkSession.range(cells).withColumnRenamed("id", "cell")))
    schema = f"{key} int, " + ", ".join(f"{c} double" for c in ALIGNED)
    return shipped(dealt).repartition(cells, "cell").groupBy("cell").applyInArrow(measure, schema)


def grid_alignment(profiles: DataFrame, key: str, a: str, b: str, lower: float, upper: float, points: int = GRID_POINTS) -> DataFrame:
    """Discovery metrics per key: both curves read on one even grid of the shared region,
    baseline-subtracted area centres, Spearman of the curves, JS distance of the areas."""
    p = profiles.where(F.col("modality").isin(a, b))
    ext = p.groupBy(key, "modality").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    span = ext.groupBy(key).agg(
        F.greatest(F.max("x0"), F.lit(float(lower))).alias("lo"), F.least(F.min("x1"), F.lit(float(upper))).alias("hi")
    ).where("hi > lo")
    grid = span.select(key, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g")).withColumn(
        "gx", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (points - 1)
    )
    asked = grid.select(key, F.explode(F.array(F.lit(a), F.lit(b))).alias("modality"), F.col("g").cast("bigint").alias("g"), "gx")
    read = interpolate(materialize(asked), p.select(key, "modality", "idx", "x", "y"), [key, "modality"])
    curves = read.select(F.concat_ws("|", "modality", F.col(key).cast("string")).alias("series"), key, "modality", F.col("g").alias("idx"), F.col("gx").alias("x"), F.col("gy").alias("y"))
    return _grid_metrics(materialize(curves), key, a, b)


def moved_grid_alignment(
    one: DataFrame, pieces: DataFrame, idx: str, value: str, n: int, block: int, d: Design, replicates: int, seed: int, a: str, b: str, lower: float, upper: float, points: int = GRID_POINTS
) -> DataFrame:
    """`grid_alignment` by replicate of the curves `one` (modality, idx, x, y), as replicate -1, and of its curve of
    `a` with that of `b` made of moved windows. Where the curves are complete and no piece lacks a value, moved
    curves are read on the grid in the tasks that make them and only the readings are rows."""
    none = F.lit(-1).alias("replicate")
    own = one.where(F.col("modality").isin(a, b)).select(none, "modality", "idx", "x", "y")
    x = one.where(F.col("modality") == a).select("idx", "x")
    ends = one.where(F.col("modality").isin(a, b)).groupBy("modality").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).agg(F.max("x0").alias("x0"), F.min("x1").alias("x1")).first()
    lo, hi = (None, None) if ends["x0"] is None else (max(ends["x0"], float(lower)), min(ends["x1"], float(upper)))
    numbers = one.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    whole = lo is not None and hi > lo and complete(own, ["modality"]) and pieces.where(F.col(value).isNull() | F.isnan(value)).isEmpty()
    if not whole:
        moved = moved_windows(pieces, idx, value, n, block, d, replicates, seed).join(x, "idx").select("replicate", F.lit(b).alias("modality"), "idx", "x", "y")
        same = own.where(F.col("modality") == a).drop("replicate").crossJoin(F.broadcast(numbers))  # a curve for each replicate
        return grid_alignment(materialize(moved.unionByName(same).unionByName(own)), "replicate", a, b, lower, upper, points)
    grid = lo + (hi - lo) * np.arange(points) / (points - 1)
    asked = one.sparkSession.createDataFrame([(m, g, float(v)) for m in (a, b) for g, v in enumerate(grid)], "modality string, g bigint, gx double")
    at = asked.where(F.col("modality") == b)
    read = materialize(interpolate(asked, own.drop("replicate"), ["modality"]))
    moved = moved_windows(pieces, idx, value, n, block, d, replicates, seed, x, grid).join(F.broadcast(at), "g")
    all = read.select(none, "modality", "g", "gx", "gy").unionByName(read.where(F.col("modality") == a).crossJoin(F.broadcast(numbers)).select("replicate", "modality", "g", "gx", "gy"))
    all = all.unionByName(moved.select("replicate", "modality", "g", "gx", "gy"))
    series = F.concat_ws("|", "modality", F.col("replicate").cast("string")).alias("series")
    return _grid_metrics(materialize(all.select(series, "replicate", "modality", F.col("g").alias("idx"), F.col("gx").alias("x"), F.col("gy").alias("y"))), "replicate", a, b)


def _grid_metrics(curves: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Metrics per key of both curves on one grid: rows (series, key, modality, idx, x, y)."""
    mid = area_quantiles(curves, {"q50": 0.5}).select("series", "q50", "baseline")
    tagged = curves.join(mid, "series")
    side = lambda m, c: F.max(F.when(F.col("modality") == m, F.col(c)))
    centers = tagged.groupBy(key).agg(side(a, "q50").alias("q50_a"), side(b, "q50").alias("q50_b"), F.count_distinct("modality").alias("_m")).where("_m = 2").drop("_m")
    both = materialize(tagged.groupBy(key, "idx").agg(
        side(a, "y").alias("ya"), side(b, "y").alias("yb"), (side(a, "y") - side(a, "baseline")).alias("ea"), (side(b, "y") - side(b, "baseline")).alias("eb")
    ))
    rounded = both.select(key, F.round("ya", 9).alias("ya"), F.round("yb", 9).alias("yb"))
    out = centers.join(spearman(rounded, "ya", "yb", [key], "spearman_rho"), key).join(js_divergence(both, [key], "ea", "eb"), key)
    gap = F.col("q50_a") - F.col("q50_b")
    return out.select(key, "q50_a", "q50_b", gap.alias("signed_gap"), F.abs(gap).alias("absolute_gap"), "spearman_rho", "js_distance")
