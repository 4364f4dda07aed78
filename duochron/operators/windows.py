"""Fixed-count sliding windows along a rank, landmarks, and what a window holds.

A window [s, s + size) with s = w * step is never a range join. Additive summaries are built
from panes of gcd(size, step) consecutive ranks: rows collapse to panes with a map-side
aggregate, and only panes (a hundredth of the rows) are copied to the windows they belong to.
Order statistics of the order key need no window contents at all: in a ranked table the
median of a window is the key at known ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Design:
    """A window design: `size` consecutive ranks, advancing by `step`."""

    name: str
    size: int
    step: int

    def count(self, n: int) -> int:
        """Full windows only; the tail is dropped."""
        return max(0, (n - self.size) // self.step + 1)


# The three window designs.
DESIGNS = [Design("300/75", 300, 75), Design("400/100", 400, 100), Design("500/125", 500, 125)]
PRIMARY = DESIGNS[1]


def window_ids(rk: Column, d: Design, n: int, span: int = 1) -> Column:
    """Array of the windows that hold ranks rk .. rk + span - 1 entirely."""
    last = F.least(F.floor(rk / d.step), F.lit(d.count(n) - 1))
    first = F.greatest(F.ceil((rk + span - d.size) / d.step), F.lit(0))
    return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))


def membership(ranked: DataFrame, d: Design, n: int, rk: str = "rk") -> DataFrame:
    """One row per (entity, window): the full content, needed only by whole-window kernels."""
    return ranked.withColumn("window_index", F.explode(window_ids(F.col(rk), d, n)))


def window_table(
    ranked: DataFrame, designs: Sequence[Design], n: int, sums: dict[str, Column], key: str | None = None, by: Sequence[str] = (), rk: str = "rk"
) -> DataFrame:
    """All windows of all designs in one pass over the ranked rows.

    Each row feeds one pane per design (combined before the shuffle); panes then go to their
    windows. Columns: `by`, design keys, one total per entry of `sums`, and with `key` its
    median, minimum and maximum per window, read at computed ranks.
    """
    by, pos = list(by), F.col(rk)
    cells = []
    for i, d in enumerate(designs):
        pane = math.gcd(d.size, d.step)
        lo, hi = (d.size - 1) // 2, d.size // 2
        off = pos % pane
        at = lambda place: F.when(off == place % pane, F.col(key)) if key else F.lit(None)
        cells.append(F.struct(
            F.lit(i).alias("design"), F.floor(pos / pane).cast("bigint").alias("pane"),
            at(0).alias("k_first"), at(lo).alias("k_lo"), at(hi).alias("k_hi"), at(pane - 1).alias("k_last"),
        ))
    terms = ranked.select(*by, rk, *([key] if key else []), *[e.alias(f"_t_{o}") for o, e in sums.items()])
    spread = terms.select(*by, *[f"_t_{o}" for o in sums], F.explode(F.array(*cells)).alias("c"))
    slots = ("k_first", "k_lo", "k_hi", "k_last") if key else ()
    panes = spread.groupBy(*by, "c.design", "c.pane").agg(*[F.sum(f"_t_{o}").alias(o) for o in sums], *[F.max(f"c.{s}").alias(s) for s in slots])
    holders = None
    for i, d in enumerate(designs):
        pane = math.gcd(d.size, d.step)
        mine = window_ids(F.col("pane") * pane, d, n, span=pane)
        holders = F.when(F.col("design") == i, mine) if holders is None else holders.when(F.col("design") == i, mine)
    held = panes.withColumn("window_index", F.explode(holders))
    pick = _picker(designs)
    pane_of = lambda rank: F.floor(rank / pick(lambda d: math.gcd(d.size, d.step)))
    turn = F.col("pane") - pane_of(F.col("window_index") * pick(lambda d: d.step))
    aggs = [F.sum(o).alias(o) for o in sums]
    if key:
        in_pane = lambda slot, rank: F.max(F.when(turn == pane_of(pick(rank)), F.col(slot)))
        aggs += [
            ((in_pane("k_lo", lambda d: (d.size - 1) // 2) + in_pane("k_hi", lambda d: d.size // 2)) / 2).alias("parameter"),
            in_pane("k_first", lambda d: 0).alias("position_min"),
            in_pane("k_last", lambda d: d.size - 1).alias("position_max"),
        ]
    per = held.groupBy(*by, "design", "window_index").agg(*aggs)
    start = F.col("window_index") * pick(lambda d: d.step)
    return per.select(
        *by, pick(lambda d: d.name).alias("window_config"), pick(lambda d: d.size).alias("window_size"), pick(lambda d: d.step).alias("step_size"),
        "window_index", start.alias("start_rank"), (start + pick(lambda d: d.size)).alias("stop_rank"),
        *[c for c in per.columns if c not in (*by, "design", "window_index")],
    )


def _picker(designs: Sequence[Design]):
    """Value of the row's design, by its number."""
    return lambda f: F.element_at(F.array(*[F.lit(f(d)) for d in designs]), F.col("design") + 1)


def window_positions(ranked: DataFrame, key: str, designs: Sequence[Design], n: int) -> DataFrame:
    return window_table(ranked, designs, n, {}, key)


def _label_sums(label: str, labels: Sequence[str]) -> dict[str, Column]:
    return {f"n_{l}": F.coalesce((F.col(label) == l).cast("bigint"), F.lit(0)) for l in labels}


def _shares(labels: Sequence[str]) -> list[Column]:
    best = F.greatest(*[F.col(f"n_{l}") for l in labels])
    dominant = F.coalesce(*[F.when(F.col(f"n_{l}") == best, F.lit(l)) for l in labels])
    return [*[(F.col(f"n_{l}") / F.col("window_size")).alias(f"fraction_{l}") for l in labels], dominant.alias("dominant_label")]


def common_windows(
    ranked: DataFrame, key: str, label: str, labels: Sequence[str], designs: Sequence[Design], n: int
) -> DataFrame:
    """The window family both modalities share: ranks, positions, label counts and fractions,
    and the dominant label (first of `labels` on ties)."""
    t = window_table(ranked, designs, n, _label_sums(label, labels), key)
    return t.select("*", *_shares(labels))


def mean_scores(
    ranked: DataFrame, designs: Sequence[Design], n: int, values: dict[str, str], key: str = "clock", by: Sequence[str] = (), rk: str = "rk"
) -> DataFrame:
    """Long curves of window means: (series, by..., modality, window_config, idx, x, y).

    `values` maps a modality name to its column.
    """
    t = window_table(ranked, designs, n, {f"s_{m}": F.col(c) for m, c in values.items()}, key, by, rk)
    stacked = F.inline(F.array(*[F.struct(F.lit(m).alias("modality"), F.round(F.col(f"s_{m}") / F.col("window_size"), 9).alias("y")) for m in values]))
    long = t.select(*by, "window_config", F.col("window_index").alias("idx"), F.col("parameter").alias("x"), stacked)
    return long.select(F.concat_ws("|", "modality", "window_config", *[F.col(c).cast("string") for c in by]).alias("series"), *by, "modality", "window_config", "idx", "x", "y")


# ------------------------------------------------------------------ landmarks
def landmark_midpoints(medians: DataFrame, label: str, median: str, order: Sequence[str]) -> DataFrame:
    """Midpoint between the medians of consecutive labels of a prescribed order.

    `medians` has one row per label. Each transition carries the interval between its two
    medians and the upstream limit (median of the label before) where one exists.
    """
    place = F.array_position(F.array(*[F.lit(l) for l in order]), F.col(label).cast("string"))
    rows = medians.select(F.col(label).alias("label"), F.col(median).alias("m"), place.alias("place")).where("place > 0")
    w = Window.partitionBy(F.lit(0)).orderBy("place")  # one row per label
    nxt = rows.select(
        "place",
        F.col("label").alias("from_label"),
        F.lead("label").over(w).alias("to_label"),
        F.lag("m").over(w).alias("upstream_limit"),
        F.col("m").alias("lower"),
        F.lead("m").over(w).alias("upper"),
    )
    return nxt.where(F.col("to_label").isNotNull()).select(
        F.concat_ws(" -> ", "from_label", "to_label").alias("transition"),
        "upstream_limit",
        "lower",
        "upper",
        ((F.col("lower") + F.col("upper")) / 2).alias("landmark"),
        (F.col("upper") > F.col("lower")).alias("increases"),
    )


def nearest_landmark(df: DataFrame, position: str, landmarks: Sequence[tuple[str, float]]) -> DataFrame:
    """Nearest of a handful of named positions, first on ties, as one expression per row."""
    cand = F.array(*[F.struct(F.abs(F.col(position) - v).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(float(v)).alias("at")) for i, (n, v) in enumerate(landmarks)])
    best = F.array_min(cand)
    return df.select("*", best["name"].alias("landmark"), best["at"].alias("landmark_position"), best["d"].alias("landmark_distance"))


def locate_window(windows: DataFrame, x: str, position: float, tolerance: float = 1e-10) -> DataFrame:
    """The single window at an exact position; an error when none lies within tolerance."""
    found = windows.withColumn("_d", F.abs(F.col(x) - F.lit(position))).orderBy("_d", x).limit(1)
    row = found.first()
    if row is None or row["_d"] > tolerance:
        raise ValueError(f"no window within {tolerance} of position {position}")
    return found.drop("_d")
