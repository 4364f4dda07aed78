"""Coordinates: binning, nearest anchors, matched backgrounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import distance_class, encode_bin
from .ordered import running, same_keys

# Bin widths and edges of the matching strata, pool sizes per candidate.
ACCESS_BIN_WIDTH = 0.05
GC_INNER_EDGES = [0.35, 0.45, 0.55, 0.65]
POOL_PER_CANDIDATE = 40
BACKGROUND_PER_CANDIDATE = 10

POSITION_BLOCK = 1 << 20


def binned(df: DataFrame, chrom: str, start: str, end: str) -> DataFrame:
    """Add the encoded fixed-width bin of the interval midpoint (NULL off the canonical set)."""
    return df.withColumn("bin", encode_bin(F.col(chrom), F.floor((F.col(start) + F.col(end)) / 2).cast("bigint")))


def bin_presence(df: DataFrame, entity: str) -> DataFrame:
    """Distinct (entity, bin) pairs of binned intervals: the binary matrix in long form."""
    return df.where(F.col("bin").isNotNull()).select(F.col(entity).alias("entity"), F.col("bin").alias("feature")).distinct()


def nearest(
    queries: DataFrame, anchors: DataFrame, group: str, position: str, payload: Sequence[str], tie: Sequence[str]
) -> DataFrame:
    """Nearest anchor of each query within `group`; equal distances take the lower position,
    equal positions the first anchor in `tie` order. Groups without anchors, and queries with a NULL
    group or position, keep NULLs.

    Only distinct positions are compared, so a position shared by a third of the queries is
    one row; carrying the last and next anchor works in coordinate blocks, so a group holding
    a third of the rows is spread over as many tasks as it has blocks.
    """
    q = queries.select(group, position).distinct().withColumn("_q", F.lit(True))
    best = anchors.groupBy(group, position).agg(F.min(F.struct(*tie, *[c for c in payload if c not in tie])).alias("_a"))
    line = q.where(F.col(group).isNotNull() & F.col(position).isNotNull()).join(best.select(group, position, F.lit(True).alias("_has")), [group, position], "full")
    at = F.when(F.col("_has"), F.col(position))
    fwd = running(line, [group], position, {"_prev": ("max", at)}, block=POSITION_BLOCK)
    both = running(fwd, [group], position, {"_next": ("min", at)}, reverse=True, block=POSITION_BLOCK).where("_q")
    gap_prev, gap_next = F.col(position) - F.col("_prev"), F.col("_next") - F.col(position)
    pick = F.when(F.col("_prev").isNull() | (gap_next < gap_prev), F.col("_next")).otherwise(F.col("_prev"))
    placed = both.select(group, position, pick.alias("anchor_position"))
    named = placed.join(best.withColumnRenamed(position, "anchor_position"), [group, "anchor_position"], "left")
    table = named.select(group, position, "anchor_position", *[F.col(f"_a.{c}").alias(c) for c in payload])
    signed = F.col(position) - F.col("anchor_position")
    return same_keys(queries, table, [group, position], "left").withColumn("signed_distance", signed).withColumn(
        "distance", F.abs(signed)
    ).withColumn("distance_class", distance_class(F.abs(signed)))


def resolve_symbols(anchors: DataFrame, name: str, genes: DataFrame) -> DataFrame:
    """Symbol of an anchor: transcript table first, then a name that already is a symbol.

    `genes` has transcript_id, gene_symbol and line, its place in the list. The last listed symbol of
    a transcript wins.
    """
    by_transcript = genes.groupBy(F.col("transcript_id").alias(name)).agg(F.max_by("gene_symbol", "line").alias("_mapped"))
    symbols = genes.select(F.col("gene_symbol").alias(name)).distinct().withColumn("_known", F.lit(True))
    j = anchors.join(by_transcript, name, "left").join(symbols, name, "left")
    return j.withColumn("symbol", F.coalesce("_mapped", name)).withColumn(
        "symbol_source", F.when(F.col("_mapped").isNotNull(), "transcript_map").when(F.col("_known"), "name_is_symbol").otherwise("unresolved")
    ).drop("_mapped", "_known")


def symbol_summary(candidates: DataFrame, symbol: str, gain: str, fraction: str) -> DataFrame:
    """Per symbol: candidates, strongest gain and fraction, shortest distance."""
    return candidates.where(F.col(symbol).isNotNull() & (F.col(symbol) != "")).groupBy(symbol).agg(
        F.count(F.lit(1)).alias("n_intervals"), F.max(gain).alias("max_gain"), F.max(fraction).alias("max_fraction"), F.min("distance").alias("min_distance")
    )


def sample_per_stratum(df: DataFrame, strata: Sequence[str], h: Column, tie: str, requested: DataFrame) -> DataFrame:
    """Exactly `requested.n` rows per stratum (all, when fewer exist): the smallest by hash.

    Hash prefixes split a stratum into 4096 even pieces: whole pieces below the cut are taken,
    and only the piece at the cut is sorted. A stratum holding most rows is never one task.
    """
    strata = list(strata)
    rows = df.withColumn("_h", h).withColumn("_piece", F.shiftright(F.col("_h"), 48))
    sizes = rows.groupBy(*strata, "_piece").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*strata).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(requested, strata).where(F.col("_b") < F.col("n"))
    cuts = cuts.select(*strata, "_piece", (F.col("n") - F.col("_b")).alias("_left"), (F.col("_b") + F.col("_c") > F.col("n")).alias("_cut"))
    kept = rows.join(cuts, [*strata, "_piece"])
    inside = Window.partitionBy(*strata, "_piece").orderBy("_h", tie)
    at_cut = kept.where("_cut").withColumn("_r", F.row_number().over(inside)).where("_r <= _left").drop("_r")
    return kept.where(~F.col("_cut")).unionByName(at_cut).select(*df.columns)


def match_background(
    background: DataFrame, candidates: DataFrame, strata: Sequence[str], per_candidate: int, h: Column, tie: str
) -> tuple[DataFrame, DataFrame]:
    """Background rows matched to the candidate strata, and the audit of each stratum."""
    strata = list(strata)
    want = candidates.groupBy(*strata).agg((F.count(F.lit(1)) * per_candidate).alias("n"))
    chosen = sample_per_stratum(background, strata, h, tie, want)
    have = background.groupBy(*strata).agg(F.count(F.lit(1)).alias("available"))
    audit = want.join(have, strata, "left").select(
        *strata, (F.col("n") / per_candidate).cast("bigint").alias("candidate_n"), F.col("n").alias("requested"),
        F.coalesce("available", F.lit(0)).alias("available"), F.least("n", F.coalesce("available", F.lit(0))).alias("selected"),
    )
    return chosen, audit


def match_in_two_stages(
    background: DataFrame, candidates: DataFrame, coarse: Sequence[str], fine: Sequence[str], pool_h: Column, h: Column, tie: str,
    pool: int = POOL_PER_CANDIDATE, per_candidate: int = BACKGROUND_PER_CANDIDATE,
) -> tuple[DataFrame, DataFrame]:
    """A pool of `pool` rows per candidate in the coarse strata first, whose composition need not be
    known; then `per_candidate` rows per candidate from the pool in the coarse and fine strata together.
    Returns the chosen rows and the audit of each final stratum, which counts what the pool offers."""
    drawn, _ = match_background(background, candidates, coarse, pool, pool_h, tie)
    return match_background(drawn, candidates, [*coarse, *fine], per_candidate, h, tie)
