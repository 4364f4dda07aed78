"""Tables that close a study: suitability, selection, nulls, claims, frozen evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .audit import checks
from .ordered import same_keys
from .stats import quantiles

MAX_RENDERED_ROWS = 10_000


def markdown_table(df: DataFrame) -> str:
    """A finished report table as Markdown; larger results are an error, not a cut."""
    escaped = [F.regexp_replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), r"\|", r"\\|") for c in df.columns]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |")).alias("line")).limit(MAX_RENDERED_ROWS + 1).collect()
    if len(lines) > MAX_RENDERED_ROWS:
        raise ValueError("table too long to render")
    head = " | ".join(df.columns)
    return f"| {head} |\n|{'---|' * len(df.columns)}\n" + "\n".join(r.line for r in lines)


def claim_boundaries(spark: SparkSession, facts: dict[str, bool]) -> DataFrame:
    """What the evidence supports and what it does not; each claim carries its flag."""
    claims = [
        ("lag_observed", "The frozen events of the two modalities are separated on the clock", facts.get("lag_observed", False)),
        ("lag_recovered", "The lag keeps its sign under paired resampling", facts.get("lag_recovered", False)),
        ("alignment_beyond_chance", "The curves align beyond shifted curves", facts.get("alignment_beyond_chance", False)),
        ("causal_order", "One modality causes the other", False),
        ("regulator_identified", "A single regulator explains the lag", facts.get("regulator_identified", False)),
    ]
    return spark.createDataFrame([(k, t, bool(v)) for k, t, v in claims], "claim string, statement string, supported boolean")


def claim_facts(pair: DataFrame, gates: DataFrame, evidence: DataFrame) -> dict[str, bool]:
    """The facts of `claim_boundaries`, each from its own stage; a stage without a result supports nothing.

    `pair` has the frozen pair per window design (lag, b_first): the events are apart if B is first in every
    design. `gates` are the bootstrap's checks (passed): the lag is recovered if all pass. `evidence` is
    the null's class: there is alignment beyond chance if at least two metrics are significant.
    """
    apart = pair.agg((F.count_if(F.col("b_first") & (F.col("lag") > 0)) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0)).first()[0]
    recovered = gates.agg(F.bool_and(F.coalesce("passed", F.lit(False)))).first()[0]
    aligned = evidence.agg(F.bool_or(F.col("evidence").isin("STRONG", "PARTIAL"))).first()[0]
    return {"lag_observed": bool(apart), "lag_recovered": bool(recovered), "alignment_beyond_chance": bool(aligned)}


def suitability(facts: DataFrame) -> DataFrame:
    """Trajectory suitability: pairing, representation, clock, order, continuity, overall.

    `facts` is one row: one_to_one, technical_r2, k_rho, ordered, continuous.
    """
    five = [
        ("paired correspondence", F.col("one_to_one")),
        ("representation quality", F.col("technical_r2") < 0.05),
        ("clock robustness", F.col("k_rho") >= 0.95),
        ("expected order", F.col("ordered")),
        ("local continuity", F.col("continuous")),
    ]
    together = five[0][1]
    for _, c in five[1:]:
        together = together & c
    return checks(facts, [*five, ("eligible for timing", together)])


def family_selection(families: DataFrame, chosen: DataFrame, modality_order: Sequence[str]) -> DataFrame:
    """Every candidate family with its support and whether it was chosen, in report order."""
    place = F.array_position(F.array(*[F.lit(m) for m in modality_order]), F.col("modality"))
    mark = chosen.select("modality", "family_id", F.lit(True).alias("_c"))
    return families.join(mark, ["modality", "family_id"], "left").select(
        place.alias("modality_order"), "modality", "family_id", "center", "n_designs", "n_interior_designs", "median_prominence", "distance_to_landmark",
        F.col("all_designs").alias("in_all_designs"), "robust_interior", "inside_region", F.coalesce("_c", F.lit(False)).alias("selected"),
    )


def selection_checks(table: DataFrame, n_modalities: int) -> DataFrame:
    chosen = F.col("selected")
    facts = table.agg(
        F.count_if(chosen).alias("n_selected"), F.count_distinct(F.when(chosen, F.col("modality"))).alias("n_modalities"),
        F.bool_and(~chosen | (F.col("robust_interior") & F.col("inside_region"))).alias("eligible"),
    )
    return checks(facts, [
        ("one family per modality", (F.col("n_selected") == n_modalities) & (F.col("n_modalities") == n_modalities)),
        ("selected families are robust and inside the region", F.col("eligible")),
    ])


def branch_selection(metrics: DataFrame, branch: str) -> DataFrame:
    """Worst case of every continuity metric per branch over all settings tried."""
    return metrics.groupBy(branch).agg(
        F.count(F.lit(1)).alias("n_settings"), F.min("cross_fraction").alias("min_cross_fraction"), F.min("adjacent_of_cross").alias("min_adjacent"),
        F.max("bypass_of_cross").alias("max_bypass"), F.min("min_bridge").alias("min_bridge"), F.min("chain_ratio").alias("min_chain_ratio"),
        F.bool_and("endpoint_largest").alias("endpoint_always_largest"),
    )


def null_summary(observed: DataFrame, null: DataFrame, metrics: dict[str, str], alpha: float = 0.05, inclusive: bool = True) -> DataFrame:
    """Per metric: observed value, null mean, median, 2.5 and 97.5 % points, empirical p, flag.

    `metrics` maps a metric to the extreme side, "low" or "high". `inclusive` is p <= alpha.
    """
    melt = lambda d, out: d.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("side"), F.col(m).cast("double").alias(out)) for m, s in metrics.items()])))
    j = melt(null, "null_value").join(F.broadcast(melt(observed, "observed")), ["metric", "side"])  # one row per metric
    extreme = F.when(F.col("side") == "low", F.col("null_value") <= F.col("observed")).otherwise(F.col("null_value") >= F.col("observed"))
    keys = ["metric", "side", "observed"]
    j = materialize(j)
    out = j.groupBy(*keys).agg(F.count("null_value").alias("n_null"), F.avg("null_value").alias("null_mean"), ((1 + F.count_if(extreme)) / (1 + F.count("null_value"))).alias("p"))
    out = same_keys(out, quantiles(j, keys, "null_value", {"null_median": 0.5, "null_low": 0.025, "null_high": 0.975}), keys, "left")
    return out.withColumn("significant", F.col("p") <= alpha if inclusive else F.col("p") < alpha)


def evidence_freeze(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row summaries of several stages as (stage, field, value) text rows."""
    out = None
    for stage, df in parts.items():
        rows = df.select(F.lit(stage).alias("stage"), F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns])))
        out = rows if out is None else out.unionByName(rows)
    return out
