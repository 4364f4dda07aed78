"""Pairing, key and set audits; PASS/REVIEW tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}")
    return df


def plain_name(name: str) -> str:
    """A column name in lower case, every run of other signs than letters and digits one underscore."""
    return re.sub(r"[\W_]+", "_", name.strip().lower()).strip("_")


def columns_by_role(columns: Sequence[str], roles: Mapping[str, Sequence[str]]) -> dict[str, str | None]:
    """The column that plays each role, or None. `roles` lists the names a role may go by, best first.

    A column of that very name comes before one that carries it behind a qualifier (`rna:cell_type` for
    `cell type`), whatever the order of names. Several columns for the deciding name are an error, for
    which of them is meant cannot be told from names.
    """
    plain: dict[str, list[str]] = {}
    for c in columns:
        plain.setdefault(plain_name(c), []).append(c)

    def behind(name: str) -> list[str]:
        return [c for p, cs in plain.items() if p.endswith("_" + name) for c in cs]

    out: dict[str, str | None] = {}
    for role, names in roles.items():
        wanted = [plain_name(n) for n in names]
        hits = next((h for find in (lambda n: plain.get(n, []), behind) for n in wanted if (h := find(n))), [])
        if len(hits) > 1:
            raise ValueError(f"{role}: {', '.join(sorted(hits))} fit equally well")
        out[role] = hits[0] if hits else None
    return out


def table_by_roles(tables: Mapping[str, Sequence[str]], roles: Mapping[str, Sequence[str]]) -> tuple[str, dict[str, str | None]]:
    """Of several tables' columns, the table that plays most roles (the first of equals) and its columns."""
    found = {t: columns_by_role(c, roles) for t, c in tables.items()}
    if not any(v for f in found.values() for v in f.values()):
        raise ValueError("no table has a column for any role")
    best = max(found, key=lambda t: sum(v is not None for v in found[t].values()))
    return best, found[best]


def role_audit(df: DataFrame, chosen: Mapping[str, str | None]) -> DataFrame:
    """(role, column, n_filled, n_distinct) of every role that has a column; values count as text."""
    cells = [F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for r, c in chosen.items() if c]
    if not cells:
        raise ValueError("no role has a column")
    values = df.select(F.inline(F.array(*cells))).groupBy("role", "column", "v").agg(F.count("v").alias("n"))
    return values.groupBy("role", "column").agg(F.sum("n").alias("n_filled"), F.count("v").alias("n_distinct"))


def require_one_row(df: DataFrame, what: str) -> DataFrame:
    n = len(df.limit(2).collect())
    if n != 1:
        raise ValueError(f"{what}: expected exactly one row, found {'none' if n == 0 else 'several'}")
    return df


def set_metrics(reference: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Recall, precision, Jaccard and exactness of two key universes, one shuffle on the key."""
    sides = reference.select(key).withColumn("_s", F.lit(1)).unionAll(observed.select(key).withColumn("_s", F.lit(2)))
    keyed = sides.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max((F.col("_s") == 1).cast("int")).alias("r"), F.max((F.col("_s") == 2).cast("int")).alias("o")
    )
    s = keyed.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("reference_n"),
        F.coalesce(F.sum("o"), F.lit(0)).alias("observed_n"),
        F.coalesce(F.sum(F.col("r") * F.col("o")), F.lit(0)).alias("intersection"),
        F.count(F.lit(1)).alias("_union"),
    )
    return s.select(
        "reference_n",
        "observed_n",
        "intersection",
        (F.col("reference_n") - F.col("intersection")).alias("reference_not_observed"),
        (F.col("observed_n") - F.col("intersection")).alias("observed_not_reference"),
        F.when(F.col("reference_n") > 0, F.col("intersection") / F.col("reference_n")).alias("reference_recall"),
        F.when(F.col("observed_n") > 0, F.col("intersection") / F.col("observed_n")).alias("observed_precision"),
        F.when(F.col("_union") > 0, F.col("intersection") / F.col("_union")).alias("jaccard"),
        ((F.col("reference_n") == F.col("intersection")) & (F.col("observed_n") == F.col("intersection"))).alias("exact_match"),
    )


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """Rows, missing keys, distinct keys, and rows beyond the first of each key."""
    keyed = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return keyed.agg(
        F.sum("c").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("c"))), F.lit(0)).alias("n_missing"),
        F.count(key).alias("n_distinct"),
        F.count_if(F.col(key).isNotNull() & (F.col("c") > 1)).alias("n_repeated_keys"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("c") - 1)), F.lit(0)).alias("n_extra_rows"),
    )


def pairing_audit(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Do two tables pair one to one on `key`? Counts of one-sided and repeated keys."""
    sides = a.select(key).withColumn("_s", F.lit(1)).unionAll(b.select(key).withColumn("_s", F.lit(2)))
    keyed = sides.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col("_s") == 1).alias("ca"), F.count_if(F.col("_s") == 2).alias("cb")
    )
    return keyed.agg(
        F.count_if((F.col("ca") == 1) & (F.col("cb") == 1)).alias("n_paired"),
        F.count_if((F.col("ca") > 0) & (F.col("cb") == 0)).alias("n_only_a"),
        F.count_if((F.col("cb") > 0) & (F.col("ca") == 0)).alias("n_only_b"),
        F.count_if((F.col("ca") > 1) | (F.col("cb") > 1)).alias("n_repeated"),
    ).withColumn("one_to_one", (F.col("n_only_a") + F.col("n_only_b") + F.col("n_repeated")) == 0)


def paired_join(a: DataFrame, b: DataFrame, key: str, many_to_one: bool = False) -> DataFrame:
    """Inner join that refuses repeated keys (on the right only for `many_to_one`)."""
    for side, name in ((a, "left"), (b, "right")):
        if many_to_one and name == "left":
            continue
        twice = side.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(key).limit(1).collect()
        if twice:
            raise ValueError(f"{name} side repeats key {twice[0][0]!r}")
    return a.join(b, key)


def common_features(df: DataFrame, feature: str, sample: str, position: str, first_sample) -> DataFrame:
    """Features present in every sample, with their position in the first sample."""
    n_samples = df.select(sample).distinct().agg(F.count(F.lit(1)).alias("_k"))
    per = df.groupBy(feature, sample).agg(F.min(position).alias("_p"))
    found = per.groupBy(feature).agg(
        F.count(F.lit(1)).alias("_k"), F.min(F.when(F.col(sample) == first_sample, F.col("_p"))).alias("first_position")
    )
    return found.join(F.broadcast(n_samples), "_k", "left_semi").drop("_k")


def shared_members(membership: DataFrame, group: str, member: str, groups: Sequence[str]) -> DataFrame:
    """Entities shared by each pair of groups, without a self join: one row per entity."""
    flags = membership.groupBy(member).agg(*[F.max((F.col(group) == g).cast("int")).alias(f"g{i}") for i, g in enumerate(groups)])
    pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
    sums = flags.agg(*[F.coalesce(F.sum(F.col(f"g{i}") * F.col(f"g{j}")), F.lit(0)).alias(f"s{i}_{j}") for i, j in pairs])
    rows = [F.struct(F.lit(groups[i]).alias("group_a"), F.lit(groups[j]).alias("group_b"), F.col(f"s{i}_{j}").alias("n_shared")) for i, j in pairs]
    return sums.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))  # one row
    return counts.crossJoin(total).withColumn("fraction", F.col("n") / F.col("_total")).drop("_total")


def crosstab_margins(df: DataFrame, rows: str, cols: str, margin: str = "All") -> DataFrame:
    """Long-form contingency table with row, column and grand totals."""
    cube = df.select(F.col(rows).cast("string").alias(rows), F.col(cols).cast("string").alias(cols)).cube(rows, cols)
    out = cube.agg(F.count(F.lit(1)).alias("n"), F.grouping(rows).alias("_gr"), F.grouping(cols).alias("_gc"))
    return out.select(
        F.when(F.col("_gr") == 1, margin).otherwise(F.col(rows)).alias(rows),
        F.when(F.col("_gc") == 1, margin).otherwise(F.col(cols)).alias(cols),
        "n",
    )


def finite_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, non-finite rows, negative rows, minimum and maximum."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "x")
    bad = F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))
    return long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("n_not_finite"),
        F.count_if(~bad & (F.col("x") < 0)).alias("n_negative"),
        F.min(F.when(~bad, F.col("x"))).alias("minimum"),
        F.max(F.when(~bad, F.col("x"))).alias("maximum"),
    )


def checks(facts: DataFrame, criteria: Sequence[tuple[str, Column]]) -> DataFrame:
    """One-row facts to a criterion/pass/status table. A failed gate is a row, not an error."""
    rows = [
        F.struct(F.lit(i).alias("step"), F.lit(name).alias("criterion"), F.coalesce(test, F.lit(False)).alias("passed"))
        for i, (name, test) in enumerate(criteria, 1)
    ]
    return facts.select(F.inline(F.array(*rows))).withColumn("status", F.when(F.col("passed"), "PASS").otherwise("REVIEW"))


def verdict(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("n_checks"),
        F.count_if(F.col("passed")).alias("n_passed"),
        F.when(F.bool_and("passed"), "PASS").otherwise("REVIEW").alias("verdict"),
    )
