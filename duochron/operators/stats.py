"""Group statistics: exact quantiles, rank correlation, dominance, enrichment tests, p-values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .ordered import rank_rows, running, same_keys


# ---------------------------------------------------------------- quantiles
def quantiles(
    df: DataFrame, by: Sequence[str], x: str, qs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of `qs`.

    The distinct values are ranked by range partitioning and only the two around each quantile are
    kept, so no task holds a group's values (as the built-in `percentile` does). NULL is a group.
    """
    rows = df.select(*by, x).where(F.col(x).isNotNull())
    # equal values collapse first: ties only need their count
    counts = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c"))
    ranked = rank_rows(counts, [x], by, "_idx")
    cum = running(ranked, by, "_idx", {"_cum": ("sum", F.col("_c"))}, stored=True)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    placed = same_keys(cum, sizes, by)
    first, last = F.col("_cum") - F.col("_c"), F.col("_cum") - 1
    aggs = []
    for o, q in qs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        for part, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((first <= pos) & (last >= pos), F.col(x))).alias(f"_{part}_{o}"))
    out = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *aggs)
    cols = []
    for o, q in qs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        w = at - F.floor(at)
        cols.append((F.col(f"_lo_{o}") * (1 - w) + F.col(f"_hi_{o}") * w).alias(o))
    return out.select(*by, *cols)


def group_summary(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """count, median, quartiles, mean and sample sd per group."""
    q = quantiles(df, by, x, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    m = df.where(F.col(x).isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")
    )
    return same_keys(m, q, by)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: n, min, quartiles, max over its finite values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "x")
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    base = long.groupBy("metric").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"))
    return base.join(quantiles(long, ["metric"], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75}), ["metric"])


# ------------------------------------------------------------- rank statistics
def average_ranks(
    df: DataFrame, x: str, by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Add the average rank (1-based, ties share their mean) of `x` within `by`.

    Ranks are computed on the distinct values and joined back, so a value held by a third of the
    rows is one row in the sort. NULL is a group, and a NULL value ranks first.
    """
    counts = df.groupBy(*by, x).agg(F.count(F.lit(1)).alias("_c"))
    ranked = rank_rows(counts, [x], by, "_idx")
    cum = running(ranked, by, "_idx", {"_cum": ("sum", F.col("_c"))})
    table = cum.select(*by, x, (F.col("_cum") - (F.col("_c") - 1) / 2).alias(out))
    return same_keys(df, table, [*by, x])


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "rho") -> DataFrame:
    """Spearman correlation per group; NULL under two rows or with a constant side."""
    rows = df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, x, by, "_rx"), y, by, "_ry")
    return correlation(ranked, "_rx", "_ry", by, out)


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), out: str = "r") -> DataFrame:
    """Pearson correlation per group; NULL under two rows or with a constant side."""
    # covariance over deviations, because corr itself divides by zero on a constant side
    ok = (F.count(F.lit(1)) > 1) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return df.groupBy(*by).agg(F.when(ok, r).alias(out))


def dominance(df: DataFrame, label: str, x: str, labels: Sequence[str]) -> DataFrame:
    """Strict P(b > a) for every ordered pair a before b of `labels`; ties earn nothing.

    O(n log n): one row per distinct value with a count per label, cumulative counts, one sum.
    """
    rows = df.where(F.col(label).isin(list(labels)) & F.col(x).isNotNull())
    counts = rows.groupBy(x).agg(*[F.count_if(F.col(label) == l).alias(f"c{i}") for i, l in enumerate(labels)])
    ranked = rank_rows(counts, [x], (), "_idx")
    cum = running(ranked, [], "_idx", {f"s{i}": ("sum", F.col(f"c{i}")) for i in range(len(labels))})
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    wins = cum.agg(
        *[F.sum(F.col(f"c{i}")).cast("double").alias(f"n{i}") for i in range(len(labels))],
        *[F.sum(F.col(f"c{j}").cast("double") * (F.col(f"s{i}") - F.col(f"c{i}"))).alias(f"w{i}_{j}") for i, j in pairs],
    )
    rows_out = F.array(*[
        F.struct(
            F.lit(labels[i]).alias("a"),
            F.lit(labels[j]).alias("b"),
            F.lit(j - i).alias("steps"),
            (F.col(f"w{i}_{j}") / (F.col(f"n{i}") * F.col(f"n{j}"))).alias("probability"),
        )
        for i, j in pairs
    ])
    return wins.select(F.inline(rows_out))


# ----------------------------------------------------------------- summaries
def weighted_mean(x: Column, w: Column) -> Column:
    """Aggregate: mean over finite values with a positive finite weight."""
    ok = x.isNotNull() & ~F.isnan(x) & w.isNotNull() & ~F.isnan(w) & (w > 0)
    return F.sum(F.when(ok, x * w)) / F.sum(F.when(ok, w))


def rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def smd(flag: Column, x: Column) -> Column:
    """Aggregate: standardised mean difference of flagged against unflagged; 0 without spread."""
    a, b = F.when(flag, x), F.when(~flag, x)
    pooled = F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)
    return F.when(pooled <= 0, 0.0).otherwise((F.avg(a) - F.avg(b)) / pooled)


def bootstrap_summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, median, sample sd, 95 % percentile interval and P(> 0) over finite values."""
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(x))
    base = rows.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.avg((F.col(x) > 0).cast("int")).alias("p_positive"),
    )
    q = quantiles(rows, by, x, {"median": 0.5, "ci_low": 0.025, "ci_high": 0.975})
    return same_keys(base, q, by)


def p_lower(null: Column, observed: Column) -> Column:
    """Aggregate empirical p, small is extreme: +1 correction, ties count."""
    return (1 + F.count_if(null <= observed)) / (1 + F.count(null))


def p_upper(null: Column, observed: Column) -> Column:
    return (1 + F.count_if(null >= observed)) / (1 + F.count(null))


def evidence_class(n_significant: Column) -> Column:
    return F.when(n_significant == 3, "STRONG").when(n_significant == 2, "PARTIAL").otherwise("LIMITED_OR_NONE")


# ----------------------------------------------------------------- enrichment
TERMS_AT_ONCE = 512
TABLES_AT_ONCE = 1_024


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log(n!) less its Stirling formula, for n >= 1."""
    small = np.minimum(n, 16.0)
    exact = np.array([math.lgamma(v + 1) - (v + 0.5) * math.log(v) + v - 0.5 * math.log(2 * math.pi) for v in range(1, 17)])
    v = np.maximum(n, 16.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / v**2) / v**2) / v**2) / v
    return np.where(n < 16, exact[np.maximum(small, 1).astype(int) - 1], series)


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x for x, m > 0, without cancellation where they are close."""
    v = (x - m) / (x + m)
    total, term = (x - m) * v, 2 * x * v
    for j in range(1, 24):
        term = term * v * v
        total = total + term / (2 * j + 1)
    return np.where(np.abs(v) < 0.1, total, x * np.log(x / m) + m - x)


def _log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Log of the binomial probability of x in n with chances p and q = 1 - p, by saddle points (Loader 2000)."""
    y = n - x
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(y) - _deviance(x, n * p) - _deviance(y, n * q) - 0.5 * (math.log(2 * math.pi) + np.log(x) + np.log(y) - np.log(n))
        only = lambda p, q: n * np.where(p < 0.5, np.log(p), np.log1p(-q))
        return np.where(x == 0, only(q, p), np.where(y == 0, only(p, q), inside))


def _tail(x: np.ndarray, n1: np.ndarray, n2: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X >= x) / P(X = x) from the ratios of neighbouring terms, for x at or above the mean."""
    total, last, at = np.ones(len(x)), np.ones(len(x)), x.astype(float)
    left = np.arange(len(x))
    while len(left):
        z = at[left, None] + np.arange(TERMS_AT_ONCE)
        a, b, m = n1[left, None], n2[left, None], k[left, None]
        terms = last[left, None] * np.cumprod(np.maximum(a - z, 0) / (z + 1) * (np.maximum(m - z, 0) / (b - m + z + 1)), axis=1)
        total[left] += terms.sum(1)
        last[left] = terms[:, -1]
        at[left] += TERMS_AT_ONCE
        left = left[last[left] > 1e-18 * total[left]]
    return total


def upper_tails(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """P(X >= a) for each table [[a, b], [c, d]], X hypergeometric with the table's margins.

    The observed term comes from saddle points, the others from it by their ratios outwards, up from `a`
    if it lies above the mean, else down from a - 1 and taken from one. Memory does not follow the
    totals, which may go up to 2^53.
    """
    tables = np.array([np.asarray(v, np.float64) for v in (a, b, c, d)])
    out = np.ones(tables.shape[1])
    for lo in range(0, len(out), TABLES_AT_ONCE):
        a, b, c, d = tables[:, lo : lo + TABLES_AT_ONCE]
        n1, n2, k = a + b, c + d, a + c
        live = np.flatnonzero(a > np.maximum(0, k - n2))
        a, n1, n2, k = a[live], n1[live], n2[live], k[live]
        up = a > k * (n1 / (n1 + n2))
        # the lower tail of X is the upper tail of the second column's count: swap the columns
        x, m = np.where(up, a, n1 - a + 1), np.where(up, k, n1 + n2 - k)
        p, q = m / (n1 + n2), (n1 + n2 - m) / (n1 + n2)
        log = _log_binomial(x, n1, p, q) + _log_binomial(m - x, n2, p, q) - _log_binomial(m, n1 + n2, p, q)
        tail = np.exp(log) * _tail(x, n1, n2, m)
        out[lo + live] = np.where(up, tail, 1 - tail)
    return np.clip(out, 0.0, 1.0)


@pandas_udf(T.DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """One-sided (greater) exact p of the 2x2 table [[a, b], [c, d]]."""
    return pd.Series(upper_tails(a, b, c, d))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample cross product; infinite when only the denominator is zero, NULL for 0/0."""
    top, bottom = (a * d).cast("double"), (b * c).cast("double")
    return F.when(bottom > 0, top / bottom).when(top > 0, F.lit(float("inf")))


def bh_adjust(df: DataFrame, p: str, tie: str, out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg: running minimum of p*n/rank from the largest p down, at most 1."""
    ranked = rank_rows(df, [p, tie], (), "_idx")  # writes the tests once: the count reads them from there
    n = ranked.count()
    scaled = F.col(p) * n / (F.col("_idx") + 1)
    return running(ranked, [], "_idx", {out: ("min", scaled)}, reverse=True, stored=True).withColumn(out, F.least(F.col(out), F.lit(1.0))).drop("_idx")


# --------------------------------------------------------- multivariate fit
def dummies(col: str, levels: Sequence) -> list[Column]:
    """0/1 columns of all levels but the first, named after the level."""
    return [(F.col(col) == l).cast("int").alias(str(l)) for l in list(levels)[1:]]


MAX_LEVELS = 500  # label levels of one model: its normal equations are that size squared


def _levels(df: DataFrame, columns: Sequence[str]) -> list[tuple[str, object]]:
    """(column, level) of all label columns, bounded; NULL is no level."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("l")) for c in columns]))
    rows = df.select(cells.alias("_x")).where("_x.l is not null").distinct().limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError("label columns have too many levels for a linear model")
    return sorted((r["_x"]["c"], r["_x"]["l"]) for r in rows)


def partial_r2(df: DataFrame, dims: Sequence[str], biology: Sequence[str], technical: Sequence[str]) -> dict[str, float]:
    """Share of multivariate variance each label block adds once the other is in the model.

    A one-way layout per column needs no coded matrix: the normal equations of the full model are
    pair counts of levels and value sums per level, which Spark groups and sums. Every smaller model
    is a block of the same equations. Levels are redundant against the mean and each other, so the
    minimum-norm solution is taken. Rows with a NULL label count towards the mean alone.
    """
    columns = list(dict.fromkeys([*biology, *technical]))
    place = {k: i + 1 for i, k in enumerate(_levels(df, columns))}
    marks = F.array(F.struct(F.lit("").alias("c"), F.lit("").alias("l")), *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("l")) for c in columns])
    held = df.select(*dims, F.filter(marks, lambda m: m["l"].isNotNull()).alias("_m"))
    pairs = held.select("_m", F.explode("_m").alias("_a")).select("_a", F.explode("_m").alias("_b")).groupBy("_a", "_b").count().collect()
    sums = held.select(*dims, F.explode("_m").alias("_a")).groupBy("_a").agg(*[F.sum(d).alias(d) for d in dims]).collect()
    squares = float(df.agg(sum(F.sum(F.col(d) * F.col(d)) for d in dims)).first()[0] or 0.0)
    at = lambda m: place.get((m["c"], m["l"]), 0)
    gram, right = np.zeros((len(place) + 1, len(place) + 1)), np.zeros((len(place) + 1, len(dims)))
    for r in pairs:
        gram[at(r["_a"]), at(r["_b"])] = r["count"]
    for r in sums:
        right[at(r["_a"])] = [r[d] for d in dims]

    def left_over(columns: Sequence[str]) -> float:
        use = [0] + [i for (c, _), i in place.items() if c in columns]
        g, r = gram[np.ix_(use, use)], right[use]
        return squares - float((r * (np.linalg.pinv(g, hermitian=True) @ r)).sum())

    sse = {name: left_over(cols) for name, cols in (("full", columns), ("biology", biology), ("technical", technical), ("mean", ()))}
    gain = lambda base, more: max(0.0, 1 - sse[more] / sse[base]) if sse[base] > 0 else float("nan")
    return {
        "technical_partial_r2": gain("biology", "full"), "biology_partial_r2": gain("technical", "full"), "biology_r2": gain("mean", "biology"),
        "sse_full": sse["full"], "sse_biology": sse["biology"], "sse_technical": sse["technical"], "sst": sse["mean"], "n": int(gram[0, 0]),
    }


def one_label_r2(df: DataFrame, label: str, dims: Sequence[str]) -> DataFrame:
    """Between-group share of variance over all dims for a single label, in one aggregation."""
    cells = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(d).alias(f"s_{d}") for d in dims], *[F.sum(F.col(d) * F.col(d)).alias(f"q_{d}") for d in dims]
    )
    within = sum((F.sum(F.col(f"q_{d}") - F.col(f"s_{d}") * F.col(f"s_{d}") / F.col("n")) for d in dims), F.lit(0.0))
    total = sum((F.sum(f"q_{d}") - F.sum(f"s_{d}") * F.sum(f"s_{d}") / F.sum("n") for d in dims), F.lit(0.0))
    return cells.agg(F.sum("n").alias("n"), within.alias("sse"), total.alias("sst")).withColumn(
        "r2", F.when(F.col("sst") > 0, F.greatest(1 - F.col("sse") / F.col("sst"), F.lit(0.0)))
    )
