"""Peaks, families and curves against brute force, and long curves against short ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.operators import peaks as P, profiles as R, resample as B, windows as W
from duochron.operators.ordered import rank_rows
from test_queries import frames_equal


def brute(y):
    out, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                k = (i + j) // 2
                lows = []
                for step in (-1, 1):
                    at, low = k, y[k]
                    while 0 <= at < n and y[at] <= y[k]:
                        low = min(low, y[at])
                        at += step
                    lows.append(low)
                out.append((k, y[k] - max(lows)))
            i = j
        i += 1
    return out


def spaced(pk, y, d):
    keep = dict.fromkeys(pk, True)
    for k in sorted(pk, key=lambda k: (y[k], k), reverse=True):
        if keep[k]:
            for j in pk:
                if j != k and abs(j - k) < d and (y[j], j) < (y[k], k):
                    keep[j] = False
    return [k for k in pk if keep[k]]


@pytest.fixture(scope="module")
def curves(spark):
    rng = np.random.default_rng(1)
    data = {"A|w": np.round(np.cumsum(rng.normal(size=260)), 1), "B|w": np.round(np.cumsum(rng.normal(size=57)), 1), "C|flat": np.ones(9), "D|saw": np.tile([0.0, 1.0], 30) + np.arange(60) / 100}
    rows = [(s, i, float(i) / 10 + 0.01 * i * i / len(y), float(v)) for s, y in data.items() for i, v in enumerate(y)]
    return data, spark.createDataFrame(rows, "series string, idx bigint, x double, y double").cache()


def test_peaks_any_block(curves):
    data, p = curves
    want = sorted((s, k, round(v, 9)) for s, y in data.items() for k, v in brute(y))
    for block in (P.BLOCK, 64):
        got = sorted((r.series, r.idx, round(r.prominence, 9)) for r in P.found_peaks(p, 1, block).collect())
        assert got == want


def test_first_beyond_over_several_levels(spark, monkeypatch):
    """Climbing and descending four levels, with many queries on one group, against a plain walk."""
    monkeypatch.setattr(P, "QUERIES_PER_TASK", 50)
    rng = np.random.default_rng(9)
    y = np.round(np.cumsum(rng.normal(size=900)), 1)
    p = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)] + [("t", i, float(i)) for i in range(5)], "series string, idx bigint, y double")
    asked = [("s", int(i), int(side), float(y[i] + extra)) for i in rng.integers(0, 900, 150) for side in (-1, 1) for extra in (0.0, 3.0)] + [("t", 2, 1, 3.0), ("t", 2, -1, 9.0)]
    asked = list(dict.fromkeys(asked))
    got = {(r.series, r.idx, r.side, r.h): (r.hit, r.low, r.low_idx) for r in P.first_beyond(p, spark.createDataFrame(asked, "series string, idx bigint, side int, h double"), 6).collect()}
    assert len(got) == len(asked)
    for s, i, side, h in asked:
        v = y if s == "s" else np.arange(5.0)
        low, place, at = np.inf, i, i + side
        while 0 <= at < len(v) and v[at] <= h:
            if v[at] < low:
                low, place = v[at], at
            at += side
        assert got[s, i, side, h] == (at if 0 <= at < len(v) else None, low, place)


def test_long_curves(spark):
    """Two million points in one curve: only the asked groups' rows reach a task, none the driver."""
    n = 2_000_000
    p = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("idx"), F.when(F.col("id") == n - 7, 2.0).when(F.col("id") == 5, -1.0).otherwise(F.col("id") % 2 * 1.0).alias("y"))
    q = spark.createDataFrame([("s", 9, 1, 1.0), ("s", n - 9, -1, 1.0), ("s", 1_000_000, 1, 0.5), ("s", 1_000_000, -1, -0.5)], "series string, idx bigint, side int, h double")
    got = {(r.idx, r.side): (r.hit, r.low, r.low_idx) for r in P.first_beyond(p, q).collect()}
    assert got == {(9, 1): (n - 7, 0.0, 10), (n - 9, -1): (None, -1.0, 5), (1_000_000, 1): (1_000_001, np.inf, 1_000_000), (1_000_000, -1): (999_999, np.inf, 1_000_000)}


def test_distance_pruning(curves):
    data, p = curves
    want = sorted((s, k) for s, y in data.items() for k in spaced([a for a, _ in brute(y)], y, 3))
    for block in (P.BLOCK, 16):
        assert sorted((r.series, r.idx) for r in P.found_peaks(p, 3, block).select("series", "idx").collect()) == want


def test_half_height_any_block(curves):
    _, p = curves
    pk = P.prominences(p)
    a, b = (P.half_height(p, pk, n).toPandas().sort_values(["series", "idx"]) for n in (P.BLOCK, 16))
    assert len(a) == pk.count() and np.allclose(a.half_width, b.half_width)


def slow_greedy(x, tol):
    start, fam, out = 0, 0, [0]
    for j in range(1, len(x)):
        if x[j] - np.median(x[start:j]) > tol:
            start, fam = j, fam + 1
        out.append(fam)
    return out


def slow_linkage(x, tol):
    groups = [[v] for v in x]
    while len(groups) > 1:
        width = [b[-1] - a[0] for a, b in zip(groups, groups[1:])]
        j = int(np.argmin(width))
        if width[j] > tol:
            break
        groups[j] += groups.pop(j + 1)
    return [i + 1 for i, g in enumerate(groups) for _ in g]


def test_families_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    x = {m: np.round(np.sort(rng.random(300) * w), 3) for m, w in (("m", 300), ("n", 12), ("o", 40))}
    df = spark.createDataFrame([(f"{m}{i % 3}", i, float(v), m) for m, vs in x.items() for i, v in enumerate(vs)], "series string, idx bigint, x double, modality string")
    order = lambda d: d.toPandas().sort_values(["x"], kind="stable").groupby("modality").family_id.apply(list).to_dict()
    for tol in (0.1, 0.5, 1.7):
        assert order(P.greedy_families(df, tol)) == {m: slow_greedy(v, tol) for m, v in x.items()}
        assert order(P.complete_linkage(df, tol)) == {m: slow_linkage(v, tol) for m, v in x.items()}
    each = order(P.complete_linkage(df, F.when(F.col("modality") == "n", 0.2).otherwise(1.0)))
    assert each == {m: slow_linkage(v, 0.2 if m == "n" else 1.0) for m, v in x.items()}


def test_many_peaks_of_one_modality(spark):
    n = 100_000
    df = spark.range(n).select(F.lit("s").alias("series"), F.col("id").alias("idx"), (F.col("id") * 0.001 + (F.col("id") % 7) * 0.0001).alias("x"), F.lit("m").alias("modality"))
    for f in (P.greedy_families, P.complete_linkage):
        assert f(df, 0.05).select("family_id").distinct().count() > 500


def test_complete_linkage_cut(spark):
    x = [0.0, 0.05, 0.11, 0.5, 0.56, 0.9]
    df = spark.createDataFrame([("s", i, v, "m") for i, v in enumerate(x)], "series string, idx bigint, x double, modality string")
    assert P.complete_linkage(df, 0.1).toPandas().sort_values("idx").family_id.tolist() == [1, 1, 2, 3, 3, 4]


def test_interpolation_matches_numpy(spark, curves):
    data, p = curves
    g = [(s, float(v)) for s in data for v in np.linspace(-1, 40, 60)]
    got = R.interpolate(spark.createDataFrame(g, "series string, gx double"), p, ["series"]).toPandas()
    pdf = p.toPandas().sort_values("idx")
    for s in data:
        c, q = pdf[pdf.series == s], got[got.series == s]
        assert np.allclose(q.gy, np.interp(q.gx, c.x, c.y))


def test_window_design_rules(spark):
    d = W.Design("d", 6, 4)
    df = spark.range(25).select(F.col("id").alias("rk"), (F.col("id") * F.col("id")).cast("double").alias("k"))
    got = W.window_table(df, [d], 25, {"s": F.col("k")}, "k").toPandas().sort_values("window_index")
    key = np.arange(25.0) ** 2
    assert len(got) == d.count(25) == 5  # full windows only, tail dropped
    for r in got.itertuples():
        part = key[r.start_rank : r.stop_rank]
        assert (r.parameter, r.position_min, r.position_max, r.s) == (np.median(part), part[0], part[-1], part.sum())
    assert W.Design("x", 300, 75).count(299) == 0 and W.PRIMARY.count(5050) == 47


def test_published_shift_arithmetic():
    lo, hi = B.admissible_offsets(47, 4)
    assert hi - lo + 1 == 40  # so p-values step in 1/41


def test_planted_lag_is_found(spark):
    n = 4000
    rng = np.random.default_rng(0)
    t = np.arange(n) / n
    bump = lambda c: np.exp(-(((t - c) / 0.04) ** 2))
    rows = [(i, float(t[i]), float(bump(0.35)[i] + 0.05 * rng.normal()), float(bump(0.30)[i] + 0.05 * rng.normal())) for i in range(n)]
    r = rank_rows(spark.createDataFrame(rows, "id bigint, clock double, a double, b double"), ["clock", "id"])
    s = B.strata(r, n, parts=20)
    prof = B.bootstrap_profiles(s, "clock", {"A": "a", "B": "b"}, W.PRIMARY, n, 10, 785)
    v = P.validation_peaks(prof).withColumn("modality", F.substring("series", 1, 1))
    tracked = P.track(v.where("material"), {"A": 0.35, "B": 0.30}, 0.04).withColumn("replicate", F.element_at(F.split("series", r"\|"), -1))
    lag = B.lags(tracked, "A", "B").toPandas()
    assert lag.paired.mean() == 1.0 and abs(lag.lag.median() - 0.05) < 0.02
    draws = [sorted(map(tuple, B.bootstrap(s, ["a"], 2, 785, n).collect())) for _ in range(2)]
    assert draws[0] == draws[1]


def test_tied_positions_exhaust_redraws(spark):
    n = 1000
    df = spark.range(n).select(F.col("id").alias("rk"), F.lit(1.0).alias("clock"), F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    with pytest.raises(RuntimeError):
        B.bootstrap_profiles(B.strata(df, n, parts=20), "clock", {"A": "a", "B": "b"}, W.PRIMARY, n, 2, 785, max_attempts=2)


def test_block_permutation_keeps_every_value(spark):
    df = spark.range(103).select(F.col("id").alias("idx"), F.col("id").cast("double").alias("v"))
    got = B.permute_blocks(df, "idx", "v", 103, 10, 4, 785).toPandas()
    for _, g in got.groupby("replicate"):
        assert sorted(g.idx) == list(range(103)) and sorted(g.v) == list(range(103))


def test_whole_curves_give_the_peaks_of_blocks(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s, n, levels in (("A|a|0", 700, 9), ("B|b|1", 333, 4), ("A|c|2", 60, 2), ("B|flat|3", 40, 1), ("A|d|4", 2, 5), ("B|e|5", 1, 5), ("A|f|6", 900, 10**6)):
        y = rng.integers(0, levels, n) / 8
        x = np.cumsum(rng.integers(1, 5, n)) / 4
        rows += [(s, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    p = spark.createDataFrame(rows, "series string, idx bigint, x double, y double").repartition(5).cache()
    for find in (P.discovery_peaks, P.validation_peaks):
        got, want = find(p).toPandas(), find(p, block=64, whole=0).toPandas()
        assert len(want) > 100 and frames_equal(got, want) is None
    # one shuffle, where the search by blocks writes and joins tables of all points
    assert P.validation_peaks(p, stored=False)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    grid = spark.range(60).selectExpr("id as g", "id * 20.25D - 30 as gx").crossJoin(p.select("series").distinct())
    read = lambda whole: R.interpolate(grid, p, ["series"], whole).select("series", "g", "gx", "gy").toPandas()
    assert frames_equal(read(1000), read(0)) is None


def test_curves_with_gaps_or_longer_ones_go_by_blocks(spark):
    rows = [("a", i, float(i), float(i % 7 % 4)) for i in range(50)]
    short = lambda r, whole=100: R.complete(spark.createDataFrame(r, "series string, idx bigint, x double, y double"), ["series"], whole)
    assert short(rows) and short(rows, 50) and not short(rows, 49)
    assert not short(rows[:20] + rows[21:])
    assert not short(rows[:20] + [("a", 20, 20.0, None)] + rows[21:])
    assert not short(rows[:20] + [("a", 20, float("nan"), 1.0)] + rows[21:])
