import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.functions.draws import Hash60
from duochron.operators import resample as B, windows as W
from test_queries import frames_equal


def test_hashes_are_those_of_the_column_expression(spark):
    for first, last in ((0, 12), (995, 1003), (99_999, 100_001), (0, 20_000)):
        for parts in ((785, 0, 0), (20260920, 499, 24), (785, 7)):
            want = [int(hashlib.md5(":".join(map(str, (*parts, k))).encode()).hexdigest()[:15], 16) for k in range(first, last)]
            assert Hash60(first, last)(*parts).tolist() == want


def entities(spark, n):
    rng = np.random.default_rng(n)
    gap = lambda v, k, i: None if i % k == 3 else float(v)
    rows = [(i, None if i < 5 else float(i // 3), None if 100 <= i < 700 else float(rng.normal()), gap(rng.normal(), 7, i)) for i in range(n)]
    return spark.createDataFrame(rows, "rk bigint, clock double, a double, b double")


@pytest.mark.parametrize("parts", [None, 7])
def test_local_draws_are_the_drawn_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(B, "TILE", 256)
    n, d = 1733, W.Design("60/15", 60, 15)
    e = entities(spark, n)
    s = B.strata(e, n, size=None if parts else 40, parts=parts)
    rows = B.bootstrap(s, ["clock", "a", "b"], 3, 785, n).cache()
    want = rows.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("clock").alias("n_distinct"), F.round(F.sum("a"), 7).alias("sum_a"), F.round(F.sum(F.col("b") * F.col("pos")) / F.sum("pos"), 7).alias("weighted_b")
    )
    got = B.draw_totals(s, "clock", "a", "b", 3, 785).withColumns({c: F.round(c, 7) for c in ("sum_a", "weighted_b")})
    assert frames_equal(got.toPandas(), want.toPandas()) is None
    tidy = lambda p: p.select("series", "replicate", "modality", "idx", "x", F.round("y", 7).alias("y")).toPandas()
    want = W.mean_scores(rows, [d], n, {"A": "a", "B": "b"}, "clock", ["replicate"], "pos")
    got = B.replicate_profiles(B.replicate_windows(s, "clock", {"A": "a", "B": "b"}, d, n, 3, 785), ["A", "B"], d)
    assert frames_equal(tidy(got), tidy(want)) is None


@pytest.mark.parametrize("gaps", [True, False])
def test_moved_windows_are_those_of_moved_rows(spark, gaps):
    n, d = 733, W.Design("60/15", 60, 15)
    rng = np.random.default_rng(9)
    rows = [(i, None if gaps and 100 <= i < 300 else float(rng.normal()), float(i // 3 * 3 + i % 3)) for i in range(n)]
    e = spark.createDataFrame(rows, "rk bigint, b double, clock double")
    pieces = B.block_pieces(e, "rk", "b", n, 40, d).cache()
    rows = B.permute_blocks(e, "rk", "b", n, 40, 5, 785)
    want = W.window_table(rows, [d], n, {"s": F.col("b")}, None, ["replicate"]).select("replicate", F.col("window_index").alias("idx"), (F.col("s") / 60).alias("y")).cache()
    tidy = lambda p, *c: p.withColumns({k: F.round(k, 7) for k in c}).toPandas()
    got = B.moved_windows(pieces, "rk", "b", n, 40, d, 5, 785, cells=3)
    assert frames_equal(tidy(got, "y"), tidy(want, "y")) is None
    one = W.mean_scores(e.withColumn("a", F.col("rk") % 7), [d], n, {"A": "a", "B": "b"}).select("modality", "idx", "x", "y").cache()
    a = one.where("modality = 'A'")
    null = want.join(a.select("idx", "x"), "idx").select("replicate", F.lit("B").alias("modality"), "idx", "x", "y")
    same = a.crossJoin(spark.range(5).select(F.col("id").cast("int").alias("replicate"))).select("replicate", "modality", "idx", "x", "y")
    curves = null.unionByName(same).unionByName(one.select(F.lit(-1).alias("replicate"), "modality", "idx", "x", "y")).cache()
    cols = ("q50_a", "q50_b", "signed_gap", "absolute_gap", "spearman_rho", "js_distance")
    wanted = B.grid_alignment(curves, "replicate", "A", "B", 100.0, 600.0, 50)
    found = B.moved_grid_alignment(one, pieces, "rk", "b", n, 40, d, 5, 785, "A", "B", 100.0, 600.0, 50)
    assert found.columns == wanted.columns and frames_equal(tidy(found, *cols), tidy(wanted, *cols)) is None


def test_moved_curves_are_measured_like_rows(spark):
    n = 61
    rng = np.random.default_rng(5)
    eighths = lambda: round(float(rng.normal()) * 8) / 8  # their sums are exact in any order, also at half the mass
    rows = [(i, float(i), None if i == 9 else eighths(), None if i in (20, 44) else eighths()) for i in range(n)]
    curve = spark.createDataFrame(rows, "idx bigint, x double, a double, b double")
    inside = curve.where("x between 10 and 50").drop("b")
    lo, hi = B.admissible_offsets(n, 4)
    shifted = B.circular_shifts(curve, "b", n, 4).withColumnRenamed("offset", "k")
    permuted = B.permute_blocks(curve, "idx", "b", n, 4, 20, 785).withColumnRenamed("replicate", "k")
    tidy = lambda m: m.select("k", *[F.round(c, 9).alias(c) for c in B.ALIGNED]).toPandas()
    for moved, keys, sources in ((shifted, range(lo, hi + 1), B.shift_sources(n)), (permuted, range(20), B.block_sources(n, 4, 785))):
        want = B.alignment(inside.join(moved, "idx").select("k", "idx", "x", "a", "b").cache(), "k")
        assert frames_equal(tidy(B.moved_alignment(curve, "k", keys, sources, 10.0, 50.0)), tidy(want)) is None
