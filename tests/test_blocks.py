"""Eigenvectors over blocks of rows: same as dense ones, with few jobs and nothing left behind."""

import os

import numpy as np
import pytest

from duochron.operators import blocks as B, clock as C, knn as K
from duochron.session import checkpoint_folder, materialize


def graph(spark, n=260, seed=31):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + rng.integers(0, 2, n)[:, None]
    ids = 7 * np.arange(n) + 100
    df = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x)], "id bigint, v array<double>")
    t = materialize(C.transitions(C.gauss_graph(K.knn(df, "id", "v", 9))))
    p = t.toPandas()
    dense = np.zeros((n, n))
    dense[(p.src - 100) // 7, (p.dst - 100) // 7] = p.t
    return t, dense


@pytest.mark.parametrize("rows", [B.ROWS_A_BLOCK, 40])
def test_vectors_of_one_and_of_many_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(B, "ROWS_A_BLOCK", rows), monkeypatch.setattr(B, "EDGES_AT_ONCE", 50)
    t, dense = graph(spark)
    left = lambda: {f for f in os.listdir(checkpoint_folder(spark).removeprefix("file:")) if f.startswith("blocks-")}
    before = left()
    got, psi = C.leading_vectors(t, 6, 785, residual=1e-7)
    assert np.allclose(got, np.sort(np.linalg.eigvalsh(dense))[::-1][:6], atol=1e-9)
    v = psi.toPandas().sort_values("v")
    assert v["v"].tolist() == [7 * i + 100 for i in range(260)]
    x = np.stack(v["psi"].to_numpy())
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-8 and np.linalg.norm(dense @ x - x * got, axis=0).max() < 2e-7
    with pytest.raises(RuntimeError, match="residuals"):
        C.leading_vectors(t, 6, 785, steps=2, residual=1e-300, cycles=2)
    assert left() == before


def test_a_graph_of_one_block_takes_few_jobs(spark):
    t, _ = graph(spark)
    spark.sparkContext.setJobGroup("blocks", "eigenvectors")
    try:
        C.leading_vectors(t, 6, 785)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("blocks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) < 40


def test_a_clock_takes_the_components_it_is_given(spark):
    rng = np.random.default_rng(32)
    x = np.concatenate((rng.normal(size=(80, 2)), rng.normal(size=(30, 2)) + 90))
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    near = materialize(K.knn(df, "id", "v", 7))
    parts = materialize(K.components(near, df, "id"))
    one, two = (C.diffusion_clock(df, "id", "v", 0, 8, 6, 5, edges=near, parts=p).toPandas().sort_values("id") for p in (None, parts))
    assert one.component.tolist() == two.component.tolist() and set(one.component) == {0, 80}
    assert np.array_equal(one.clock.isna(), two.clock.isna()) and np.allclose(one.clock.fillna(0), two.clock.fillna(0))
