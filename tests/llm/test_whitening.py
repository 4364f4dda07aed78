"""Whitening against dense eigenvectors of the covariance, and factors of singular tables."""

import math

import numpy as np
import pytest
from duochron.llm import plans, whitening

SF = "/root/testdata/sf0.01"
COLS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def integers(v):
    return [math.floor(1024 * c) + 100_000 for c in v]


def held_against_dense(got, rows, k=8):
    x = np.array([integers(v) for _, v in rows], object)
    n, total = len(x), x.sum(0)
    c = (n * x - total).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > e[0] * 1e-20).sum()))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == n * k and sorted(by) == sorted(i for i, _ in rows)
    for j in range(k):
        mine = np.array([by[i][j + 1].whitened for i, _ in rows])
        want = c @ v[:, j] / math.sqrt(e[j])
        mine = mine * np.sign(mine @ want)
        assert np.abs(mine - want).max() < 1e-6 * max(1, np.abs(want).max())
    for (i, _), row in zip(rows, x):
        r = by[i][1]
        assert (r.n, r.deviation) == (n, sum((n * a - b) ** 2 for a, b in zip(row, total)))
        assert abs(r.explained - e[0] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = plans.QUERIES["op11_whitening"](spark, SF)
    assert df.columns == COLS and df.schema["deviation"].dataType.simpleString() == "bigint"
    held_against_dense(df.collect(), rows)


@pytest.mark.parametrize("n,d", [(200, 1), (200, 40), (1000, 70)])
def test_solved(n, d):
    rng = np.random.default_rng(d)
    x, r = rng.normal(size=(n, d)), np.triu(rng.normal(size=(d, d))) + 4 * np.eye(d)
    assert np.allclose(whitening.solved(x, r) @ r, x)


def test_small_extents_survive(spark):
    """A direction whose variance is 1e-15 of the largest is lost in X'X but not here."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    x = (rng.normal(size=(400, 5)) * [3e7, 1e7, 1e3, 30, 5]) @ turn.T
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    c = whitening.fit(spark.createDataFrame(rows, "vec_id bigint, v array<double>"), "v")
    y = np.array([integers(v) for _, v in rows], float)
    s = np.linalg.svd(y - y.mean(0), compute_uv=False)
    assert np.allclose(np.sqrt(c.variances * 400), s, rtol=1e-7) and len(c.factors) >= 2


def test_odd_rows(spark):
    rng = np.random.default_rng(11)
    good = [(i, v) for i, v in enumerate((rng.normal(size=(60, 4)) @ rng.normal(size=(4, 12))).tolist())]  # rank near 4
    good = [(i, [*v[:11], 0.25]) for i, v in good]  # and one entry that never changes
    bad = [(100, None), (101, [None] + [1.0] * 11), (102, [math.nan] * 12), (103, [math.inf] * 12), (104, []), (105, [1.0, 2.0])]
    schema = "vec_id bigint, v array<double>, n string, component string, id int"
    df = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in good + bad], schema)
    got = whitening.whitened(df, "vec_id", "v")
    assert got.columns == COLS
    held_against_dense(got.collect(), good)
    few = [(i, [float(i % 3), float(i // 3), 1.0]) for i in range(9)] + [(None, [1.0, 1.0, 1.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, "x", "y", 1) for i, v in few + few[:1]], schema), "vec_id", "v").collect()
    assert len(got) == 11 * 2 and {r.component for r in got} == {1, 2} and sum(r.vec_id is None for r in got) == 2
    for rows in ([], good[:1], good[:1] * 5, bad):
        assert whitening.whitened(spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], schema), "vec_id", "v").count() == 0
    far = whitening.whitened(spark.createDataFrame([(i, [v * 1e15, 1.0], "x", "y", 1) for i, v in enumerate([1.0, 2.0, 4.0])], schema), "vec_id", "v").collect()
    assert [r.component for r in far] == [1, 1, 1] and all(r.deviation == (3 * a - 7) ** 2 * (1024 * 10**15) ** 2 for r, a in zip(sorted(far, key=lambda r: r.vec_id), (1, 2, 4)))
