"""Exact top-k search against brute force in Python's integers."""

import math

import numpy as np
import pytest
from duochron.llm import plans, topk
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
LONG = (1 << 63) - 1


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-(1 << 63), min(LONG, math.floor(1024 * x))) for x in v]


def brute(rows, every, k):
    known = [(i, e) for i, v in rows if (e := whole(v)) is not None]
    out = []
    for qi, q in known:
        if qi is None or qi % every:
            continue
        scored = [(-max(-(1 << 63), min(LONG, sum(a * b for a, b in zip(q, e)))), i is None, i or 0) for i, e in known if i != qi and len(e) == len(q)]
        out += [(qi, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert got(plans.QUERIES["op13_topk"](spark, SF)) == brute(rows, 100, 10)


@pytest.mark.parametrize("block,few", [(4, 1.0), (4, 0.0), (128, 1 / 16)])
def test_kernel(block, few, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FEW", few)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(9, 24)) * 300
    x = np.floor(centres[rng.integers(0, 9, 700)] + rng.normal(size=(700, 24)) * 20).astype(np.int64)
    x[50:90] = x[3]  # a hot vector: ties go to the smaller id
    ids = rng.permutation(700)
    q, own = x[::20], ids[::20]
    want = []
    for a, i in zip(q, own):
        s = x @ a
        want.append([(int(s[j]), int(ids[j])) for j in np.lexsort((ids, -s)) if ids[j] != i][:10])
    for least in (np.full(len(q), -np.inf, object), np.array([w[-1][0] for w in want], object)):
        who, found, score = topk.search(topk.Shard(ids, x), own, q, least, 10)
        for n, w in enumerate(want):
            assert sorted(zip((-score[who == n]).tolist(), found[who == n].tolist())) == [(-s, i) for s, i in w]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 5)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(40)]
    rows += [(i, [0.5, 0.25, -1.0]) for i in range(60, 80)]  # ties
    rows += [(10, rows[10][1]), (20, [0.5, 0.25, -1.0]), (None, [0.5, 0.25, -1.0])]  # repeated ids, no id
    rows += [(101, None), (100, [1.0, None, 2.0]), (110, [math.nan, 0.0, 0.0]), (120, [math.inf, 0.0, 0.0])]
    rows += [(130, []), (131, []), (140, [1.0] * 5), (141, [2.0] * 5), (150, [1e300, -1e300, 3.0]), (151, [1e15, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, part int, is_query string, score double")
    assert got(topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0, 3)) == brute(rows, 10, 3)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 10 == 0).count() == 0
    assert topk.top_k(df, "vec_id", "embedding", F.lit(False)).count() == 0
