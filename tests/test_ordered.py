"""The distributed forms give the same as the plain ones, on tied and skewed keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duochron.operators import ordered as O, stats as T
from duochron.operators.intervals import nearest, sample_per_stratum
from duochron.functions.scalars import hash60


def col(df, by, name):
    return df.toPandas().sort_values(by)[name].tolist()


def hot(spark):
    # a third of the rows share one value and one group; another group is NULL
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 1, F.concat(F.lit("g"), (F.col("id") % 4).cast("string")))
    return spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 101).alias("v"), g.alias("g"))


@pytest.fixture(params=[3, 8])
def parts(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_rank_by_ranges(spark, parts):
    df = hot(spark)
    p = df.toPandas().sort_values(["v", "id"])
    p["g"] = p.g.fillna("~")
    for by in ([], ["g"]):
        got = O.rank_rows(df, ["v", "id"], by).toPandas().set_index("id").rk
        want = pd.Series(np.arange(3000), p.index) if not by else p.groupby("g").cumcount()
        assert (got[p.id].to_numpy() == want.to_numpy()).all() and len(got) == 3000


@pytest.mark.parametrize("block", [16, 1000, 16384])
def test_neighbors_and_running_in_blocks(spark, block):
    df = O.rank_rows(hot(spark), ["v", "id"], ["g"])
    p = df.toPandas().sort_values("rk")
    p["g"] = p.g.fillna("~")
    p["even"] = p.id.where(p.id % 2 == 0)
    near = O.neighbors(df, ["g"], "rk", ["id"], 2, block=block).toPandas().set_index("id")
    assert len(near) == 3000
    for c, k in (("prev_id", 2), ("next_id", -2)):
        assert near[c][p.id].fillna(-1).tolist() == p.groupby("g").id.shift(k).fillna(-1).tolist()
    want = {"s": ("sum", F.col("v")), "m": ("max", F.col("id")), "l": ("min", F.when(F.col("id") % 2 == 0, F.col("id")))}
    for rev in (False, True):
        got = O.running(df, ["g"], "rk", want, rev, block=block).toPandas().set_index("id")
        q = (p[::-1] if rev else p).groupby("g")
        ref = pd.DataFrame({"id": p[::-1].id if rev else p.id, "s": q.v.cumsum(), "m": q.id.cummax(), "l": q.even.cummin().groupby((p[::-1] if rev else p).g).ffill()})
        for c in want:
            assert got[c][ref.id].fillna(-1).tolist() == ref[c].fillna(-1).tolist(), (c, rev)


def test_quantiles_ranks_and_dominance(spark, parts):
    df = hot(spark).withColumn("x", F.col("v").cast("double"))
    p = df.toPandas()
    p["g"] = p.g.fillna("~")
    q = {"lo": 0.05, "mid": 0.5, "hi": 0.93}
    a = T.quantiles(df, ["g"], "x", q).toPandas()
    a["g"] = a.g.fillna("~")
    want = p.groupby("g").x.quantile(list(q.values())).unstack()
    assert len(a) == p.g.nunique() and np.allclose(a.sort_values("g")[list(q)], want.to_numpy())
    r = T.average_ranks(df, "x", ["g"]).toPandas()
    assert len(r) == 3000 and np.allclose(r["rank"], r.assign(g=r.g.fillna("~")).groupby("g")["x"].rank())
    assert T.spearman(df, "x", "id", ["g"]).count() == p.g.nunique() == T.group_summary(df, ["g"], "x").count()
    got = {(r.a, r.b): r.probability for r in T.dominance(df, "g", "x", ["g0", "g1", "hot"]).collect()}
    for (x, y), v in got.items():
        va, vb = p.x[p.g == x].to_numpy(), p.x[p.g == y].to_numpy()
        assert abs(v - (vb[:, None] > va[None, :]).mean()) < 1e-12


def test_upper_tails_against_exact_sums():
    from fractions import Fraction
    from math import comb

    def exact(a, b, c, d):
        n1, n2, k = a + b, c + d, a + c
        return float(Fraction(sum(comb(n1, x) * comb(n2, k - x) for x in range(a, min(n1, k) + 1)), comb(n1 + n2, k)))

    rng = np.random.default_rng(6)
    tables = [(0, 0, 0, 0), (0, 5, 3, 2), (5, 0, 0, 5), (1, 9, 9, 1), (300, 700, 500, 500), (500, 500, 300, 700), (3, 0, 2, 0)] + [tuple(rng.integers(0, 60, 4)) for _ in range(200)]
    got = T.upper_tails(*map(np.array, zip(*tables)))
    assert np.allclose(got, [exact(*map(int, t)) for t in tables], rtol=1e-9, atol=1e-300)
    assert T.upper_tails(*map(np.array, ([3000], [7000], [7000], [3000])))[0] == 1.0
    assert T.upper_tails(*map(np.array, ([7000], [3000], [3000], [7000])))[0] < 1e-200
    far = [(3, 10**10, 5, 10**10), (9, 10**10, 2, 10**10), (2, 10**10, 9, 3 * 10**9)]  # totals of 10^10
    assert np.allclose(T.upper_tails(*map(np.array, zip(*far))), [exact(*t) for t in far], rtol=1e-10, atol=0)
    half = 25 * 10**8
    p = T.upper_tails(*map(np.array, zip((half + 10**5, half - 10**5, half - 10**5, half + 10**5), (half, half, half, half))))
    assert np.allclose(p, [3.16739e-05, 0.500008], rtol=1e-5)  # as the normal limit has it


def test_flat_series_has_no_correlation(spark):
    df = spark.range(50).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert T.spearman(df, "x", "y").first()[0] is None


def test_partial_r2_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"bio": rng.integers(0, 4, 400), "tech": rng.integers(0, 3, 400), "dup": 0})
    p["dup"] = p["tech"] * 2  # rank deficient on purpose
    y = rng.normal(size=(400, 3)) + p["bio"].to_numpy()[:, None] + 0.5 * p["tech"].to_numpy()[:, None]
    p[["d1", "d2", "d3"]] = y
    got = T.partial_r2(spark.createDataFrame(p), ["d1", "d2", "d3"], ["bio"], ["tech", "dup"])

    def sse(cols):
        x = np.hstack([np.ones((400, 1))] + [pd.get_dummies(p[c].astype(str), drop_first=True, dtype=float) for c in cols])
        return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()

    full = sse(["bio", "tech", "dup"])
    assert abs(got["technical_partial_r2"] - (sse(["bio"]) - full) / sse(["bio"])) < 1e-9
    assert abs(got["biology_partial_r2"] - (sse(["tech", "dup"]) - full) / sse(["tech", "dup"])) < 1e-9


def test_fisher_and_bh(spark):
    rows = [(0, 3, 5, 1, 9), (1, 0, 5, 0, 5), (2, 5, 0, 0, 5), (3, 4, 4, 4, 4), (4, 8, 2, 1, 5)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int").withColumn("p", T.fisher_greater("a", "b", "c", "d"))
    import math

    for r in T.bh_adjust(df, "p", "id").collect():
        n1, n2, k = r.a + r.b, r.c + r.d, r.a + r.c
        want = sum(math.comb(n1, i) * math.comb(n2, k - i) for i in range(r.a, min(n1, k) + 1)) / math.comb(n1 + n2, k)
        assert abs(r.p - want) < 1e-12 and r.p <= r.fdr <= 1
    o = df.select("id", T.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("o")).toPandas().set_index("id")["o"]
    assert np.isinf(o[2]) and np.isnan(o[1])


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"g": rng.choice(["x", "y"], 60), "pos": rng.integers(0, 3_000_000, 60), "aid": range(60)})
    a.loc[1, ["g", "pos"]] = a.loc[0, ["g", "pos"]].to_numpy()  # duplicate anchor
    q = pd.DataFrame({"qid": range(500), "g": rng.choice(["x", "y", "none"], 500), "pos": rng.integers(0, 3_000_000, 500)})
    q.loc[q.index % 3 == 0, ["g", "pos"]] = ["x", 1_234_567]  # one position holds a third of the queries
    a = a.astype({"pos": "int64"})
    got = nearest(spark.createDataFrame(q), spark.createDataFrame(a), "g", "pos", ["aid"], ["aid"]).toPandas().set_index("qid")
    assert len(got) == 500
    for r in q.itertuples():
        c = a[a.g == r.g]
        if c.empty:
            assert got.loc[r.qid, "distance_class"] == "no_reference_chromosome"
            continue
        best = min(zip((c.pos - r.pos).abs(), c.pos, c.aid))
        assert (got.loc[r.qid, "distance"], got.loc[r.qid, "anchor_position"], got.loc[r.qid, "aid"]) == best


def test_stratified_sample_is_exact(spark):
    df = hot(spark)
    want = spark.createDataFrame([("hot", 137), ("g1", 5000), ("g2", 1)], "g string, n bigint")
    h = hash60(1, F.col("id"))
    got = sample_per_stratum(df, ["g"], h, "id", want).toPandas()
    p = df.withColumn("h", h).toPandas().sort_values(["h", "id"])
    for g, n in (("hot", 137), ("g1", 5000), ("g2", 1)):
        assert sorted(got.id[got.g == g]) == sorted(p.id[p.g == g][:n])
