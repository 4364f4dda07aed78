"""The quality grid's silhouettes, ratio and classes against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.operators import knn as K, representation as R
from duochron.plans import graphs


def silhouette(x, labels):
    """Plain distances, pair by pair; labels of one row and rows without a label are left out."""
    held = [i for i, l in enumerate(labels) if l is not None and labels.count(l) >= 2]
    x, lab = x[held], np.array([labels[i] for i in held])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i, l in enumerate(lab):
        a = d[i, lab == l].sum() / ((lab == l).sum() - 1)
        b = min(d[i, lab == o].mean() for o in set(lab) - {l})
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(s)


def test_plain_silhouettes_of_all_rows(spark):
    rng = np.random.default_rng(21)
    n = 90
    x = rng.normal(size=(n, 4)) + rng.integers(0, 3, n)[:, None] * 2 + 100.0
    x[::7] = x[0]  # copies at distance zero
    g = [*rng.choice(["a", "b", "c"], n - 2), None, "alone"]
    h = [int(i) for i in rng.integers(0, 2, n)]
    df = spark.createDataFrame([([float(c) for c in r], a, b) for r, a, b in zip(x, g, h)], "v array<double>, g string, h int")
    for chunk in (K.ROWS_PER_CHUNK, 5):  # one unit of work, and many
        got = K.plain_silhouettes(df, "v", ["g", "h"], rows_per_chunk=chunk)
        assert got["g"] == pytest.approx(silhouette(x, g), abs=1e-9) and got["h"] == pytest.approx(silhouette(x, h), abs=1e-9)
    assert K.plain_silhouettes(df.where("g = 'a'"), "v", ["g"]) == {"g": None}
    holes = spark.createDataFrame([([1.0, None, 0.0, 0.0], "a", 0), (None, "b", 1), ([float("nan")] * 4, "c", 1)], df.schema)
    more = K.plain_silhouettes(df.unionByName(holes), "v", ["g", "h"])
    assert more["g"] == pytest.approx(silhouette(x, g), abs=1e-9) and more["h"] == pytest.approx(silhouette(x, h), abs=1e-9)


def test_classes_of_measures_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.01, 0.2, 0.8), (0.0, 0.2, 0.8), (0.06, 0.2, 0.6), (0.09, 0.2, 0.5), (0.2, 0.9, 0.9), (0.01, nan, 0.8), (nan, 0.2, 0.8), (0.01, 0.2, nan), (0.01, 0.2, None), (0.0, 0.0, 0.8)]
    t, b, m = F.col("t"), F.col("b"), F.col("m")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t double, b double, m double").withColumn("ratio", R.biology_ratio(t, b))
    got = df.select("i", "ratio", R.qc_label(t, b, m).alias("qc"), R.qc_class(t, F.col("ratio"), m).alias("c")).orderBy("i").collect()
    assert got[0].ratio == pytest.approx(20) and [got[i].ratio for i in (1, 6, 9)] == [inf, inf, inf]
    assert [r.c for r in got] == ["STRONG", "STRONG", "ACCEPTABLE", "CAUTION", "REVIEW", "REVIEW", "REVIEW", "REVIEW", "REVIEW", "STRONG"]
    assert [r.qc for r in got] == ["PASS", "PASS", "WARN", "WARN", "REVIEW", "REVIEW", "REVIEW", "REVIEW", "REVIEW", "REVIEW"]


def test_grid_has_silhouettes_and_survives_a_batch_that_explains_nothing(spark, tmp_path):
    rng = np.random.default_rng(22)
    rows = [(3 * i, int(i % 3), [float(c) for c in rng.normal(size=64) + (i % 3)]) for i in range(60)]  # ids of one batch
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = graphs.representation_grid(spark, str(tmp_path)).collect()
    assert len(got) == 4
    x = np.array([r[2] for r in rows], np.float32).astype(float)
    for r in got:
        z = x[:, :32] if r.modality == "A" else x[:, 32:]
        z = z[:, : r.dimensions]
        z = (z - z.mean(0)) / z.std(0)
        assert r.label_silhouette == pytest.approx(silhouette(z, [q[1] for q in rows]), abs=2e-6)
        assert r.batch_silhouette is None and r.technical_partial_r2 == 0 and r.biology_to_technical_ratio == float("inf") and r.qc_class == "REVIEW"
