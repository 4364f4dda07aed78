"""The attention classifier: gradients, held-out accuracy, and what it attends to."""

import zlib

import numpy as np
from duochron.llm import mil, plans

SF = "/root/testdata/sf0.01"


def test_gradient():
    r = np.random.default_rng(1)
    m = mil.Model()
    x, starts, y = r.normal(size=(9, mil.N_FEATURES)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    g = m.gradient(x, starts, y)

    def loss():
        p = m.forward(x, starts)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, w in m.w.items():
        flat = w.reshape(-1)
        for i in r.choice(flat.size, min(5, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - g[k].reshape(-1)[i]) < 1e-6


def test_attention_finds_the_passage():
    """Bags are bad if one of many passages is; the weight must go there."""
    r = np.random.default_rng(2)
    bags, labels = [], []
    for i in range(400):
        b = r.normal(0, 1, (12, mil.N_FEATURES)).astype(np.float32)
        b[:, 0] = 0
        if i % 2:
            b[i % 12, 0] = 4
        bags.append(b)
        labels.append(1 - i % 2)
    m = mil.Model().fit(bags[:300], labels[:300])
    got = (m.score(bags[300:]) >= 0.5).astype(int)
    assert (got == labels[300:]).mean() > 0.95
    alpha = m.forward(bags[301], np.array([0]))[1][4]
    assert alpha.argmax() == 301 % 12


def test_held_out(spark):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = plans.QUERIES["op4_mil"](spark, SF).collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) >= 0.95
    bad = [r for r in held if label[r.doc_id] == 0]
    assert np.mean([r.predicted == 0 for r in bad]) >= 0.8
    again = {r.doc_id: r.score for r in plans.QUERIES["op4_mil"](spark, SF).collect()}
    assert again == {r.doc_id: r.score for r in out}


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (None, "word"), (4, "x" * 100000), (5, "a " * 100000), (6, "é \xa0 ü|")]
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id bigint, text string, score double, label int")
    labels = spark.createDataFrame([(4, 1, "a"), (4, 1, "b"), (5, 0, "c"), (6, None, "d"), (None, 1, "e"), (2, 1, "f"), (2, 0, "g"), (77, 1, "h")], "doc_id bigint, quality int, id string")
    out = mil.report(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[1] == by[2] == by[3]
    assert {r.score for r in mil.report(df, labels.limit(0)).collect()} == {0.5}
    assert mil.report(df.limit(0), labels).count() == 0
    p = mil.passages(b"one two " * 40)
    assert p.shape == (2, mil.N_FEATURES) and np.allclose(p[1][9], 2 / 16)
