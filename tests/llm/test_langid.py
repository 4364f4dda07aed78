"""The conditional random field: marginals by enumeration, held-out accuracy, code-switched words."""

import zlib
from itertools import product

import numpy as np
import pytest
from duochron.llm import langid, plans

SF = "/root/testdata/sf0.01"


def enumerate_all(e, trans, start):
    t, n = e.shape
    post, pairs = np.zeros((t, n)), np.zeros((n, n))
    z = 0.0
    for path in product(range(n), repeat=t):
        p = start[path[0]] * np.prod([e[i, y] for i, y in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
        z += p
        for i, y in enumerate(path):
            post[i, y] += p
        for a, b in zip(path, path[1:]):
            pairs[a, b] += p
    return post / z, pairs / z


def test_forward_backward():
    r = np.random.default_rng(1)
    e, trans, start = r.random((3, 5, 3)), r.random((3, 3)), np.full(3, 1 / 3)
    post, pairs = langid.forward_backward(e, trans, start)
    want = [enumerate_all(x, trans, start) for x in e]
    assert np.allclose(post, [w[0] for w in want]) and np.allclose(pairs, sum(w[1] for w in want))


@pytest.mark.parametrize("block", [2, 3, 128])
def test_blocks(monkeypatch, block):
    """Messages through block matrices equal one pass over each text."""
    monkeypatch.setattr(langid, "BLOCK", block)
    r = np.random.default_rng(2)
    f = langid.Field(["a", "b", "c"])
    f.weights[:] = r.normal(size=f.weights.shape)
    docs = [["".join(r.choice(list("abcde"), 3)) for _ in range(k)] for k in (1, 7, 2, 3, 6, 4)]
    for d, post in zip(docs, f.posteriors(docs)):
        e = f.emissions(d).astype(float)
        trans = np.exp(f.trans)
        want, _ = enumerate_all(e, trans, np.full(3, 1 / 3) @ trans)
        assert np.allclose(post, want, atol=1e-4)


def test_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = plans.QUERIES["op6_langid"](spark, SF).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) >= 0.97


def test_code_switching(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 600").collect()]
    en, de = ([langid.words_of(t) for _, t, g in rows if g == lang] for lang in ("en", "de"))
    f = langid.Field(["de", "en"]).fit(en[20:120] + de[20:80], ["en"] * 100 + ["de"] * 60)
    mixed = [w for a, b in zip(en[:10], de[:10]) for w in a[:20] + b[:20]]
    truth = ([1] * 20 + [0] * 20) * 10
    assert (f.posteriors([mixed])[0].argmax(axis=1) == truth).mean() > 0.93


def test_odd_rows(spark):
    texts = [None, "", " 12 ½ ² _ !", "the of and to in", "der die und", "é", "the " * 60000, "日本語", "the of and", "the of and"]
    rows = [(None if i == 4 else i // 9 * 9 if i > 7 else i, t, None if i == 5 else "en" if "the" in (t or "") else "de", 0.1, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, runs string")
    out = langid.report(df).collect()
    assert len(out) == len(rows) and sum(r.lang_pred == "und" for r in out) == 3
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in out)
    none = df.select("doc_id", "text", df.score.cast("string").alias("lang")).selectExpr("doc_id", "text", "nullif(lang, lang) as lang")
    assert {r.lang_pred for r in langid.report(none).collect()} == {"und"}
    assert langid.report(df.limit(0)).count() == 0


def test_rare_language(spark):
    """A language with under one row in a hundred is learned; too many labels are refused, not cut."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200")
    es = docs.where("lang = 'es'").orderBy("doc_id").limit(6)
    some = docs.where("lang <> 'es'").unionByName(es)
    assert 6 * 100 < some.count()
    field = langid.train(some, "doc_id", "text", "lang")
    assert field.langs == ["de", "en", "es", "fr"]
    rest = docs.where("lang = 'es'").join(es.select("doc_id"), "doc_id", "left_anti")
    out = langid.labelled(rest, ["doc_id"], "text", field).collect()
    assert np.mean([r.lang_pred == "es" for r in out]) >= 0.9
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(i, "a b", f"l{i}") for i in range(langid.LABELS + 1)], "doc_id int, text string, lang string"), "doc_id", "text", "lang")
