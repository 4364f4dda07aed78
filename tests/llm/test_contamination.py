"""Benchmark hits against a word-by-word search."""

import hashlib
import re

import pytest
from duochron.llm import contamination, plans

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size=10):
    out = []
    wins = [(str(i), tuple(w[k : k + size])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - size + 1))]
    for d, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if w[k] == p[0] and tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    if i != "None":
                        ids.add(i)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = slow(docs, items)
    assert any(r[-1] for r in want)
    assert got(plans.QUERIES["op7_contamination"](spark, SF)) == want


ITEMS = [(1, "Alpha beta GAMMA"), (2, None), (3, "!!"), (10, " ".join(f"w{i}" for i in range(14))), (10, "beta gamma"), (None, "lonely"), (4, "été à la"), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
DOCS = [
    (1, "x alpha--beta, gamma alpha beta gamma."), (1, "x alpha--beta, gamma alpha beta gamma."), (2, None), (3, ""), (None, "Été à LA lonely"), (4, "alphabeta gamma"), (5, "W0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),
    (6, ("filler " * 30000) + "w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (7, "été à la"), (8, "w0 w1 w2 w3 w4 w5 w6 w7 w8 zz w9 w10 w11"),
]


@pytest.mark.parametrize("bound", [10**7, 40])
def test_odd_rows(spark, bound):
    d = spark.createDataFrame([(i, t, "z") for i, t in DOCS], "doc_id bigint, text string, n_words string")
    b = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, doc_id int")
    out = contamination.report(d, b, bound=bound)
    assert got(out) == slow(DOCS, ITEMS)
    text = dict(DOCS)
    for r in out.collect():
        for s in r.spans:
            part = next(t for i, t in DOCS if i == r.doc_id)[s.begin : s.end]
            assert split(part) == split(text[r.doc_id])[s.first : s.stop]
    assert got(contamination.report(d, b.limit(0))) == slow(DOCS, [])
    assert contamination.report(d.limit(0), b, bound=bound).count() == 0
    kept = contamination.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8]
