"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from duochron.llm import plans, substrings

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(rows, size=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = slow(docs)
    assert sum(r[2] for r in want) > 0
    assert got(plans.QUERIES["op1_substrings"](spark, sf)) == want


def test_odd_rows(spark):
    rng = random.Random(7)
    word = lambda: "w" + str(rng.randint(0, 10**6))
    common = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "few words here"), (None, " ".join(common[:34])), (6, "\x1c é \xa0 x")]
    rows += [(10 + i, " ".join([*(word() for _ in range(rng.randint(0, 60))), *common[rng.randint(0, 40) : rng.randint(60, 120)], *(word() for _ in range(30))])) for i in range(30)]
    near = [word() for _ in range(300)]
    for i in range(12):
        copy = list(near)
        copy[rng.randint(0, 299)] = word()
        rows.append((100 + i, "  ".join(copy)))
    rows += [(200, " ".join(common)), (200, " ".join(common)), (201, "buy " * 3000), (202, "a b " * 40), (203, " ".join(f"z{i % 40}" for i in range(200))), (204, " ".join(word() for _ in range(20000))), (205, " ".join(f"u{i}" for i in range(35))), (206, " ".join(f"u{i}" for i in range(35)))]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in rows], "doc_id bigint, text string, edge string, row int")
    assert got(substrings.dedup(df)) == slow(rows)
    out = substrings.dedup(df, texts=True).where("n_removed > 0").collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in out)
    assert substrings.dedup(df.limit(0)).count() == 0


def test_paths_do_not_branch(spark):
    """Two copies of one long text and a third that shares its middle: one path for each stretch."""
    rng = random.Random(2)
    a = [f"w{rng.randint(0, 10**6)}" for _ in range(600)]
    rows = [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join(["x"] * 50 + a[200:400] + ["y"] * 50))]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("id as row", "text")
    p = substrings.paths(substrings.repeated(substrings.edges(df, 35)), 35).collect()
    by = Counter(r.path for r in p)
    assert sum(n for n in by.values() if n > 5) >= 0.8 * len(p) and {r.copies for r in p if by[r.path] > 5} == {2, 3}
