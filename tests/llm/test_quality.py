"""Quality measures and distances against plain Python, and what the verdict does to labelled texts."""

import math
import re
from collections import Counter

from duochron.llm import plans, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def row(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_whole_table(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = plans.QUERIES["op3_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        assert row(r) == base(docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    good = [r for r in out if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in out if label.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = [3, 0, 5, 2], [1, 1, 6, 0]
    a, b = [x / 10 for x in p], [x / 8 for x in q]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    want = math.sqrt(sum((x * math.log2(x / z) if x else 0) + (y * math.log2(y / z) if y else 0) for x, y, z in zip(a, b, m)) / 2)
    df = spark.createDataFrame([(p,), ([0, 0, 0, 0],)], "c array<bigint>")
    got = [r[0] for r in df.select(quality.distance("c", F.array(*(F.lit(x) for x in b)))).collect()]
    assert abs(got[0] - want) < 1e-12 and got[1] is None


def test_odd_rows(spark):
    plain = " ".join(f"the word{i} of{i % 7} and in" for i in range(40))
    rows = [
        (1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, plain, "en"), (4, plain, "en"), (5, plain, None), (None, "one two", "xx"), (6, "ab\nab\n ab\n\nab\r", "en"),
        (7, "same " * 40000, "en"), (8, "| $ % " * 30 + " ".join(f"#{i}%" for i in range(60)), "en"), (9, "été là \x1c q", "fr"),
    ]
    df = spark.createDataFrame([(i, t, g, True, "x") for i, t, g in rows], "doc_id bigint, text string, lang string, kept boolean, chars string")
    out = quality.report(df).collect()
    assert sorted((str(r.doc_id), row(r)) for r in out) == sorted((str(i), base(t)) for i, t, _ in rows)
    assert {r.doc_id for r in out if r.kept} == {4, 5} and sum(r.kept for r in out) == 3
    kept = quality.clean(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 5]
    assert quality.report(df.limit(0)).count() == 0
    assert quality.report(df.where("doc_id < 3")).where("kept").count() == 0


def test_rare_and_unnamed_languages(spark):
    """A language with under one row in a hundred, or none, loses no more than a common one."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bad = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 0").select("doc_id")
    good = docs.join(bad, "doc_id", "left_anti").where(F.size(F.split("text", r"\s+")) >= 60)
    whole = quality.report(good).where("kept").select("doc_id")
    es = good.where("lang = 'es'").join(whole, "doc_id", "left_semi").orderBy("doc_id").limit(4)
    some = es.unionByName(good.where("lang <> 'es'")).unionByName(good.where("lang = 'es'").orderBy(F.desc("doc_id")).limit(3).withColumn("lang", F.lit("rare")))
    out = {r.doc_id: r for r in quality.report(some).collect()}
    rare = [out[r.doc_id] for r in es.collect()]
    assert len(rare) * 100 < len(out) and len(rare) == 4 and all(r.kept for r in rare)
    unnamed = good.withColumn("lang", F.when(F.col("doc_id") % 10 > 0, F.col("lang")))
    got = {r.doc_id: r for r in quality.report(unnamed).collect()}
    for g in ("en", "fr", "de", "es"):
        mine = [got[r.doc_id] for r in good.where(F.col("lang") == g).where("doc_id % 10 = 0").collect() if not got[r.doc_id].base_failed]
        assert len(mine) > 3 and sum(r.kept for r in mine) >= 0.8 * len(mine), g
