"""The pipeline against a brute-force version of its stages, on tables with planted cases."""

import hashlib
import struct

import corpus_pipeline
from duochron.llm import bpe, contamination, plans, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


def slow(docs, items, kept_by_quality):
    """Documents by id, stage by stage; the language references are quality's own."""
    docs = {i: t for i, t in docs.items() if i in kept_by_quality}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in docs.items()}
    of = {i: i for i in docs}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((top(a), top(b)))
                of[y] = x
    docs = {i: t for i, t in docs.items() if top(i) == i}
    wins = [" " + " ".join(w.decode() for w in ws[k : k + 10]) + " " for t in items for ws in [contamination.words(t.encode())] for k in range(max(1, len(ws) - 9))]
    lined = {i: " " + " ".join(w.decode() for w in contamination.words(t.encode())) + " " for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if not any(w in lined[i] for w in wins)}
    out = {}
    for i, t in docs.items():
        for a, b, k in reversed(secrets.scan_text(t)[1]):
            t = t[:a] + f"[{secrets.KINDS[k]}]" + t[b:]
        out[i] = t
    return out


def test_run(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in plans.QUERIES["op3_quality"](spark, SF).where("kept").collect()}
    want = slow({r.doc_id: r.text for r in rows}, items, kept)
    c = bpe.Codec(plans.tokenizer_file("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(want) < len(kept) < len(rows)
    got = {r.doc_id: (r.n_tokens, " ".join(map(str, struct.unpack(f"<{len(r.ids) // 2}H", r.ids))), r.decoded_sha256) for r in out}
    expect = {}
    for i, t in want.items():
        a, b = c.both(t.encode())
        expect[i] = (len(a.split()), a, hashlib.sha256(b.encode()).hexdigest())
    assert got == expect


def test_stages_keep_columns_and_take_odd_rows(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "bpe_tokens"]
    plain = " ".join(f"the word{i} of{i % 7} and in" for i in range(40))
    rows = [(1, plain, "en", "s", 9), (1, plain, "en", "s", 9), (None, plain + " token=abcdefghij", "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, "long " * 60000, "xx", "s", 1)]
    df = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (df, df.limit(0)):
            out = stage(spark, d, SF)
            assert out.dtypes == d.dtypes, name
            out.count()
    one = corpus_pipeline.near_dedup(spark, df, SF).collect()
    assert sorted((r.doc_id or -1) for r in one) == [1, 3, 5]
    masked = corpus_pipeline.secret_scan(spark, df, SF).collect()
    assert len(masked) == 6 and any(r.text and r.text.endswith("[assign]") and r.n_chars == len(r.text) for r in masked)
    assert corpus_pipeline.tokens(spark, df, SF).count() == 6 and corpus_pipeline.tokens(spark, df.limit(0), SF).count() == 0
