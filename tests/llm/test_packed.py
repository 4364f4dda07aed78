"""Packed token files: exact round trips against the tokenizers library."""

import zlib

import numpy as np
import pytest
from duochron.llm import packed, plans
from duochron.llm.common import shared_folder
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = plans.tokenizer_file("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a  b", "a   b\n\n c", " lead", "trail ", "x\n", "\nx", "tab\tq z  w", "it's 'll we'd", "<|endoftext|> a<|endoftext|>", "nul\0nul b", "é ñ 日本 🙂 \x1c u\x1f v\x85", "a \nb\n c", "word " * 40000, "\r\n\r\n x \r y", "y\x0b z",
]


def ids_of(texts, end=0):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], np.uint32) for x in texts]


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
def test_pack_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64)
        data = packed.pack(ids, width)
        assert len(data) == -(-n * width // 8)
        assert (packed.unpack(data, width, 0, n) == ids).all()
        for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2)):
            assert (packed.unpack(data, width, a, b) == ids[a:b]).all()
    assert packed.bits_for(50256) == 16 and packed.bits_for(0) == 1


def expect(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, start = [], 0
    for (i, _), ids in zip(order, ids_of([t for _, t in order])):
        out.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(plans.QUERIES["op10_packed"](spark, SF)) == expect(docs)


@pytest.mark.parametrize("known,block", [(400_000, 1 << 17), (4, 30)])
def test_odd_rows(spark, known, block, monkeypatch):
    enc = packed.Encoder(PATH)
    monkeypatch.setattr(packed, "KNOWN", known)
    for texts in (ODD, ODD[::-1], ["a b", "c d e", "a b f"] * 3):
        assert [x.tolist() for x in enc.batch(texts)] == [x[:-1].tolist() for x in ids_of(texts)]
    monkeypatch.undo()
    rows = [(i * 7 % 19, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, payload string, shard int")
    to = shared_folder(spark, "test")
    packed.write(df, to, PATH)
    assert got(packed.documents(spark, to)) == expect(rows)
    flat = np.concatenate(ids_of([t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]))
    part = packed.ids_between(spark, to, 40, 300).orderBy("position").collect()
    assert [r.id for r in part] == flat[40:300].tolist() and part[0].position == 40
    empty = shared_folder(spark, "test")
    packed.write(df.limit(0), empty, PATH)
    assert packed.documents(spark, empty).count() == 0
