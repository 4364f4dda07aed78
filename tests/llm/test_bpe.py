"""The merge automaton against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from duochron.llm import bpe, common, plans
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PATH = plans.tokenizer_file("word_bpe_49k.json")
ODD = [
    "a" * 33, "it's we'll'd don't I'M", "a<|endoftext|>b<|startoftext|>", "İstanbul ΣΑΣ ﬁ é\xa0x y\x1cz\x85w", "日本語テキスト 🙂🙂👍🏽", "१२३ ½ 12345", "", "   ", "!!!???...###$$$%%%", "x" * 3000,
    "́a ́", "<|ENDOFTEXT|>", "<|endoftext|", "\0a\0", "s's's're're", "'s 's\n'tis\r\n\x0b\x0c'",
]


def want(texts):
    t = Tokenizer.from_file(PATH)
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return [(" ".join(map(str, i)), t.decode(i, skip_special_tokens=False)) for i in ids]


def test_odd_and_random_texts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abehinortu' sx1!é") for _ in range(rng.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(32, 0x24F)])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    c = bpe.Codec(PATH)
    assert [c.both(t.encode()) for t in texts] == want(texts)


def test_gadgets_accept_what_merging_makes():
    """All words over two letters, every token sequence: accepted exactly if merging makes it."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "aa"), ("b", "a"), ("ab", "ba"), ("aa", "ab")]
    vocab = {t: i for i, t in enumerate(["a", "b", *(u + v for u, v in merges)])}
    auto = bpe.Automaton(vocab, merges)

    def merged(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return parts

    for n in range(1, 5):
        for seq in product(vocab, repeat=n):
            accepted = all(auto.step(vocab[x], vocab[y]) for x, y in zip(seq, seq[1:]))
            assert accepted == (merged("".join(seq)) == list(seq)), seq


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expect = {d.doc_id: (len(i.split()), sha(i), sha(t)) for d, (i, t) in zip(docs, want([d.text for d in docs]))}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in plans.QUERIES["op8_bpe"](spark, SF).collect()}
    assert got == expect


@pytest.mark.parametrize("size", [400_000, 3])
def test_odd_rows(spark, size, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_SIZE", size)
    texts = [None, *ODD, "long " * 50000, None, *ODD[:4]]
    df = spark.createDataFrame([(None if i == 3 else i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, decoded string")
    full = bpe.coded(df.select("doc_id", "text"), ["doc_id"], "text", PATH).collect()
    plain = lambda b: " ".join(map(str, struct.unpack(f"<{len(b) // 2}H", b)))
    assert all(r.n_tokens == len(r.ids) // 2 for r in full)
    assert sorted((str(r.doc_id), plain(r.ids), r.decoded) for r in full) == sorted((str(None if i == 3 else i), *w) for i, w in enumerate(want(texts)))
    assert bpe.report(df, PATH).count() == len(texts) and bpe.report(df.limit(0), PATH).count() == 0
    c = bpe.Codec(PATH)
    assert [c.both((t or "").encode()) for t in texts] == want(texts)


def test_small_tables_stay_small_and_change_nothing():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abehinortu'1!") for _ in range(rng.randint(2, 9))) for _ in range(400)) for _ in range(20)] + ODD
    c = bpe.Codec(PATH, 100)
    assert [c.both(t.encode()) for t in texts] == want(texts)
    sizes = [len(t.young) + len(t.old) for t in (c.chunks, c.known)] + [len(c.automaton.table), len(c.goes)]
    assert max(sizes) <= 100 and min(sizes) > 0
    common._KEPT["other"] = object()
    assert bpe.codec(PATH, 100) is bpe.codec(PATH, 100) and "other" not in common._KEPT
