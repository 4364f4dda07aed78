"""Merkle manifest: plain trees per language, plain proofs, and multiproofs of any run of leaves."""

import hashlib
import zlib

import pytest
from duochron.llm import merkle, plans

SF = "/root/testdata/sf0.001"
COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lower(text):
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def proof(nodes, i):
    """Levels of (before, after) from node i up, and the root."""
    path = []
    while len(nodes) > 1:
        a = i - i % 8
        path.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 8])))
        nodes, i = [sha("".join(nodes[j : j + 8])) for j in range(0, len(nodes), 8)], i // 8
    return path, nodes[0]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for members in by.values():
        members.sort(key=lambda m: m[:3])
    subroots = [proof([m[2] for m in by[lang]], 0)[1] for lang in langs]
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, own, r) in enumerate(by[lang]):
            low, sub = proof([m[2] for m in by[lang]], i)
            high, root = proof(subroots, k)
            h = own if r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 else leaf(*r[:4], lower(r[4]))
            for a, b in low + high:
                h = sha(a + h + b)
            out.append((r[0], own, sub, root, sha("".join(a + b for a, b in low + high)), h, h == root))
    return sorted(out, key=str)


def got(df):
    assert df.columns == COLS
    return sorted(map(tuple, df.collect()), key=str)


def test_whole_table(spark):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(plans.QUERIES["op12_merkle"](spark, SF)) == brute(rows)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, pos int, leaf string, held string"


@pytest.mark.parametrize("most", [1, 4])
def test_odd_rows(spark, most):
    rows = [(i * 3 % 1201, f"s{i % 2}", "en", i, f"Text {i} A") for i in range(600)]
    rows += [(i, "s", "é", 1, "B" * (i % 3)) for i in range(9)] + [(i, None, None, None, None) for i in range(17)]
    rows += [(i, "s", f"l{i:02}", 1, "One of its own: Ä Z é 🙂") for i in range(70)]  # more languages than a run
    rows += [(5, "s", "en", 5, "Again")] * 3 + [(None, "s", "en", 0, "No Id"), (None, None, None, None, None), (-9, "", "", 0, "")]
    rows += [(77, "s", "xx", 10**6, "A long TEXT " * 90_000)]
    df = spark.createDataFrame([(*r, "t", 1, "l", "h") for r in rows], SCHEMA)
    if most == 4:
        assert got(merkle.report(df)) == brute(rows)
        assert merkle.report(df.limit(0)).count() == 0
        one = spark.createDataFrame([(*rows[3], "t", 1, "l", "h")], SCHEMA)
        assert got(merkle.report(one)) == brute(rows[3:4])
        return
    small = merkle.Manifest(merkle.leaves(df, merkle.tampered(df["doc_id"])), most)  # several levels above the partitions
    assert got(small.proofs()) == brute(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 700])
def test_missing_is_enough_and_minimal(n):
    levels = merkle.layers([sha(str(i)) for i in range(n)], merkle.height(n))
    for first, last in {(0, 0), (0, n - 1), (n // 3, n // 2), (n - 1, n - 1)}:
        known = {(0, i): levels[0][i] for i in range(first, last + 1)}
        asked = list(merkle.missing(first, last, n))
        assert len(asked) == len(set(asked)) and not set(asked) & set(known)
        known.update({(k, i): levels[k][i] for k, i in asked})
        count, a, b = n, first, last
        for k in range(merkle.height(n)):
            up = -(-count // 8)
            for j in range(a // 8, b // 8 + 1):  # every node asked for is needed, every other one derived
                known[k + 1, j] = sha("".join(known[k, i] for i in range(8 * j, min(8 * j + 8, count))))
            used = {(k, i) for j in range(a // 8, b // 8 + 1) for i in range(8 * j, min(8 * j + 8, count))}
            assert {x for x in asked if x[0] == k} <= used
            count, a, b = up, a // 8, b // 8
        assert known[merkle.height(n), 0] == levels[-1][0]
