"""SimHash links against all pairs, and the cases a table may hold."""

import numpy as np
import pytest
import xxhash
from duochron.llm import plans, simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows):
    """rows: (id, fp) -> the smallest id reachable, by comparing all pairs."""
    fps = sorted({fp for _, fp in rows})
    of = {fp: fp for fp in fps}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                of[top(a)] = top(b)
    least = {}
    for i, fp in rows:
        if i is not None:
            least[top(fp)] = min(i, least.get(top(fp), i))
    return sorted(((i, f"{fp:016x}", least.get(top(fp))) for i, fp in rows), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got(plans.QUERIES["op9_simhash"](spark, SF)) == slow_classes([(d.doc_id, slow_fingerprint(d.text)) for d in docs])


def test_anchors_cover_every_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, 4, replace=False):
            y ^= 1 << int(bit)
        pair = np.array([x, y], np.uint64)
        anchor, index, home = simhash.replicas(pair)
        at = [set(anchor[index == i].tolist()) for i in (0, 1)]
        homes = set(anchor[home].tolist())
        assert at[0] & at[1] & homes
        assert home.sum() == 6


@pytest.mark.parametrize("large", [1 << 15, 3])
def test_clusters(spark, large):
    """Chains of small steps, with and without the path for crowded anchors."""
    rng = np.random.default_rng(5)
    fps = []
    for _ in range(12):
        x = int(rng.integers(0, 2**63))
        for _ in range(25):
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    rows = [(int(i), fp) for i, fp in enumerate(fps)]
    df = spark.createDataFrame([(i, int(np.uint64(fp).view(np.int64))) for i, fp in rows], "id bigint, fp bigint")
    out = df.join(simhash.classes(df, "id", "fp", large), "fp").collect()
    want = {i: c for i, _, c in slow_classes(rows)}
    assert {r.id: r.component_id for r in out} == want


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (4, "one"), (None, "one"), (5, "a b c"), (6, "A B\tC"), (7, "word " * 50000), (None, None), (8, "x y z \x1c q")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in ODD], "doc_id bigint, text string, fp string, row int")
    assert got(simhash.near_duplicates(df)) == slow_classes([(i, slow_fingerprint(t)) for i, t in ODD])
    assert got(simhash.near_duplicates(df.limit(0))) == []
    kept = simhash.one_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5, 7, 8] and kept[0].asDict().keys() == {"doc_id", "text", "fp", "row"}
    assert simhash.one_of_each(df.limit(0)).count() == 0
