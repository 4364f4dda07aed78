"""Motif scans against a window-by-window count, over tiles and parts of the library."""

import numpy as np

from duochron.operators import motifs as M


def by_hand(texts, pfms):
    out = {}
    for name, pfm in pfms.items():
        fwd = M.in_units(M.log_odds(np.array(pfm, float)))
        strands = [(u, M.threshold(u)) for u in (fwd, fwd[::-1, ::-1])]
        for key, text in texts.items():
            hits = [0, 0]
            for k, (u, cut) in enumerate(strands):
                for i in range(len(text) - u.shape[1] + 1):
                    w = ["ACGT".find(c) for c in text[i : i + u.shape[1]].upper()]
                    hits[k] += min(w) >= 0 and sum(int(u[x, j]) for j, x in enumerate(w)) >= cut
            if sum(hits):
                out[key, name] = (*hits, sum(hits))
    return out


def library(rng, n):
    """Matrices 7 to 19 columns wide, some of their columns telling little."""
    return {f"m{i}": rng.gamma(0.3, 20, size=(4, int(rng.integers(7, 20)))).round().tolist() for i in range(n)}


def result(df):
    return {(r["key"], r.motif_id): (r.forward_hits, r.reverse_hits, r.total_hits) for r in df.collect()}


def test_tiles_and_library_parts_change_nothing(spark):
    rng = np.random.default_rng(5)
    pfms = library(rng, 12)
    best = ["".join("ACGT"[k] for k in np.argmax(np.array(p), 0)) for p in pfms.values()]
    texts = {i: "".join(rng.choice(list("ACGTNacgt"), p=[0.2] * 4 + [0.04] + [0.04] * 4, size=n)) for i, n in enumerate((0, 3, 40, 700, 2500))}
    texts[4] = "".join(texts[4][i : i + 40] + best[(i // 40) % 12] for i in range(0, 2500, 40))  # best words at every offset of a tile
    want = by_hand(texts, pfms)
    assert len({m for _, m in want}) > 8
    seqs = spark.createDataFrame([*texts.items(), (9, None)], "key bigint, letters string")
    motifs = spark.createDataFrame(list(pfms.items()), "motif_id string, pfm array<array<double>>")
    for tile, size in ((1 << 16, 1 << 26), (23, 1 << 26), (64, 700)):
        assert result(M.scan(seqs, "key", "letters", motifs, tile=tile, library_bytes=size)) == want


def test_a_word_across_a_tile_edge_counts_once(spark):
    pfm = [[100.0 * (c == b) for c in "GATTACAGG"] for b in "ACGT"]
    motifs = spark.createDataFrame([("w", pfm)], "motif_id string, pfm array<array<double>>")
    texts = [(k, "T" * k + "GATTACAGG" + "T" * 40 + "CCTGTAATC") for k in range(32)]  # the second is its reverse complement
    got = result(M.scan(spark.createDataFrame(texts, "key bigint, s string"), "key", "s", motifs, tile=16))
    assert got == {(k, "w"): (1, 1, 2) for k in range(32)}


def test_every_tile_of_a_long_sequence_is_scanned(spark):
    pfm = [[100.0 * (c == b) for c in "GATTACAGG"] for b in "ACGT"]
    motifs = spark.createDataFrame([("w", pfm)], "motif_id string, pfm array<array<double>>")
    one = spark.createDataFrame([(1, ("GATTACAGG" + "C" * 91) * 40_000)], "key bigint, s string")
    assert result(M.scan(one, "key", "s", motifs)) == {(1, "w"): (40_000, 0, 40_000)}


def test_words_are_those_that_reach_the_cut():
    rng = np.random.default_rng(8)
    line = np.concatenate((rng.integers(0, 5, 4000), rng.integers(0, 4, 4000), [4, 4]))
    motifs, want = [], set()
    for i, pfm in enumerate(p for p in library(rng, 60).values() if len(p[0]) <= 9):
        u = M.in_units(M.log_odds(np.array(pfm)))
        width, cut = u.shape[1], M.threshold(u, 0.01)
        grid = np.indices((4,) * width).reshape(width, -1)
        scores = u[grid, np.arange(width)[:, None]].sum(0)
        words = M._words(u, cut)
        assert np.array_equal(np.sort(words), np.flatnonzero(scores >= cut))
        motifs.append((f"m{i}", width, b"", cut, cut, words.tobytes(), words[::2].tobytes()))
        for strand, kept in ((0, set(words.tolist())), (1, set(words[::2].tolist()))):
            code = sum(line[j : 8000 - width + 1 + j] * 4 ** (width - 1 - j) for j in range(width))
            sound = np.all([line[j : 8000 - width + 1 + j] < 4 for j in range(width)], axis=0)
            want |= {(at, 2 * i + strand) for at in np.flatnonzero(sound) if int(code[at]) in kept}
    got = [x for at, owner in M._Index(motifs).hits(line, 8000) for x in zip(at.tolist(), owner.tolist())]
    assert len(got) == len(set(got)) > 500 and set(got) == want


def test_no_sequences_or_no_motifs(spark):
    motifs = spark.createDataFrame([("w", [[9.0, 0.0]] + [[0.0, 9.0]] * 3)], "motif_id string, pfm array<array<double>>")
    seqs = spark.createDataFrame([(1, "ACGT")], "key bigint, s string")
    assert M.scan(seqs.limit(0), "key", "s", motifs).count() == 0
    assert M.scan(seqs, "key", "s", motifs.limit(0)).count() == 0


def test_dropping_windows_early_changes_no_start():
    rng = np.random.default_rng(1)
    for pfm in library(rng, 30).values():
        u = M.in_units(M.log_odds(np.array(pfm)))
        line = rng.integers(0, 5, 3000, dtype=np.int64)
        padded = np.vstack([u, np.full(u.shape[1], M._NEVER)])
        score = sum(padded[line[j : len(line) - u.shape[1] + 1 + j], j] for j in range(u.shape[1]))
        tail = np.concatenate((line, [4, 4]))
        for cut in (M.threshold(u), M.threshold(u, 0.05)):
            got = M._match_starts(tail[:-2] * 25 + tail[1:-1] * 5 + tail[2:], len(line), M._strand(u, cut))
            assert got.tolist() == np.flatnonzero(score >= cut).tolist()
