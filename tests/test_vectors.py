"""Neighbours, components, factors and clocks against dense references."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.operators import clock as C, decompose as D, energy as E, knn as K, motifs as M, representation as R, windows as W
from duochron.operators.ordered import rank_rows
from duochron.session import materialize


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        order = sorted((round(float(d[i, j]), 12), j) for j in range(len(x)) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


def test_knn_cells_chunks_and_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)) + rng.integers(0, 4, 240)[:, None] * 6
    x[::3] = x[0]  # a third of the rows are copies of one vector
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    want = brute_knn(x, 5)
    for chunk in (K.ROWS_PER_CHUNK, 60):
        got = K.knn(df, "id", "v", 5, rows_per_chunk=chunk).toPandas().sort_values(["src", "rank"])
        assert {s: g.dst.tolist() for s, g in got.groupby("src")} == want


def test_knn_sends_a_vector_to_few_blocks(spark):
    """Groups of unequal sizes in many cells: right lists, and blocks in place of pairs of cells."""
    rng = np.random.default_rng(3)
    g = np.repeat([0, 1, 2], [330, 60, 2])
    x = rng.normal(size=(len(g), 4)) + rng.integers(0, 3, len(g))[:, None] * 9
    df = spark.createDataFrame([(i, int(b), [float(v) for v in r]) for i, (b, r) in enumerate(zip(g, x))], "id bigint, g int, v array<double>")
    got = K.knn(df, "id", "v", 4, "g", rows_per_chunk=20).toPandas().sort_values(["src", "rank"])
    d = np.where(g[:, None] == g, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), np.inf)
    np.fill_diagonal(d, np.inf)
    want = {i: [j for _, j in sorted((round(float(d[i, j]), 12), j) for j in range(len(g)) if np.isfinite(d[i, j]))[:4]] for i in range(len(g))}
    assert {s: r.dst.tolist() for s, r in got.groupby("src")} == want
    cells = K.pd.DataFrame({"cell": range(74), "n": [8_100] * 74})
    blocks = K._blocks(cells, 8_192 * K.CHUNKS_A_BLOCK)
    assert max(b for _, b, _ in blocks) + 1 == 5 and all(n == 1 for *_, n in blocks)
    assert K._blocks(K.pd.DataFrame({"cell": [4, 1], "n": [5, 30]}), 10) == [(4, 0, 1), (1, 1, 3)]


def test_nearest_over_blocks_of_candidates(monkeypatch):
    monkeypatch.setattr(K, "CANDIDATES_AT_ONCE", 16), monkeypatch.setattr(K, "QUERIES_AT_ONCE", 7)
    rng = np.random.default_rng(5)
    q, c = rng.integers(0, 3, (30, 3)).astype(float), rng.integers(0, 3, (90, 3)).astype(float)  # many ties
    ids = rng.permutation(90)
    for k in (1, 5, 16, 17, 200):
        row, dst, dist = K._nearest(q, ids, c, k)
        for i in range(30):
            d = np.sqrt(((c - q[i]) ** 2).sum(1))
            order = np.lexsort((ids, d))[:k]
            assert dst[row == i].tolist() == ids[order].tolist() and np.array_equal(dist[row == i], d[order])


def test_orders_and_dealt_clocks_by_hand(spark):
    """Ids that come twice and vectors and clocks that are missing, against the same orders in numpy."""
    from hashlib import md5

    rng = np.random.default_rng(11)
    ids = [*range(40), 3, 7]
    clock = [None if i == 5 else round(float(rng.normal()), 3) for i in range(42)]
    x = rng.normal(size=(42, 3))
    x[40:] = x[[3, 7]]
    clock[40:] = clock[3], clock[7]
    rows = [(i, c, None if k == 9 else [float(v) for v in r]) for k, (i, c, r) in enumerate(zip(ids, clock, x))]
    df = spark.createDataFrame(rows, "id bigint, clock double, v array<double>")
    h = lambda *p: int(md5(":".join(map(str, p)).encode()).hexdigest()[:15], 16)
    step = lambda o: [np.sqrt(((x[a] - x[b]) ** 2).sum()) for a, b in zip(o[:-1], o[1:]) if 9 not in (a, b)]
    got = K.order_coherence(df, "id", "clock", "v", 42, 6, 785).first()
    first = sorted(range(42), key=lambda k: (clock[k] is not None, clock[k] or 0, ids[k]))
    med = [np.median(step(sorted(range(42), key=lambda k: (h(785, p, ids[k]), ids[k])))) for p in range(6)]
    assert np.isclose(got.observed_median, np.median(step(first))) and np.isclose(got.random_median, np.median(med))
    perm = K.clock_permutations(df, "id", "clock", 42, 6, 785)
    held = [(r.id, r.clocks) for r in perm.collect()]
    assert sorted(i for i, _ in held) == sorted(ids) and all(len(c) == 6 for _, c in held)
    key = lambda c: (c is None, c or 0)
    assert all(sorted((c[p] for _, c in held), key=key) == sorted(clock, key=key) for p in range(6))
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 40) for i in range(40)], "src bigint, dst bigint")
    got = K.neighbor_coherence(edges, df, "id", "clock", perm, 6).first()
    gaps = lambda at: [abs(a - b) for e in edges.collect() for i, a in at if i == e.src for j, b in at if j == e.dst and None not in (a, b)]
    assert np.isclose(got.observed_mean, np.mean(gaps(list(zip(ids, clock)))))
    assert np.isclose(got.random_mean, np.mean([np.mean(gaps([(i, c[p]) for i, c in held])) for p in range(6)]))


def test_components_on_long_chain_and_hub(spark):
    e = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201)]
    v = spark.createDataFrame([(i,) for i in [*range(21), *range(100, 130), 200, 201, 300]], "id bigint")
    got = {r.id: r.component for r in K.components(spark.createDataFrame(e, "src bigint, dst bigint"), v, "id").collect()}
    assert set(got.values()) == {0, 100, 200, 300} and got[20] == 0 and got[129] == 100 and got[300] == 300


def test_factor_matches_dense_svd(spark):
    rng = np.random.default_rng(4)
    a = rng.random((80, 12)) * (rng.random((80, 12)) < 0.3)
    a[:, 0] += np.linspace(0, 5, 80)
    cells = [(int(i), f"f{j:02d}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    v = spark.createDataFrame(cells, "entity bigint, feature string, value double")
    ent = spark.createDataFrame([(i,) for i in range(80)], "entity bigint")
    for center in (True, False):
        s, _, axes = D.factor(v, v.select("feature"), ent, 3, center)
        m = a - a.mean(0) if center else a
        u, w, _ = np.linalg.svd(m, full_matrices=False)
        got = np.stack(s.toPandas().sort_values("entity")["scores"].to_numpy())
        assert np.allclose(axes["singular_value"], w[:3], rtol=1e-6)
        assert np.allclose(np.abs(got), np.abs(u[:, :3] * w[:3]), atol=1e-5)


def test_factor_with_many_empty_entities(spark):
    rng = np.random.default_rng(7)
    a = np.zeros((400, 6))
    a[:50] = rng.random((50, 6)) * (rng.random((50, 6)) < 0.7)
    cells = [(int(i), f"f{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    v = spark.createDataFrame(cells, "entity bigint, feature string, value double")
    ent = spark.range(400).select(F.col("id").alias("entity"))
    for center in (True, False):
        s, _, axes = D.factor(v, v.select("feature"), ent, 3, center)
        m = a - a.mean(0) if center else a
        u, w, _ = np.linalg.svd(m, full_matrices=False)
        p = s.toPandas().sort_values("entity")
        assert p.entity.tolist() == list(range(400)) and np.allclose(axes["singular_value"], w[:3], rtol=1e-6)
        assert np.allclose(np.abs(np.stack(p["scores"].to_numpy())), np.abs(u[:, :3] * w[:3]), atol=1e-5)
    at = rng.integers(0, 9, 500)
    y = rng.random((500, 4))
    want = np.zeros((9, 4))
    np.add.at(want, at, y)
    assert np.allclose(D._sums(at, y, 9), want) and not D._sums(at[:0], y[:0], 2).any()


def test_leading_vectors_match_dense_eigh(spark):
    rng = np.random.default_rng(6)
    x = np.sort(rng.random(60))[:, None]
    df = spark.createDataFrame([(i, [float(r[0]), 0.0]) for i, r in enumerate(x)], "id bigint, v array<double>")
    t = materialize(C.transitions(C.gauss_graph(K.knn(df, "id", "v", 8))))
    p = t.toPandas()
    dense = np.zeros((60, 60))
    dense[p.src, p.dst] = p.t
    want = np.sort(np.linalg.eigvalsh(dense))[::-1][:4]
    got, psi = C.leading_vectors(t, 4, 785, steps=12, residual=1e-7)
    assert np.allclose(got, want, atol=1e-9) and abs(got[0] - 1) < 1e-9
    v = psi.toPandas().sort_values("v")
    x = np.stack(v["psi"].to_numpy())
    assert np.abs(x.T @ x - np.eye(4)).max() < 1e-8 and np.linalg.norm(dense @ x - x * got, axis=0).max() < 2e-7
    with pytest.raises(RuntimeError, match="residuals"):
        C.leading_vectors(t, 4, 785, steps=2, residual=1e-300, cycles=2)


def test_memberships_against_a_dense_search(spark):
    """Plain bisection row by row, and both directions' union on a dense matrix."""
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(size=(70, 3)), np.repeat(rng.normal(size=(1, 3)), 12, axis=0), [[50.0, 0, 0]]))
    n, k = len(x), 9
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    edges = materialize(K.knn(df, "id", "v", k - 1))
    p = edges.toPandas()
    a = np.zeros((n, n))
    for src, rows in p.groupby("src"):
        d = np.sort(rows.dist.to_numpy())
        rho = d[d > 0].min() if (d > 0).any() else 0.0
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.exp(-np.maximum(d - rho, 0) / mid).sum() < np.log2(k) else (low, mid)
        sigma = max(low, 1e-3 * (d.sum() / k if rho > 0 else p.dist.sum() / (n * k)))
        a[src, rows.dst] = np.exp(-np.maximum(rows.dist - rho, 0) / sigma)
    want = a + a.T - a * a.T
    got = np.zeros((n, n))
    g = C.fuzzy_graph(edges).toPandas()
    got[g.src, g.dst] = g.w
    assert np.abs(got - want).max() < 1e-6 and (got == got.T).all()
    sums = C.memberships(edges).groupBy("src").agg(F.sum("w").alias("w")).toPandas().set_index("src").w
    assert np.isclose(sums.loc[range(70)], np.log2(k), atol=1e-6).sum() > 60 and sums.min() > np.log2(k) - 1e-6


@pytest.mark.parametrize("kernel", ["gauss", "fuzzy"])
def test_clock_follows_a_line_and_skips_islands(spark, kernel):
    n = 90
    pts = [(i, [i / 10.0, 0.0]) for i in range(n)] + [(1000 + i, [500.0 + i / 10, 0.0]) for i in range(20)]
    df = spark.createDataFrame(pts, "id bigint, v array<double>")
    got = C.diffusion_clock(df, "id", "v", 0, 10, 6, 5, kernel=kernel).toPandas().sort_values("id")
    line = got[got.id < n]["clock"].to_numpy()
    assert line[0] == 0 and abs(line.max() - 1) < 1e-9 and np.corrcoef(np.arange(n), line.argsort().argsort())[0, 1] > 0.99
    assert got[got.id >= n]["clock"].isna().all()
    pairs = [(int(i), None if np.isnan(c) else float(c)) for i, c in zip(got.id, got.clock)]
    frac = C.connected_fraction(spark.createDataFrame(pairs, "id bigint, clock double")).first()
    assert abs(frac["connected_fraction"] - n / (n + 20)) < 1e-9


def test_energy_peaks_at_the_change(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) + np.r_[np.zeros(150), np.ones(150) * 2][:, None]
    df = spark.createDataFrame([(i, float(i), [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, clock double, v array<double>")
    e = E.transition_energy(rank_rows(df, ["clock", "id"]), "v", 4, W.Design("w", 60, 15), 300).toPandas()
    assert (e.transition_energy >= 0).all() and abs(e.transition_energy.argmax() * 15 + 30 - 150) < 45


def test_silhouette_of_all_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)) + np.repeat([[0, 0, 0], [3, 0, 0], [0, 4, 0]], 20, axis=0)
    lab = np.repeat(["a", "b", "c"], 20)
    rows = [(i, [float(v) for v in r], g) for i, (r, g) in enumerate(zip(x, lab))] + [(60, [9.0, 9.0, 9.0], "alone"), (61, [1.0, 1.0, 1.0], None)]
    got = K.silhouette(spark.createDataFrame(rows, "id bigint, v array<double>, g string"), "id", "v", "g").first()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    m = np.stack([d[:, lab == g].sum(1) for g in "abc"], 1)
    own = (lab[:, None] == np.array(list("abc"))).argmax(1)
    a = m[np.arange(60), own] / 19
    b = np.where(np.arange(3) == own[:, None], np.inf, m / 20).min(1)
    assert (got.n_scored, got.n_labels) == (60, 3) and abs(got.silhouette - ((b - a) / np.maximum(a, b)).mean()) < 1e-9


def test_motif_threshold_and_scan(spark):
    rng = np.random.default_rng(9)
    pfm = np.array([[9, 1, 1, 7, 1, 3], [1, 9, 1, 1, 1, 3], [1, 1, 9, 1, 1, 3], [1, 1, 1, 3, 9, 3]], float)
    u = M.in_units(M.log_odds(pfm))
    grid = np.array(np.meshgrid(*[range(4)] * 6)).reshape(6, -1)
    scores = u[grid, np.arange(6)[:, None]].sum(0)
    cut = M.threshold(u, 0.01)
    assert (scores >= cut).mean() <= 0.01 < (scores >= scores[scores < cut].max()).mean()
    texts = ["".join(rng.choice(list("ACGTN"), 400, p=[0.24] * 4 + [0.04])) for _ in range(20)] + [""]
    m = spark.createDataFrame([("m", pfm.tolist())], "motif_id string, pfm array<array<double>>")
    got = {r.id: (r.forward_hits, r.reverse_hits) for r in M.scan(spark.createDataFrame(list(enumerate(texts)), "id bigint, s string"), "id", "s", m).collect()}
    cut = M.threshold(u)
    comp = str.maketrans("ACGT", "TGCA")

    def hits(t):
        ok = lambda w: "N" not in w and sum(u["ACGT".index(c), i] for i, c in enumerate(w)) >= cut
        return sum(ok(t[i : i + 6]) for i in range(len(t) - 5))

    for i, t in enumerate(texts):
        assert got.get(i, (0, 0)) == (hits(t), hits(t.translate(comp)[::-1]))


def test_axis_helpers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0])], "id bigint, v array<double>")
    assert [r.v for r in R.drop_axes(df, "v", [2]).orderBy("id").collect()] == [[1.0, 3.0], [3.0, 1.0]]
    z = R.zscore_vector(df, "v", 3).orderBy("id").collect()
    assert np.allclose(z[0].v, [-1, 0, 1])
    one = R.stage_centering(df.withColumn("st", F.lit("s")).withColumn("sa", F.lit("only")), "st", "sa", "v", 3)[1].first()
    assert one["applied"] is False and one["shift_norm"] == 0.0


def test_label_columns_that_are_ids_are_refused(spark):
    from duochron.operators.stats import partial_r2

    df = spark.range(100_050).select(F.col("id").alias("b"), F.lit(1).alias("t"), F.lit(1.0).alias("d"))
    with pytest.raises(ValueError):
        partial_r2(df, ["d"], ["b"], ["t"])
