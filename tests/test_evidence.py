"""The evidence's shared inputs, and the moved curves' metrics against the plain formulas."""

import hashlib
import math

import numpy as np
import pytest

from duochron.functions import draws
from duochron.operators import resample as B
from duochron.plans import inference, places, reports, tables as T


def test_order_and_curves_are_made_once(spark, monkeypatch):
    made, given = [], {}
    ranked = T.ranked
    monkeypatch.setattr(T, "ranked", lambda *a: made.append(a) or ranked(*a))
    row = lambda **c: spark.createDataFrame([tuple(c.values())], list(c))
    monkeypatch.setattr(reports, "frozen_pair_windows", lambda s, sf, stored=None: given.update(pair=stored) or row(a_family_id=1, b_family_id=2, lag=0.5))
    monkeypatch.setattr(inference, "bootstrap_lag_summary", lambda s, sf, order=None: given.update(boot=order) or row(n=1, median=0.1, ci_low=0.0, ci_high=0.2, p_positive=1.0, detection_rate=1.0))
    align = inference.alignment_evidence
    monkeypatch.setattr(inference, "alignment_evidence", lambda s, sf, curves=None: given.update(align=curves) or align(s, sf, curves))
    monkeypatch.setattr(places, "fisher_bh", lambda s, sf: row(enriched=True))
    got = {(r.stage, r.field): r.value for r in reports.evidence_freeze(spark, "/root/testdata/sf0.001").collect()}
    assert len(made) == 1 and given["pair"] is given["align"] is not None and given["boot"][1] == 1000
    assert got["entities", "n_entities"] == "1000" and got["alignment", "evidence"] == align(spark, "/root/testdata/sf0.001").first()["evidence"]


def metrics(x, a, b):
    """Mass centres, average ranks and divergence, place by place."""
    def center(m):
        c = np.cumsum(m) / m.sum()
        i = int(np.argmax(c > 0.5))
        return x[0] if i == 0 else x[i - 1] + (0.5 - c[i - 1]) / (c[i] - c[i - 1]) * (x[i] - x[i - 1])

    rank = lambda v: np.array([(v < w).sum() + ((v == w).sum() + 1) / 2 for w in v])
    p, q = np.maximum(a, 0) / np.maximum(a, 0).sum(), np.maximum(b, 0) / np.maximum(b, 0).sum()
    js = sum(v * math.log2(v / ((s + t) / 2)) / 2 for s, t in zip(p, q) for v in (s, t) if v > 0)
    ra, rb = rank(a), rank(b)
    rho = np.corrcoef(ra, rb)[0, 1] if ra.std() > 0 and rb.std() > 0 else None
    return center(np.maximum(a, 0)), center(np.maximum(b, 0)), rho, js


@pytest.mark.parametrize("gaps", [False, True])
def test_shifted_and_permuted_metrics(spark, monkeypatch, gaps):
    monkeypatch.setattr(B, "STRETCH", 16)
    rng = np.random.default_rng(41)
    n = 120
    x = np.arange(n) / 4.0
    if gaps:  # the region is not one stretch of the curve
        x[40:60] = 100.0
    a, b = rng.integers(-2, 9, n).astype(float), np.tile([0.0, 3.0, 1.0, 5.0], 30)  # values below zero, ties, a period
    curve = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x, a, b))], "idx bigint, x double, a double, b double")
    inside = np.flatnonzero((x >= 3) & (x <= 25))
    for keys, sources in (([0, 3, 4, 50, 116], B.shift_sources(n)), (range(5), B.block_sources(n, 4, 785))):
        got = {r.k: r for r in B.moved_alignment(curve, "k", keys, sources, 3.0, 25.0).collect()}
        assert sorted(got) == sorted(keys)
        for k in keys:
            ca, cb, rho, js = metrics(x[inside], a[inside], b[sources(k)[inside]])
            r = got[k]
            assert (r.q50_a, r.q50_b, r.spearman_rho, r.js_divergence) == pytest.approx((ca, cb, rho, js), abs=1e-10)
    again = {r.k: r for r in B.moved_alignment(curve, "k", [0, 4, 8], B.shift_sources(n), 3.0, 25.0).collect()}
    assert again[0][1:] == again[4][1:] == again[8][1:]  # equal curves tie exactly


def test_equal_and_flat_curves_have_no_divergence(spark):
    rows = [(i, float(i), 2.0, 2.0) for i in range(50)]
    flat = spark.createDataFrame(rows, "idx bigint, x double, a double, b double")
    for r in B.moved_alignment(flat, "k", [0, 7], B.shift_sources(50), 0.0, 60.0).collect():
        assert r.js_divergence == 0.0 and r.spearman_rho is None and r.signed_gap == 0.0


def test_hashes_with_constant_words_of_any_number(monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 50)
    for parts in ((7,), (785, 3, 0), ("a" * 16,), ("b" * 30, 12)):
        want = [int(hashlib.md5(":".join(map(str, (*parts, k))).encode()).hexdigest()[:15], 16) for k in range(90, 1010)]
        assert draws.Hash60(90, 1010)(*parts).tolist() == want
