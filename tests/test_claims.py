"""Each claim follows its own stage and no other."""

from duochron.operators import report

PAIR = [("300/75", 1.5, True), ("400/100", 2.0, True)]
GATES = [(1, True), (2, True)]


def facts(spark, pair=PAIR, gates=GATES, evidence="STRONG"):
    return report.claim_facts(
        spark.createDataFrame(pair, "window_config string, lag double, b_first boolean"), spark.createDataFrame(gates, "step int, passed boolean"),
        spark.createDataFrame([(3, evidence)] if evidence else [], "n_significant int, evidence string"),
    )


def test_each_claim_follows_its_stage(spark):
    all_true = {"lag_observed": True, "lag_recovered": True, "alignment_beyond_chance": True}
    assert facts(spark) == all_true and facts(spark, evidence="PARTIAL") == all_true
    for pair in ([], PAIR[:1] + [("400/100", -0.5, False)], PAIR[:1] + [("400/100", 0.0, True)], [("300/75", None, None)]):
        assert facts(spark, pair=pair) == {**all_true, "lag_observed": False}
    for gates in ([], [(1, True), (2, False)], [(1, True), (2, None)]):
        assert facts(spark, gates=gates) == {**all_true, "lag_recovered": False}
    for evidence in ("LIMITED_OR_NONE", None):
        assert facts(spark, evidence=evidence) == {**all_true, "alignment_beyond_chance": False}


def test_claims_without_evidence_stay_open(spark):
    rows = {r.claim: r.supported for r in report.claim_boundaries(spark, facts(spark)).collect()}
    assert rows["lag_observed"] and not rows["causal_order"] and not rows["regulator_identified"]
    assert not any(r.supported for r in report.claim_boundaries(spark, {}).collect())
