"""Registered queries against their check SQL. DUOCHRON_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from check import duck, frames_equal

SF = "/root/testdata/sf0.001"
CORE = [
    "state_quantiles", "dominance_prob", "set_metrics", "sliding_window_profile", "window_composition", "prominence", "linkage_families", "block_perm_null",
    "tfidf_binary", "stage_centering", "knn_edges", "nearest_anchor", "matched_background",
]


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(CORE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("DUOCHRON_ALL") else CORE)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert frames_equal(got, duck(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
