"""Registered queries against their oracles on the smallest tables.

A sample by default; `TIDEMARK_ALL_QUERIES=1` runs every one (`tests/check_oracles.py` does so too).
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from tests.check_oracles import compare, duck

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
SAMPLE = ["w1_velocity_counts", "s3_merged", "v1_contract", "c9_stratified_take", "a2_oof_encoding", "a14_null_groups", "e4_sensitivity", "e17_stratified", "g8_clustering", "m16_histogram_quantiles",
          "p4_feature_assembly", "t9s_decision_mix"]
ORACLES_HERE = {n for n in ORACLES if not n.startswith("op")}  # the training-data operators have tests of their own
NAMES = sorted(ORACLES_HERE) if os.environ.get("TIDEMARK_ALL_QUERIES") else SAMPLE
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck(SF).execute(ORACLES[name]).fetchdf()) == ""


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="large test tables are not here")
@pytest.mark.parametrize("name", ["g8_clustering", "e8_roc_auc", "m3_feature_psi"])
def test_at_the_largest_scale(spark, name):
    """What depends on the number of rows shows here only."""
    assert compare(QUERIES[name](spark, LARGE).toPandas(), duck(LARGE).execute(ORACLES[name]).fetchdf()) == ""


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
