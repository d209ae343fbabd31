"""Registered queries against their oracle SQL, and the shape of their plans.

By default a spread of queries runs; COLLOQUY_ALL_QUERIES=1 runs all of them."""

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from colloquy.plans import ORACLES, QUERIES
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = re.compile(
    "^(S1|S3|S4|S5|S6|P1_|P5|P8|J1_P7|J13|J15|W1|W5|A8|A14|A18|A20|C1|C2|C3|C8|F1_|F3|F14|K3_refresh_queue$|Q1|Q3|T2|U4)")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not there")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


@pytest.mark.parametrize("name", [
    n for n in entry.queries() if os.environ.get("COLLOQUY_ALL_QUERIES") or SAMPLE.match(n)])
def test_query_matches_oracle(spark, oracle, name):
    line = compare(spark, oracle, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert line.startswith("ok"), line


def test_every_query_has_an_oracle():
    """The training-data operators are tested on their own, where SQL can't express them."""
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["A14_compute_all_statistics", "A18_A19_rating_metrics_by_scope", "C2_select_evaluation_forums",
                                  "J13_Q7_text_leaks", "Q1_J10_validate_evidence_bundle", "Q3_prediction_schema_rules"])
def test_no_cartesian_products(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_statistics_read_only_the_columns_they_need(spark):
    text = plan(spark, "A8_paper_mean_rating")
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and not any("l_extendedprice" in s or "o_clerk" in s for s in schemas)
    assert "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,N))" in text


def test_sampling_limits_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "W4_U1_stratified_sample_over_axes")
    assert "WindowGroupLimit" in plan(spark, "W6_J4_keyed_dedup_and_upsert")
    assert "TakeOrderedAndProject" in plan(spark, "K2_seeded_cap")
