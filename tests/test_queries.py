"""A cross-section of the registered queries against their reference SQL; ``tests.compare`` runs all."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = [
    "d7_detect_format", "p2_cef_pairs", "p6_flatten_json", "p20b_apply_headers_shuffled", "n9_timestamp", "t9_score_threats",
    "v9_validate", "r2_quarantine_reason", "r4_process", "o1_page", "a14_analytics", "k1_write_events", "x9_stream_process",
    "x11_stream_dedup",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    assert differences(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_outcome_filter_does_not_repeat_the_extraction(spark):
    from logmeld.plans import inputs

    live = inputs.processed_live(spark, SF)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(live.filter("outcome = 'event'")) < 1.1 * size(live)
