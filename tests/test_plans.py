"""Physical-plan properties that must hold at any scale."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["consolidate", "report", "report_by_group", "report_by_month",
                                  "filter_clients_docs", "identity_backfill", "gap_report"])
def test_no_pairwise_joins(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    assert not any(f in text for f in FORBIDDEN), name
