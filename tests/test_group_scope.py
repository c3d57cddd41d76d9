"""The scope of saved groups: where its rows go."""

import re

from kwhrecon.plans import report as RP


def test_the_scope_of_groups_is_not_shuffled_for_their_names(spark, sample_base):
    groups = spark.createDataFrame([(1, "A", "Padaria Ipê"), (2, "B", "Escola Angico"), (2, "B", "Escola Angico")], "group_id int, group_name string, client string")
    months = spark.createDataFrame([(1, "07/2031"), (2, "07/2031"), (2, "2031-09")], "group_id int, period string")
    scope = RP.group_scope(sample_base, groups, months)
    plan = scope._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[group_id#\d+\], \[group_id#\d+\]", plan)
    assert sorted((r.group_id, r.row_id, r.in_months) for r in scope.collect()) == [(1, 1, True), (1, 3, False), (2, 6, True), (2, 7, True)]
