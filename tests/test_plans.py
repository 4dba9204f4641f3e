"""Plan rules for every registered query: no cartesian products or
nested-loop joins, and no row-at-a-time Python UDFs (Arrow batches only)."""

import pytest

from tessera.plans import registry

from tests.conftest import SF001

QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_rules(spark, name):
    df = QUERIES[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"
