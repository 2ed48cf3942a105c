import re

import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["agg_approx_distinct_error", "agg_fn_approx_count_distinct", "agg_fn_hll_sketch_agg"])
def test_no_sketch_for_each_key(spark, name):
    """An aggregation by the counted key must not carry sketches, which are far larger than the key."""
    df = catalog.queries()[name](spark, SF)
    assert all(r[-1] for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.splitlines() if re.search(r"Aggregate\(keys=\[[^]]*\b(o_custkey|k)#", x)]
    assert steps
    assert not [x for x in steps if re.search("approx_count_distinct|hll_sketch_agg", x)]
