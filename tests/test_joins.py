"""Joins on odd inputs, and the plans that keep them off the driver."""

import pytest

from tessera import catalog
from tessera.operators import joins

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("right", [[], [None], [1, 1, 2], [1, None]])
def test_null_aware_anti_is_not_in(spark, right):
    a = spark.createDataFrame([(k,) for k in (1, 1, 3, 3, None)], "a long")
    b = spark.createDataFrame([(k,) for k in right], "b long")
    a.createOrReplaceTempView("not_in_a")
    b.createOrReplaceTempView("not_in_b")
    expected = spark.sql("SELECT a FROM not_in_a WHERE a NOT IN (SELECT b FROM not_in_b)").collect()
    assert sorted(joins.null_aware_anti(a, b, "a", "b").collect(), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["join_null_aware_anti", "join_null_aware_anti_with_null"])
def test_null_aware_anti_broadcasts_one_row(spark, name):
    df = catalog.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan
    assert not any("BroadcastHashJoin" in line for line in plan.splitlines())


def test_range_join_of_one_bin_is_spread(spark):
    """All points in one bin, with long and reversed intervals and nulls: every pair comes once, from many tasks."""
    points = spark.createDataFrame([(i, 1.0 + i % 7 / 10) for i in range(200)] + [(200, None)], "i long, p double")
    spans = spark.createDataFrame([(0, 0.0, 1.3), (1, -30.0, 30.0), (2, 1.6, 1.6), (3, 2.0, 1.0), (4, None, 5.0), (5, 1.3, 9.0)], "j long, lo double, hi double")
    got = joins.range_join(points, spans, "p", "lo", "hi", 5.0)
    expected = points.join(spans, (points.p >= spans.lo) & (points.p <= spans.hi))
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((r.i, r.j) for r in expected.collect())
    assert len([n for n in got.rdd.glom().map(len).collect() if n]) > 4


def test_range_condition_is_binned(spark):
    df = catalog.queries()["join_range_condition"](spark, SF)
    assert "_bin" in df._jdf.queryExecution().executedPlan().toString()
