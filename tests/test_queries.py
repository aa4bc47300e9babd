from pathlib import Path

import pytest

from workloads.check import compare, connect
from workloads.oracle import ORACLE
from workloads.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables are absent")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_a_counterpart():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_counterpart(spark, connection, name):
    assert compare(spark, connection, FOLDER, name) is None


def test_entry(spark):
    import __spark_entry__ as driver

    df = driver.entry(spark)
    assert len(df.columns) == 68 and df.count() == 10
    assert REGISTRY.keys() <= driver.queries().keys() and ORACLE.keys() <= driver.oracle_sql().keys()


@pytest.mark.parametrize("name", ["region_mart", "class_share_with_dictionary", "box_stats", "state_medians_vs_density"])
def test_results_do_not_depend_on_broadcasts(spark, plan, connection, name):
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for setting in settings:
        spark.conf.set(setting, "-1")
    try:
        assert compare(spark, connection, FOLDER, name) is None
        df = REGISTRY[name](spark, FOLDER)
        df.collect()
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    finally:
        for setting in settings:
            spark.conf.unset(setting)


@pytest.mark.parametrize("name", ["region_mart", "share_by_class", "box_stats", "state_medians_vs_density", "map_layer"])
def test_plans_hold_no_python_and_no_cross_join(spark, plan, name):
    df = REGISTRY[name](spark, FOLDER)
    df.collect()
    text = plan(df)
    for absent in ("EvalPython", "MapInPandas", "CartesianProduct", "NestedLoop", "collect_list", "percentile("):
        assert absent not in text
