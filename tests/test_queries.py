"""Every registered query against its SQL on the same tables; queries without SQL must give rows."""

import pytest
from compare import compare, connect

from epochlake.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    assert compare(registry.queries()[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["u2_bootstrap_metrics", "w2_event_windows", "m16_fold_screening", "m10_forest_stump", "e8_big_roc_auc", "l1_sample_windows", "u14_split_digests"])
def test_equals_sql_on_more_rows(spark, name):
    """Ties of roundings, users of many events and replicates show on larger tables only."""
    sf = "/root/testdata/sf0.01"
    assert compare(registry.queries()[name](spark, sf), connect(sf), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and not df.isEmpty()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
