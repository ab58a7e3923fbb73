import oracle
import pytest

from tagloom.queries import oracles, registered


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registered()))
def test_query_matches_sql(spark, con, sf_dir, name):
    result, sql = registered()[name](spark, sf_dir), oracles().get(name)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if sql is None:
        assert result.count() > 0
    else:
        assert oracle.compare(result, con, sql) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
