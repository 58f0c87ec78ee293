import pytest
from oracle import check

from prismill.plans import catalog, relational


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_duckdb(spark, tiny, name):
    check(spark, catalog.QUERIES[name], catalog.ORACLES[name], tiny)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, tiny):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = relational.scan_pushdown(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "LessThan(l_shipdate" in plan
    read = plan[plan.rindex("ReadSchema") :]
    assert "l_extendedprice" not in read and "l_discount" in read
