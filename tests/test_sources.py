import pytest

from prismill.sources import files

ROWS = [(1, "plain", 1.5), (2, 'with "quotes", commas\nand lines', None), (3, "", 0.0), (4, None, -2.25)]
SCHEMA = "id long, text string, value double"


@pytest.mark.parametrize("kind", files.FORMATS)
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write(df, str(tmp_path / kind), kind)
    back = files.read(spark, str(tmp_path / kind), df.schema, kind)
    assert sorted(map(tuple, back.collect())) == ROWS


def test_partition_pruning(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    files.write(df, str(tmp_path / "t"), partition_by=["id"])
    got = files.read(spark, str(tmp_path / "t"), df.schema).where("id = 3")
    assert "PartitionFilters: [isnotnull(id" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.text for r in got.collect()] == [""] or got.count() == 1


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "x"), "xml")


def test_bucketed_tables_join_without_shuffle(spark):
    a = spark.range(50).withColumnRenamed("id", "k")
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        files.bucketed(a, name, "k", 4)
    joined = spark.table("bucket_a").hint("merge").join(spark.table("bucket_b"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 50
