"""Functions over frames: what groups they get, and odd rows."""

import duckdb
from oracle import rows
from pyspark.sql import functions as F

from prismill.plans import catalog, python


def test_cogroup_over_buckets_of_users_and_rows_without_user_or_time(spark, tmp_path, tiny, monkeypatch):
    monkeypatch.setattr(python, "BUCKET_ROWS", 100, raising=False)
    e = spark.read.parquet(f"{tiny}/events.parquet")
    e = e.withColumn("user_id", F.when(F.col("event_id") % 50 != 3, F.col("user_id"))).withColumn("ts", F.when(F.col("event_id") % 70 != 5, F.col("ts")))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = python.udf_cogroup(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert rows(got) == rows(con.sql(catalog.ORACLES["udf_cogroup"]).df())
