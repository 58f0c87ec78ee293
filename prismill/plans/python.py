"""Queries with functions in Python, each over Arrow batches or frames: what built-in functions can't say, or the form of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from prismill.plans.relational import query, table

#: Events of a bucket of users, about.
BUCKET_ROWS = 4096


@query("SELECT o_orderkey, round(o_totalprice * 1.1, 4) AS gross FROM orders")
def udf_scalar(spark, d):
    """Kept to show a vectorised function; the built-in expression is what to use."""

    def times(x: pd.Series) -> pd.Series:
        return x * 1.1

    return table(spark, d, "orders").select("o_orderkey", F.round(F.pandas_udf(times, "double")("o_totalprice"), 4).alias("gross"))


@query("""
SELECT p_partkey, len(string_split(p_name, ' ')) AS n_words FROM part""")
def udf_arrow_batches(spark, d):
    """Whole Arrow batches in and out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(x.split(" ")) for x in b.column("p_name").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), n], names=["p_partkey", "n_words"])

    return table(spark, d, "part").select("p_partkey", "p_name").mapInArrow(count, "p_partkey long, n_words long")


@query("SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events GROUP BY user_id")
def udf_grouped_map(spark, d):
    """Each user's events in one frame; users are many and small, which grouped maps need."""

    def spread(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": f["user_id"].iloc[:1], "spread": [f["value"].max() - f["value"].min()]})

    out = table(spark, d, "events").select("user_id", "value").groupBy("user_id").applyInPandas(spread, "user_id long, spread double")
    return out.select("user_id", F.round("spread", 6).alias("spread"))


@query("SELECT user_id, round(mad(value), 6) AS deviation FROM events GROUP BY user_id")
def udf_aggregate(spark, d):
    """The median distance from the median, which no built-in aggregate gives; a user's values are few."""

    def deviation(v: pd.Series) -> float:
        return float((v - v.median()).abs().median())

    out = table(spark, d, "events").groupBy("user_id").agg(F.pandas_udf(deviation, "double")("value").alias("deviation"))
    return out.select("user_id", F.round("deviation", 6).alias("deviation"))


@query("""
SELECT p_partkey, CAST(i AS INTEGER) AS i, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)""")
def udf_table(spark, d):
    """A table function, joined laterally."""

    class Words:
        def eval(self, text: str):
            for i, word in enumerate((text or "").split(" "), 1):
                yield i, word

    spark.udtf.register("prismill_words", F.udtf(Words, returnType="i int, word string"))
    table(spark, d, "part").createOrReplaceTempView("part_words")
    return spark.sql("SELECT p_partkey, i, word FROM part_words, LATERAL prismill_words(p_name)")


@query("""
SELECT c.event_id, p.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') c
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def udf_cogroup(spark, d):
    """Events of two kinds in two frames for each bucket of users: a frame for each user costs more than its few events do. ``join_asof`` does the same for users of any size."""

    def latest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({"event_id": a["event_id"], "last_value": a["value"]})
        # Nothing was bought by no one or at no time.
        known = a["user_id"].notna() & a["ts"].notna()
        b = b[b["user_id"].notna() & b["ts"].notna()].astype({"user_id": "int64"})
        c = a.loc[known, ["ts", "user_id", "event_id"]].astype({"user_id": "int64"})
        out = pd.merge_asof(c.sort_values("ts", kind="stable"), b[["ts", "user_id", "value"]].sort_values("ts", kind="stable"), on="ts", by="user_id")
        alone = a.loc[~known, ["event_id"]].assign(value=float("nan"))
        return pd.concat([out[["event_id", "value"]], alone]).rename(columns={"value": "last_value"})

    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value", "event_type").where("event_type IN ('view', 'purchase')")
    buckets = max(1, -(-e.count() // BUCKET_ROWS))
    e = e.withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    views, buys = (e.where(F.col("event_type") == k).groupBy("bucket") for k in ("view", "purchase"))
    return views.cogroup(buys).applyInPandas(latest, "event_id long, last_value double")
