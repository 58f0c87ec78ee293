"""Streaming plans as queries: each stream is drained into a folder, and the rows of the folder are the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.plans import relational
from prismill.plans.relational import query, table
from prismill.sources.scratch import Scratch
from prismill.streaming import events, keyed, replay


#: Partitions of a replayed stream's state, at least.
LEAST = 12


def drained(df: DataFrame, mode: str, progress: list | None = None, **settings: str) -> DataFrame:
    """All rows that a stream gives until its input is read; of complete results the last one, of updates each. ``progress`` gets what Spark says of each batch."""
    spark = df.sparkSession
    at = Scratch(spark, "stream").folder("drained")

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is given again after a failure takes the place of its first writing.
        batch.write.mode("overwrite").parquet(f"{at}/rows" if mode == "complete" else f"{at}/rows/batch={number}")

    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if progress is not None:
        progress += q.recentProgress
    return spark.read.schema(df.schema).parquet(f"{at}/rows").select(*df.columns)


def _replayed(spark, d, *close: str) -> tuple[DataFrame, dict[str, str]]:
    """As ``replayed``, and the settings that the stream is drained with.

    Each partition of the state costs every batch some files, whatever it holds, so there are as many as the steps have
    files: their number follows the rows and not the session, and what one of them holds stays the same.
    """
    at = Scratch(spark, "replay").folder("events")
    whole = table(spark, d, "events")
    files = replay.files(whole)
    replay.write(whole, at, files, close=list(close))
    return events.stream(spark, at, "*.parquet", files), {"spark.sql.shuffle.partitions": str(max(LEAST, files))}


def replayed(spark, d, *close: str) -> DataFrame:
    """The events as a stream in the order of their arrival, a step in each batch."""
    return _replayed(spark, d, *close)[0]


def _events(spark, d):
    return events.stream(spark, d, "events.parquet")


@query(relational.ORACLES["window_tumbling"])
def stream_tumbling(spark, d):
    return drained(events.tumbling(_events(spark, d), "1 day"), "complete")


@query(relational.ORACLES["window_sliding"])
def stream_sliding(spark, d):
    return drained(events.sliding(_events(spark, d), "2 hours", "1 hour"), "complete")


@query(relational.ORACLES["window_session"])
def stream_session(spark, d):
    return drained(events.sessions(_events(spark, d), "2 hours"), "complete")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_deduplicated(spark, d):
    """Every event twice in the stream, once in the result."""
    e = _events(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drained(events.deduplicated(twice), "append").select("event_id", "user_id", "event_type", "value")


@query(relational.ORACLES["join_interval"])
def stream_join(spark, d):
    e = _events(spark, d)
    out = drained(events.followed(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "6 HOURS"), "append")
    return out.select(F.col("a").alias("first_id"), F.col("b").alias("second_id"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_totals(spark, d):
    """Keyed state of one's own; the last update of each user counts."""
    out = drained(events.running_totals(_events(spark, d)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


@query(replay.ORACLE + """
SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM r
WHERE seen IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > seen - INTERVAL 1 DAY
GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_late(spark, d):
    """Windows of events that arrive late and out of order: each goes out once, and rows of windows behind the watermark are dropped."""
    e, sized = _replayed(spark, d)
    return drained(events.tumbling(e, "1 day", late="1 day"), "append", **sized)


@query(replay.ORACLE + """
SELECT event_id, user_id, event_type, value FROM r WHERE seen IS NULL OR ts > seen - INTERVAL 1 DAY""")
def stream_late_deduplicated(spark, d):
    """Every event arrives twice, the second time a batch or more later for some; those behind the watermark are dropped."""
    e, sized = _replayed(spark, d)
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return drained(events.deduplicated(twice, late="1 day"), "append", **sized).select("event_id", "user_id", "event_type", "value")


@query("""
SELECT a.event_id AS first_id, b.event_id AS second_id FROM (SELECT * FROM events WHERE event_type = 'view') a
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def stream_left_join(spark, d):
    """Views and what followed them, out of order and nothing of it late; views that nothing followed go out when the watermark passes."""
    e, sized = _replayed(spark, d, "view", "purchase")
    out = drained(events.followed_or_not(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "6 HOURS", late="10 days"), "append", **sized)
    return out.where(F.col("a") != replay.CLOSING).select(F.col("a").alias("first_id"), F.col("b").alias("second_id"))


@query(relational.ORACLES["window_session"])
def stream_session_timers(spark, d):
    """Sessions by timers of one's own state, from events that arrive out of order."""
    e, sized = _replayed(spark, d, "view")
    out = drained(keyed.sessions(e, 2 * 3600 * 1000, late="10 days"), "append", **keyed.STORE, **sized)
    return out.where(F.col("user_id") != -1)
