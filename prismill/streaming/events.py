"""Structured Streaming over event tables: windows with watermarks, deduplication, joins and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def stream(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1) -> DataFrame:
    """Events as they arrive in a folder. Event time becomes a time with zone, which watermarks ask for."""
    s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Count and sum for each window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of repeated events; state is dropped behind the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _pairs(first: DataFrame, second: DataFrame, within: str, late: str, how: str) -> DataFrame:
    """Pairs of a user's events, the second at most ``within`` after the first.

    State is kept by user and stretch of time: an event of the first stream stands in its own
    stretch, one of the second in its own and the one before. A stretch is twice as long as
    ``within``, also where clocks are changed, so each pair meets once, and an event is compared with those of
    two stretches, however many events the user has.
    """
    start = "TIMESTAMP '1970-01-01 00:00:00Z'"
    width = F.expr(f"2 * (unix_micros({start} + INTERVAL {within}) - unix_micros({start})) + 1")
    stretch = F.floor(F.unix_micros("ts") / width)
    a = first.withWatermark("ts", late).select(F.col("user_id").alias("user"), stretch.alias("stretch_a"), F.col("ts").alias("ts_a"), F.col("event_id").alias("a"))
    b = second.withWatermark("ts", late).select("user_id", F.explode(F.array(stretch, stretch - 1)).alias("stretch_b"), F.col("ts").alias("ts_b"), F.col("event_id").alias("b"))
    return a.join(b, F.expr(f"user = user_id AND stretch_a = stretch_b AND ts_b >= ts_a AND ts_b <= ts_a + INTERVAL {within}"), how).select("user", "a", "b")


def followed(first: DataFrame, second: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Pairs of a user's events of two streams, the second at most ``within`` after the first; both sides' state is bounded."""
    return _pairs(first, second, within, late, "inner")


def followed_or_not(first: DataFrame, second: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """As ``followed``, and each of the first stream's events that nothing followed, with a null, once the watermark rules out that something still comes."""
    return _pairs(first, second, within, late, "left")


TOTALS = "user_id long, n long, total double"


def running_totals(events: DataFrame) -> DataFrame:
    """Per user the count and sum so far, kept as state between batches, in Arrow batches."""

    def update(key: tuple, frames: Iterator, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, TOTALS, "n long, total double", "update", "NoTimeout")
