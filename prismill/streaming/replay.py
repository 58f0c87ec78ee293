"""A table of events as a stream that arrives late and out of order: in many files, one or more of them a micro-batch.

An event arrives with a delay that its number gives: most within four hours,
one in 29 some days later. Days of arrival are dealt into steps, and each
step's files are written after those of the step before, which is the order in
which a file stream reads them. A closing step far in the future moves
watermarks past everything, for streams that hold rows back until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of arrival in a step.
DAYS = 3
#: Rows in a file, about.
ROWS = 100_000
#: The closing row's number; its time is so many days after the last event.
CLOSING, AFTER = -1, 60

#: The delay in minutes, as SQL that Spark and DuckDB read alike.
DELAY = "CASE WHEN event_id % 29 = 0 THEN 2880 + (event_id % 11) * 720 ELSE (event_id * 7919) % 240 END"


def arrival() -> Column:
    return F.expr(f"ts + make_dt_interval(0, 0, CAST({DELAY} AS INT), 0)")


def steps(events: DataFrame) -> DataFrame:
    """Events with the number of the step in which they arrive, from 0."""
    first = events.agg(F.min(F.to_date("ts"))).first()[0]
    return events.withColumn("step", F.floor(F.datediff(F.to_date(arrival()), F.lit(first)) / DAYS).cast("int"))


def files(events: DataFrame) -> int:
    """Files that a step wants, so that the tasks which write and read one stay small."""
    n = steps(events).groupBy("step").count().agg(F.max("count")).first()[0]
    return -(-(n or 1) // ROWS)


def write(events: DataFrame, folder: str, files: int = 1, close: list[str] | None = None) -> int:
    """Write the steps one after the other, each in exactly so many files; ``close`` names the event types of closing rows. Returns how many steps there are."""
    spark = events.sparkSession
    d = steps(events)
    last = d.agg(F.max("step"), F.max("ts")).first()
    numbers = range((last[0] or 0) + 1)

    def put(rows: DataFrame, total: int) -> None:
        rows.write.mode("append").parquet(folder)
        # A batch reads so many files: what a hash leaves without rows gets an empty one, or the next step would come in too early.
        for _ in range(total - len(spark.read.schema(events.schema).parquet(folder).inputFiles()) if files > 1 else 0):
            rows.limit(0).coalesce(1).write.mode("append").parquet(folder)

    for i in numbers:
        # Also a step without rows is a batch.
        put(d.where(F.col("step") == i).drop("step").repartition(files, "event_id"), (i + 1) * files)
    if close:
        rows = spark.range(1).select(F.lit(CLOSING).cast("long").alias("event_id"), (F.lit(last[1]).cast("timestamp_ntz") + F.expr(f"INTERVAL {AFTER} DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.explode(F.array(*map(F.lit, close))).alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
        rows.select(*events.columns).repartition(1).write.mode("append").parquet(folder)
    return len(numbers) + bool(close)


#: DuckDB's form: every event with its step, and with the watermark that lateness is judged by (null in the first two steps).
#: In a step the state lets go of what lies behind the watermark that the steps before have set; rows are dropped behind the one before that.
ORACLE = f"""
WITH e AS (SELECT *, CAST(floor(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM events), CAST(ts + to_minutes(CAST({DELAY} AS BIGINT)) AS DATE)) / {DAYS}) AS INTEGER) AS step FROM events),
m AS (SELECT step, max(ts) AS top FROM e GROUP BY step),
w AS (SELECT a.step, max(b.top) AS seen FROM m a LEFT JOIN m b ON b.step < a.step - 1 GROUP BY a.step),
r AS (SELECT e.*, date_trunc('milliseconds', w.seen) AS seen FROM e JOIN w USING (step))
"""
