"""Running totals and ranks over a whole table, without a window that needs all of it in one task.

The table is dealt into ranges of its order and written. Each range's totals are
one row, so what the driver adds up grows with the number of ranges and not with the
rows. Within a range a window goes on from where the ranges before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismill.sources.scratch import Scratch


def running(df: DataFrame, order: list[str], tie: list[str], value: str, ranges: int = 64) -> DataFrame:
    """Add row_number, rank, dense_rank (by ``order``, ascending, nulls first) and running, the sum of ``value`` up to each row.

    ``tie`` are columns that put rows of equal order one after the other, such as
    a key; with them a very frequent order is spread over ranges as well. Rows alike in all of
    these have their numbers in some order. A null value adds nothing. An empty table gives
    an empty table. Columns of the new names are replaced.
    """
    scratch = Scratch(df.sparkSession, "running")
    names = ["row_number", "rank", "dense_rank", "running"]
    kept = [c for c in df.columns if c.lower() not in names]
    dealt = df.repartitionByRange(ranges, *order, *tie).withColumn("range_", F.spark_partition_id())
    d = scratch.table(dealt.withColumn("at_", F.struct(*order)), "dealt")
    first = Window.partitionBy("range_").orderBy("at_")
    rows = first if not tie else Window.partitionBy("range_").orderBy("at_", *tie)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = d.withColumns({
        "row_number": F.row_number().over(rows).cast("long"), "rank": F.rank().over(first).cast("long"), "dense_rank": F.dense_rank().over(first).cast("long"),
        "running": F.coalesce(F.sum(value).over(upto), F.lit(0)),
    })
    ends = d.groupBy("range_").agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min("at_").alias("low"), F.max("at_").alias("high"))
    counts = d.groupBy("range_", "at_").agg(F.count("*").alias("n")).groupBy("range_").agg(F.count("*").alias("kinds"))
    tail = d.join(ends.select("range_", "high"), "range_").where(F.col("at_").eqNullSafe(F.col("high"))).groupBy("range_").agg(F.count("*").alias("last"))
    ends = ends.join(counts, "range_").join(tail, "range_").select("range_", "n", "total", "kinds", "last", _text("low"), _text("high")).orderBy("range_")
    # One row for each range: how many rows, totals and different orders lie before it, and where an order began that goes on into it.
    before, total, kinds, began, open_, made = 0, 0, 0, 0, None, []
    for r in ends.collect():
        goes_on = r.low == open_
        made.append((r["range_"], before, total, kinds - goes_on, r.low if goes_on else None, began))
        if not (goes_on and r.kinds == 1):
            began = before + r.n - r["last"]
        before, total, kinds, open_ = before + r.n, total + (r.total or 0), kinds - goes_on + r.kinds, r.high
    kind = own.schema["running"].dataType.simpleString()
    shift = df.sparkSession.createDataFrame(made, f"range_ int, before_ long, total_ {kind}, kinds_ long, open_ string, began_ long")
    out = own.join(F.broadcast(shift), "range_")  # a row for each range
    goes_on = F.coalesce((F.col("rank") == 1) & F.col("open_").isNotNull(), F.lit(False))
    return out.select(
        *kept, (F.col("row_number") + F.col("before_")).alias("row_number"), F.when(goes_on, F.col("began_") + 1).otherwise(F.col("rank") + F.col("before_")).alias("rank"),
        (F.col("dense_rank") + F.col("kinds_")).alias("dense_rank"), (F.col("running") + F.col("total_")).alias("running"),
    )


def _text(column: str) -> Column:
    """An order as text, to tell on the driver whether two ranges share it."""
    return F.to_json(F.struct(F.col(column).alias("x")), {"ignoreNullFields": "false"}).alias(column)
