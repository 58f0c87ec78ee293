"""Joins on order and ranges as equi-joins and windows, which scale with hash partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one key that one task puts in order; only keys with more are cut into cells.
HOT_ROWS = 1_000_000


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str], suffix: str = "_last", cell: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the values of the right row of the same key that is latest at or before it.

    Both sides go through one shuffle and one sort; no row is compared with all
    rows of its key. ``cell`` cuts time into cells (a monotone function of the
    time column, such as its day): the rows of keys that have more than
    ``HOT_ROWS`` are then spread over cells, and only one row for each cell goes
    on to find what earlier cells end with. Where there is no such key, which one
    aggregate tells, nothing is cut. Rows with a null key or time have null values.
    """
    names = {v: f"{v}{suffix}" for v in values}
    hot = None
    if cell:
        n = left.select(by).unionByName(right.select(by)).where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"))
        hot = n.where(F.col("n") > HOT_ROWS).select(by).withColumn("hot_", F.lit(1))
        hot = None if hot.isEmpty() else hot

    def placed(df: DataFrame) -> DataFrame:
        if hot is None:
            return df.withColumn("cell_", F.lit(None).cast("int"))
        return df.join(hot, by, "left").withColumn("cell_", F.when(F.col("hot_") == 1, cell(F.col(at)))).drop("hot_")

    a = placed(left.select("*", *(F.lit(None).cast(right.schema[v].dataType).alias(n) for v, n in names.items()), F.lit(1).alias("side_")))
    b = placed(right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, *(F.col(v).alias(n) for v, n in names.items()), F.lit(0).alias("side_")))
    w = Window.partitionBy(by, "cell_").orderBy(F.col(at), "side_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    latest = F.last(F.when(F.col("side_") == 0, F.struct(*names.values())), ignorenulls=True).over(w)
    out = both.withColumn("latest_", F.when(F.col(by).isNotNull() & F.col(at).isNotNull(), latest)).where("side_ = 1")
    if hot is not None:
        ends = b.where("cell_ IS NOT NULL").groupBy(by, "cell_").agg(F.max_by(F.struct(*names.values()), at).alias("end_"))
        earlier = Window.partitionBy(by).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
        some = a.where("cell_ IS NOT NULL").select(by, "cell_").distinct().join(ends, [by, "cell_"], "full").withColumn("carried_", F.last("end_", ignorenulls=True).over(earlier)).drop("end_")
        out = out.join(some, [by, "cell_"], "left").withColumn("latest_", F.coalesce("latest_", "carried_"))
    return out.select(*left.columns, *(F.col(f"latest_.{n}").alias(n) for n in names.values()))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, by: str | None = None) -> DataFrame:
    """Pairs where low <= point < high, by an equi-join on cells of the given width.

    A range goes to every cell that it touches, a point to one, so no pair is
    made twice and nothing is compared across cells. The width should be near
    the usual length of a range.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    p = points.withColumn("cell_", cell(F.col(point)))
    r = ranges.where(F.col(low) < F.col(high)).withColumn("cell_", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    within = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return p.join(r, ["cell_", *([by] if by else [])]).where(within).drop("cell_")


def interval_join(left: DataFrame, right: DataFrame, by: str, left_at: Column, right_at: Column, seconds: int) -> DataFrame:
    """Pairs of one key whose right row comes at most so many seconds after the left one.

    Time is cut into cells as long as the interval, and cells are part of the join's
    key: a left row meets the right rows of two cells, not all of its key.
    """
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    cell = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / F.lit(max(seconds, 1) * 1_000_000)).cast("long")
    a = left.withColumn("cell_", F.explode(F.array(cell(left_at), cell(left_at) + 1)))
    return a.join(right.withColumn("cell_", cell(right_at)), [by, "cell_"]).where((right_at >= left_at) & (right_at <= left_at + gap)).drop("cell_")


#: A row counts as so many bytes at least, so a table's size is never measured over more rows than could be sent.
ROW_BYTES = 16


def sized_broadcast(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """The table marked for sending to every executor if its rows, measured as text, have so many bytes at most; else as it is.

    Rows are read up to the number that the limit allows; of a larger table no more than these.
    """
    most = limit // ROW_BYTES
    rows, size = df.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= limit else df


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; ranks are limited before the shuffle where Spark can."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank_") <= k).drop("rank_")


def salted_join(big: DataFrame, small: DataFrame, on: str, salts: int) -> DataFrame:
    """An inner join where each key's rows are spread over so many tasks; for keys that adaptive execution can't split."""
    a = big.withColumn("salt_", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    b = small.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [on, "salt_"]).drop("salt_")
