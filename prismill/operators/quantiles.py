"""Exact quantiles of large groups: histograms find the cells of the ranks, and only different values of these are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismill.sources.scratch import Scratch

#: Different values that one task puts in order; cells with more of them are cut again.
MOST = 50_000
#: Cuts of such a cell.
CUTS = 256
#: Cells are numbered up to this; what lies beyond, as infinities do, shares the last one.
EDGE = float(1 << 52)


def exact_quantile(df: DataFrame, by: list[str], value: str, share: float, width: float, to: str) -> DataFrame:
    """Per group the quantile of a share, between the two nearest values where it falls between them.

    First cells are ``width`` wide. Their counts are combined before they are shuffled,
    and a group's cells (not its rows) go through one window. Rows of the one or two
    cells of each group that hold the ranks are counted by value, so a value that
    very many rows share is one row. A cell of more than ``MOST`` different values is cut at
    quantiles of these until it has fewer. Values are compared as doubles, infinities
    as numbers; NaN comes after all numbers, as in Spark's order, and where a quantile falls on or
    next to it the result is NaN. Nulls don't count; a group of nulls isn't there.
    """
    scratch = Scratch(df.sparkSession, "quantile")
    v = F.col("v")
    d = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    cell = F.when(F.isnan(v), F.lit(2 * EDGE)).otherwise(F.floor(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), v / width)))).cast("long")
    d = d.withColumn("cell", cell)

    def chosen(hist: DataFrame) -> DataFrame:
        """Of cells (by, cell, n, base, at) of a group, those that hold the ranks next to ``at``; base is how many values come before."""
        up = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        h = hist.withColumn("base", F.col("base") + F.coalesce(F.sum("n").over(up), F.lit(0)))
        return h.where((F.col("base") + F.col("n") > F.floor("at")) & (F.col("base") <= F.ceil("at"))).select(*by, "cell", "base", "at")

    hist = d.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    hist = hist.withColumns({"base": F.lit(0).cast("long"), "at": (F.sum("n").over(Window.partitionBy(*by)) - 1) * F.lit(float(share))})
    keys = [*by, "cell", "base", "at"]
    values = scratch.table(_met(d, chosen(hist), [*by, "cell"]).groupBy(*keys, "v").agg(F.count("*").alias("n")), "values")
    while (values.groupBy(*by, "cell").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > MOST:
        # All chosen cells of a group follow each other, so they are cut together.
        points = [(i + 1) / CUTS for i in range(CUTS - 1)]
        group = values.groupBy(*by).agg(F.min("base").alias("low"), F.percentile_approx("v", points, 10 * CUTS).alias("cuts"))
        cut = _met(values.drop("cell", "base"), group, by)
        cut = cut.withColumn("cell", F.when(F.isnan("v"), F.lit(CUTS)).otherwise(F.size(F.filter("cuts", lambda c: c <= F.col("v")))).cast("long")).drop("cuts")
        cut = scratch.table(cut, "cut")
        hist = cut.groupBy(*by, "cell", F.col("low").alias("base"), "at").agg(F.sum("n").alias("n"))
        values = scratch.table(_met(cut.drop("low", "at"), chosen(hist), [*by, "cell"]), "values")
    up = Window.partitionBy(*by, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("upto", F.col("base") + F.sum("n").over(up))
    holds = lambda rank: F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("v")))
    near = ranked.groupBy(*by, "at").agg(holds(F.floor("at")).alias("low"), holds(F.ceil("at")).alias("high"))
    part = F.col("at") - F.floor("at")
    between = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    return near.select(*by, between.alias(to))


def _met(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """The rows with what the smaller table says of their keys, null keys too."""
    b = small.select(*(F.col(c).alias(f"{c}_b") if c in on else F.col(c) for c in small.columns))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return rows.join(b, same).drop(*(f"{c}_b" for c in on))
