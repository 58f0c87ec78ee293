"""Column functions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day(ts: Column) -> Column:
    """The day of a time without zone, as such a time."""
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def month(ts: Column) -> Column:
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole rounded, null where the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
