"""Places of a pattern in texts by column functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select columns so that each is worked out once a row.

    The optimizer moves conditions below projections and repeats what they
    refer to, which for patterns over whole texts is dear. It can't do so
    through a generator, here of one element.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("once")).select("once.*")


def hits(text: Column, pattern: str) -> Column:
    """All matches in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def gaps(text: Column, pattern: str) -> Column:
    """What lies before, between and after the matches: one text more than there are matches."""
    return F.split(F.coalesce(text, F.lit("")), pattern, -1)


def woven(gaps: Column, middle: Column) -> Column:
    """Gaps and replacements put together again."""
    both = F.zip_with(gaps, middle, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.array_join(both, "")


def starts(gaps: Column, hits: Column) -> Column:
    """Where each match starts, in code points from 0: one walk over a text's matches."""
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    none = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("end"))
    walk = F.aggregate(sizes, none, lambda a, x: F.struct(F.array_append(a["at"], a["end"] + x["g"]).alias("at"), (a["end"] + x["g"] + x["h"]).alias("end")))
    return walk["at"]
