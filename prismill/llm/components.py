"""Connected components of a link table, by rounds of two star contractions.

Each round joins a node's links with the least neighbour, found by an
aggregate that is combined before its shuffle and written before the join. So
the join has nothing but two shuffles below it, and a node with very many
links is a skewed side that adaptive execution can split: it is never gathered
into one task. Rounds are written to the shared folder and end when the links
no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm.store import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """From links (a, b) the table (node, component) of every linked node but the least of each component.

    component is the least node reachable. Nulls and links of a node with itself
    say nothing and are passed over; repeated links count once; no links give an empty table.
    """
    e = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        e = scratch.table(e, "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
