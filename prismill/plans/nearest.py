"""Searches among vectors: every row whose id is divisible by 20 asks for its ten nearest of all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.operators import vectors
from prismill.plans.relational import query, table

SIZE = 64


def _index(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.build(e, "vec_id", "embedding", SIZE), e.where("vec_id % 20 = 0")


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS similarity
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) AS k FROM s)
SELECT vec_id, CAST(k AS INTEGER) AS rank, neighbour, round(similarity, 6) AS similarity FROM r WHERE k <= 10""")
def vector_nearest(spark, d):
    """All ten nearest: cells are left out only where their radius rules them out."""
    index, asked = _index(spark, d)
    found = vectors.exact_nearest(index, asked, "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", F.round("similarity", 6).alias("similarity"))


@query("SELECT count(*) AS asked, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_nearest_cells(spark, d):
    """The nearest cells alone, as many as a sample of queries needs: of the exact ten, nine are found on the whole."""
    index, asked = _index(spark, d)
    found = vectors.nearest(index, asked, "vec_id", "embedding", probes=vectors.probes_for(index, asked, "vec_id", "embedding"))
    exact = vectors.exact_nearest(index, asked, "vec_id", "embedding").select("id", "neighbour")
    hit = exact.join(found.select("id", "neighbour", F.lit(1).alias("hit")), ["id", "neighbour"], "left")
    return hit.agg(F.countDistinct("id").alias("asked"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))
