"""More relational queries: joins with sizes checked, modes, sketches with their bounds, maps, variants, vectors, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismill.functions import columns
from prismill.operators import joins
from prismill.plans.relational import query, revenue, table
from prismill.sources import files
from prismill.sources.scratch import Scratch


@query("""
SELECT c_custkey, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) RIGHT JOIN customer ON c_custkey = user_id""")
def join_right(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.join(table(spark, d, "customer").select("c_custkey"), F.col("user_id") == F.col("c_custkey"), "right").select("c_custkey", "n")


@query("""
SELECT s_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def join_broadcast(spark, d):
    s = joins.sized_broadcast(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    return table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("""
SELECT l_suppkey, v AS commonest FROM (SELECT l_suppkey, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE k = 1""")
def agg_mode(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.mode("l_quantity", True).alias("commonest"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS near, true AS merged FROM lineitem GROUP BY l_returnflag")
def sketch_distinct(spark, d):
    """Sketches of finer groups are merged; near: within five standard errors of the exact count."""
    t = table(spark, d, "lineitem")
    fine = t.groupBy("l_returnflag", "l_linestatus").agg(F.hll_sketch_agg("l_partkey", 12).alias("s"))
    merged = fine.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("est"))
    exact = t.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.approx_count_distinct("l_partkey", 0.02).alias("approx"))
    close = lambda c, error: F.abs(F.col(c) - F.col("parts")) <= 5 * error * F.col("parts") + 1
    return exact.join(merged, "l_returnflag").select("l_returnflag", "parts", close("approx", 0.02).alias("near"), close("est", 0.02).alias("merged"))


@query("SELECT l_returnflag, count(*) AS n, true AS near FROM lineitem GROUP BY l_returnflag")
def sketch_quantile(spark, d):
    """The rank of a sketched median is at most a thousandth of the rows away from the middle."""
    t = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    mid = t.groupBy("l_returnflag").agg(F.approx_percentile("l_extendedprice", 0.5, 2000).alias("mid"), F.count("*").alias("n"))
    ranks = t.join(F.broadcast(mid), "l_returnflag").groupBy("l_returnflag", "n").agg(F.count_if(F.col("l_extendedprice") < F.col("mid")).alias("below"), F.count_if(F.col("l_extendedprice") <= F.col("mid")).alias("upto"))  # three rows
    half, off = F.col("n") / 2, F.col("n") / 1000 + 1
    return ranks.select("l_returnflag", "n", ((F.col("below") <= half + off) & (F.col("upto") >= half - off)).alias("near"))


@query("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(DISTINCT o_orderstatus) AS kinds, count(*) AS n FROM orders GROUP BY o_custkey""")
def functions_map(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    m = n.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))  # three statuses at most
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    done = F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0).cast("long"))
    return m.select("o_custkey", done.alias("done"), F.size(F.map_keys(F.map_filter("m", lambda k, v: v > 0))).cast("long").alias("kinds"), total.alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS missing FROM events")
def functions_json_schema(spark, d):
    parsed, loose = F.from_json("props", "k long, none string"), F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.variant_get(loose, "$.k", "long")).alias("k"), F.try_variant_get(loose, "$.none", "string").isNull().alias("missing"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def rows_repeated(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def rows_distinct(spark, d):
    return table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i)
SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 5) AS cosine FROM x JOIN c USING (label, i) GROUP BY vec_id""")
def vector_cosine(spark, d):
    """Each vector's cosine with the mean of its label: labels are few, their means one row each."""
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    means = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))  # as many as a vector has numbers
    v, m = F.col("embedding"), F.col("mean")
    return e.join(joins.sized_broadcast(means), "label").select("vec_id", F.round(columns.dot(v, m) / (columns.norm(v) * columns.norm(m)), 5).alias("cosine"))


def _round_trip(spark, d, kind):
    at, part = Scratch(spark, "files").folder(kind), table(spark, d, "part")
    files.write(part, at, kind, partition_by=["p_size"])
    return files.read(spark, at, part.schema, kind).where("p_size < 20").select("p_partkey", "p_name", "p_size", F.round("p_retailprice", 2).alias("price"))


PARTS = "SELECT p_partkey, p_name, p_size, round(p_retailprice, 2) AS price FROM part WHERE p_size < 20"


@query(PARTS)
def source_csv(spark, d):
    return _round_trip(spark, d, "csv")


@query(PARTS)
def source_json(spark, d):
    return _round_trip(spark, d, "json")


@query(PARTS)
def source_orc(spark, d):
    return _round_trip(spark, d, "orc")
