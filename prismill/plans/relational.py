"""Relational queries over the star schema, each with DuckDB's form of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismill.functions import columns
from prismill.operators import joins, quantiles

QUERIES = {}
ORACLES = {}


def query(sql: str):
    """Register a plan under its name, with the SQL that DuckDB runs for it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY ALL""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("2001-06-01").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"),
    )


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('R', 'A')""")
def scan_pushdown(spark, d):
    t = table(spark, d, "lineitem")
    when = (F.col("l_shipdate") >= ts("1997-01-01")) & (F.col("l_shipdate") < ts("1997-02-01"))
    return t.where(when & F.col("l_discount").between(0.05, 0.07) & F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT p_partkey, upper(p_brand) AS brand, p_size * 2 AS doubled FROM part
WHERE p_type ILIKE '%STEEL%' OR p_name LIKE '%a%' AND p_size BETWEEN 10 AND 20 AND NOT p_brand = 'Brand#11'""")
def filter_like(spark, d):
    p = table(spark, d, "part")
    keep = F.col("p_type").ilike("%STEEL%") | (F.col("p_name").like("%a%") & F.col("p_size").between(10, 20) & ~(F.col("p_brand") == "Brand#11"))
    return p.where(keep).select("p_partkey", F.upper("p_brand").alias("brand"), (F.col("p_size") * 2).alias("doubled"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""")
def join_multiway(spark, d):
    t = {n: table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "nation")}
    o = t["orders"].where((F.col("o_orderdate") >= ts("1996-01-01")) & (F.col("o_orderdate") < ts("1998-01-01")))
    j = t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).join(t["nation"], F.col("n_nationkey") == F.col("s_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def join_left(spark, d):
    # The fact side is summed before it is joined: one row per order goes through the join.
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""
SELECT c_custkey, user_id, n FROM customer FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON c_custkey = user_id""")
def join_full(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(e, c["c_custkey"] == e["user_id"], "full")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45")
    return table(spark, d, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey <= n_regionkey")
def join_theta(spark, d):
    return table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") <= F.col("n_regionkey")).select("r_name", "n_name")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def join_cross(spark, d):
    # Five rows on each side, whatever the scale.
    r = table(spark, d, "region")
    return r.select(F.col("r_name").alias("a")).crossJoin(r.select(F.col("r_name").alias("b")))


@query("""
SELECT c.event_id, c.user_id, p.value AS value_last FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def join_asof(spark, d):
    e = table(spark, d, "events")
    clicks, buys = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'")
    return joins.asof_join(clicks, buys, "user_id", "ts", ["value"], cell=columns.day).select("event_id", "user_id", "value_last")


@query("""
SELECT a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id
WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR""")
def join_interval(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("a_ts"), F.col("event_id").alias("first_id"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("b_ts"), F.col("event_id").alias("second_id"))
    return joins.interval_join(a, b, "user_id", F.col("a_ts"), F.col("b_ts"), 6 * 3600).select("first_id", "second_id")


@query("""
WITH bands AS (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 25 AS high FROM supplier)
SELECT s_suppkey, count(*) AS n FROM customer JOIN bands ON c_acctbal >= low AND c_acctbal < high GROUP BY s_suppkey""")
def join_range(spark, d):
    bands = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    found = joins.range_join(table(spark, d, "customer").select("c_acctbal"), bands, "c_acctbal", "low", "high", 25.0)
    return found.groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("""
SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, l_returnflag FROM lineitem GROUP BY l_returnflag""")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY o_orderpriority""")
def agg_filtered(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS TINYINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def agg_grouping_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[s], [p], []], s, p).agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("g"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 6) AS p90, round(median(l_extendedprice), 6) AS mid, round(stddev_samp(l_quantity), 6) AS spread, round(var_pop(l_discount), 8) AS var_discount,
       round(corr(l_quantity, l_extendedprice), 6) AS together, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag""")
def agg_statistics(spark, d):
    # Three flags hold all rows, so quantiles come from histograms and not from all values in three tasks.
    t, flag = table(spark, d, "lineitem"), ["l_returnflag"]
    out = t.groupBy(*flag).agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("spread"), F.round(F.var_pop("l_discount"), 8).alias("var_discount"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("together"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"),
    )
    p90 = quantiles.exact_quantile(t, flag, "l_quantity", 0.9, 1.0, "p90")
    mid = quantiles.exact_quantile(t, flag, "l_extendedprice", 0.5, 100.0, "mid")
    return out.join(p90, flag).join(mid, flag).withColumns({"p90": F.round("p90", 6), "mid": F.round("mid", 6)})


@query("""
SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, arg_min(c_custkey, (c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey""")
def agg_arg_extremes(spark, d):
    order = F.struct("c_acctbal", "c_custkey")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", order).alias("richest"), F.min_by("c_custkey", order).alias("poorest"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_strings(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def reshape_pivot(spark, d):
    # Values are named, so no job has to look for them first.
    p = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return p.fillna(0)


@query("""
SELECT s_suppkey, 'nation' AS field, CAST(s_nationkey AS BIGINT) AS value FROM supplier UNION ALL SELECT s_suppkey, 'key', s_suppkey FROM supplier""")
def reshape_unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").alias("key"))
    return s.unpivot("s_suppkey", ["nation", "key"], "field", "value")


@query("""
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER p AS INTEGER) AS rk, CAST(dense_rank() OVER p AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter, round(percent_rank() OVER p, 9) AS pr
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranking(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    p = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("rk"), F.dense_rank().over(p).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(p), 9).alias("pr")
    )


@query("""
SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_id) OVER w AS first_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS last_buy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_offsets(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    buy = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, d, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("event_id").over(w).alias("first_id"), F.last(buy, ignorenulls=True).over(w).alias("last_buy")
    )


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_count FROM events""")
def window_frames(spark, d):
    table(spark, d, "events").createOrReplaceTempView("events_frames")
    return spark.sql("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last3,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_count FROM events_frames""")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def limit_offset(spark, d):
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").offset(40).limit(20).select("o_orderkey")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 3""")
def top_per_group(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return joins.top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("""
SELECT p_partkey, lower(p_name) AS low, CAST(length(p_name) AS INTEGER) AS n, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS masked, md5(p_name) AS digest, substr(p_type, 1, 4) AS part, reverse(p_brand) AS turned, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part""")
def functions_string(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.length("p_name").alias("n"), F.regexp_replace("p_brand", "[0-9]+", "#").alias("masked"), F.md5("p_name").alias("digest"), F.substring("p_type", 1, 4).alias("part"),
        F.reverse("p_brand").alias("turned"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
    )


@query("""
SELECT date_trunc('month', o_orderdate) AS m, CAST(year(min(o_orderdate)) AS INTEGER) AS y, CAST(max(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS INTEGER) AS days, count(*) AS n FROM orders GROUP BY 1""")
def functions_date(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(columns.month(F.col("o_orderdate")).alias("m")).agg(F.year(F.min("o_orderdate")).alias("y"), F.max(F.datediff("o_orderdate", ts("1995-01-01"))).alias("days"), F.count("*").alias("n"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity), 9) AS root, CAST(floor(l_extendedprice / 100) AS BIGINT) AS cell, round(ln(l_quantity), 9) AS log, abs(l_tax - l_discount) AS gap, CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def functions_math(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.sqrt("l_quantity"), 9).alias("root"), F.floor(F.col("l_extendedprice") / 100).alias("cell"), F.round(F.ln("l_quantity"), 9).alias("log"),
        F.abs(F.col("l_tax") - F.col("l_discount")).alias("gap"), columns.share(F.col("l_tax"), F.col("l_discount")).alias("ratio"),
    )


@query("""
SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding)::DOUBLE, 6) AS top, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square FROM embeddings""")
def functions_array(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max(e).cast("double"), 6).alias("top"), F.round(columns.dot(e, e), 6).alias("square")
    )


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def functions_json(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer i WHERE i.c_nationkey = c.c_nationkey)""")
def subquery_correlated(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer_sub")
    return spark.sql("SELECT c_custkey, c_acctbal FROM customer_sub c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer_sub i WHERE i.c_nationkey = c.c_nationkey)")


TREE = """
WITH RECURSIVE t(node, depth, nations) AS (
  SELECT s_suppkey, 0, CAST(s_nationkey AS BIGINT) FROM {supplier} WHERE s_suppkey = 1
  UNION ALL SELECT c.s_suppkey, t.depth + 1, t.nations + c.s_nationkey FROM t JOIN {supplier} c ON c.s_suppkey {div} 2 = t.node AND c.s_suppkey > 1)
SELECT node, depth, nations FROM t"""


@query(TREE.format(supplier="supplier", div="//"))
def recursive_cte(spark, d):
    """Suppliers as a tree by halves of their keys, with what adds up on the way down. Spark holds such a recursion to 100 levels and a million rows; ``recursive_reach`` has no such bound."""
    table(spark, d, "supplier").createOrReplaceTempView("supplier_tree")
    return spark.sql(TREE.format(supplier="supplier_tree", div="DIV"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
SELECT start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS start FROM events) GROUP BY start""")
def window_sliding(spark, d):
    w = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark, d):
    s = table(spark, d, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
def join_lateral(spark, d):
    order = [F.desc("c_acctbal"), F.col("c_custkey")]
    best = joins.top_per_group(table(spark, d, "customer"), ["c_nationkey"], order, 2)
    return table(spark, d, "nation").join(best, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey", "c_acctbal")
