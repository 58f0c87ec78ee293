import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismill.operators import joins, prefix, quantiles, recursion
from prismill.sources.scratch import Scratch


def test_asof_join_against_brute_force(spark):
    rng = random.Random(5)
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(20)])) for i in range(60)]
    right = [(rng.choice([1, 2, None]), rng.choice([None, *range(0, 20, 3)]), i) for i in range(12)]
    right = list({(k, t): (k, t, v) for k, t, v in right}.values())
    got = joins.asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int"), "k", "t", ["v"])
    for r in got.collect():
        before = [(t, v) for k, t, v in right if None not in (k, t, r.k, r.t) and k == r.k and t <= r.t]
        assert r.v_last == (max(before)[1] if before else None)
    assert got.count() == 60


def test_asof_join_in_cells_gives_the_same(spark):
    rng = random.Random(8)
    left = spark.createDataFrame([(i, rng.choice([1, 2, 3, None]), rng.choice([None, *range(60)])) for i in range(150)], "i int, k int, t int")
    right = spark.createDataFrame([(k, t, 100 * k + t) for k in (1, 2) for t in rng.sample(range(60), 6)] + [(None, 3, 1), (1, None, 2)], "k int, t int, v int")
    whole = joins.asof_join(left, right, "k", "t", ["v"])
    cells = joins.asof_join(left, right, "k", "t", ["v"], cell=lambda c: F.floor(c / 7))
    assert sorted(map(str, cells.collect())) == sorted(map(str, whole.collect())) and cells.columns == whole.columns


def test_exact_quantile_against_sorting(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([None, rng.uniform(-9, 9), 3.0])) for g in ("a", "b") for _ in range(41)] + [("c", 5.0), ("d", None)]
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in quantiles.exact_quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share, 0.5, "q").collect()}
        want = {g: np.quantile([v for h, v in rows if h == g and v is not None], share) for g in "abc"}
        assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_tables_are_sent_out_by_their_size(spark):
    d = spark.range(100).selectExpr("id AS k")
    plan = lambda limit: d.join(joins.sized_broadcast(d, limit), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10_000) and "strategy=broadcast" not in plan(10)


def test_range_join_against_brute_force(spark):
    rng = random.Random(6)
    points = [(i, rng.uniform(-50, 50)) for i in range(200)] + [(200, None)]
    ranges = [(i, a := rng.uniform(-60, 50), a + rng.choice([0.0, 3.0, 25.0])) for i in range(40)]
    got = joins.range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(ranges, "r int, lo double, hi double"), "x", "lo", "hi", 5.0)
    want = sorted((p, r) for p, x in points for r, lo, hi in ranges if x is not None and lo <= x < hi)
    assert sorted((r.p, r.r) for r in got.collect()) == want


def test_salted_join_gives_the_same_rows(spark):
    big = spark.range(300).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, name string")
    got, want = joins.salted_join(big, small, "k", 4), big.join(small, "k")
    assert sorted(map(tuple, got.select("k", "v", "name").collect())) == sorted(map(tuple, want.select("k", "v", "name").collect()))


def test_interval_join_bounds(spark):
    a = spark.sql("SELECT 1 k, TIMESTAMP_NTZ '2024-01-01 00:00:00' a")
    b = spark.sql("SELECT 1 k, TIMESTAMP_NTZ '2024-01-01 00:00:10' b UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-01 00:00:11' UNION ALL SELECT 1, TIMESTAMP_NTZ '2023-12-31 23:59:59'")
    assert joins.interval_join(a, b, "k", F.col("a"), F.col("b"), 10).count() == 1


@pytest.mark.parametrize("k", [1, 2])
def test_top_per_group(spark, k):
    d = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 9)], "g string, v int")
    got = joins.top_per_group(d, ["g"], [F.desc("v")], k)
    assert got.count() == k + 1


def test_quantiles_with_nan_infinities_ties_and_large_numbers(spark, monkeypatch):
    rng = random.Random(12)
    pool = [float("nan"), float("inf"), float("-inf"), None, 0.0, -0.0, 2.0**53 + 2, -(2.0**60), 1e300, 3.0, 3.0, 3.0]
    rows = [(g, rng.choice(pool) if rng.random() < 0.3 + 0.2 * i else rng.uniform(-9, 9)) for i, g in enumerate(["a", "b", None]) for _ in range(300)]
    rows += [("nan", float("nan"))] * 3 + [("x", 1.0), ("x", 2.0), ("x", float("nan")), ("none", None)]
    d = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for most in (50_000, 10):  # whole cells, and cells that are cut again and again
        monkeypatch.setattr(quantiles, "MOST", most)
        monkeypatch.setattr(quantiles, "CUTS", 4 if most == 10 else 256)
        for share in (0.0, 0.37, 0.5, 0.99, 1.0):
            got = {r.g: r.q for r in quantiles.exact_quantile(d, ["g"], "v", share, 0.5, "q").collect()}
            want = {r.g: r.q for r in d.where("v IS NOT NULL").groupBy("g").agg(F.expr(f"percentile(v, {share}D)").alias("q")).collect()}
            assert got.keys() == want.keys()
            assert all(str(got[g]) == str(want[g]) or abs(got[g] - want[g]) <= 1e-12 * abs(want[g]) for g in want), (most, share, got, want)


def test_quantile_of_one_value_that_all_rows_share(spark):
    d = spark.range(20_000).select(F.lit("k").alias("g"), F.lit(7).alias("v"))
    assert quantiles.exact_quantile(d, ["g"], "v", 0.5, 1.0, "q").first().q == 7.0


def test_asof_join_of_hot_keys_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    left = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(60)])) for i in range(150)], "i int, k int, t int")
    right = spark.createDataFrame([(k, t, 100 * k + t) for k in (1, 2, 3) for t in rng.sample(range(60), 6)] + [(None, 3, 1), (1, None, 2)], "k int, t int, v int")
    whole = joins.asof_join(left, right, "k", "t", ["v"])
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    cells = joins.asof_join(left, right, "k", "t", ["v"], cell=lambda c: F.floor(c / 7))
    assert sorted(map(str, cells.collect())) == sorted(map(str, whole.collect())) and cells.columns == whole.columns


def test_reachable_against_search_from_each_start(spark):
    rng = random.Random(2)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(i, i + 1) for i in range(100, 130)] + [(130, 100), (5, None), (None, 5), (7, 7)]
    starts = [(1, 1), (1, 100), (2, 100), (3, 999), (4, None), (1, 1)]
    got = recursion.reachable(spark.createDataFrame(starts, "source int, node int"), spark.createDataFrame(links, "a int, b int"))
    want = {}
    for s, first in set(starts):
        frontier, depth = {first} - {None}, 0
        while frontier:
            for n in frontier:
                want[s, n] = min(depth, want.get((s, n), depth))
            frontier, depth = {b for a, b in links if a in frontier and b is not None and want.get((s, b), 1e9) > depth + 1}, depth + 1
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(s, n): d for s, n, d in rows} == want and max(want.values()) == 30
    assert recursion.reachable(spark.createDataFrame(starts, "source int, node int"), spark.createDataFrame(links, "a int, b int"), most=2).agg(F.max("depth")).first()[0] == 2
    assert recursion.reachable(spark.createDataFrame(starts[:0], "source int, node int"), spark.createDataFrame(links, "a int, b int")).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_running_totals_and_ranks_without_a_partition(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 2, rng.randrange(30)]), rng.choice([None, 1, 5, -3]), "kept") for i in range(400)]
    d = spark.createDataFrame(rows, "id int, k int, v long, rank string")
    got = prefix.running(d, ["k"], ["id"], "v", ranges)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want, total, kinds = [], 0, []
    for i, (n, k, v, _) in enumerate(ordered):
        total += v or 0
        if not kinds or kinds[-1][0] != k:
            kinds.append((k, i))
        want.append((n, k, v, i + 1, kinds[-1][1] + 1, len(kinds), total))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert prefix.running(d.limit(0), ["k"], ["id"], "v", ranges).count() == 0


def test_what_reachable_writes_has_a_row_for_each_group_of_sources(spark, monkeypatch):
    written, plain = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: (written.append((name, plain(self, df, name))), written[-1][1])[1])
    monkeypatch.setattr(Scratch, "drop", lambda self, table: None, raising=False)
    n = 130
    starts = spark.range(n).select("id", F.lit(0).cast("long").alias("node")).toDF("source", "node").coalesce(1)
    links = spark.range(40).selectExpr("id AS a", "(id + 1) % 40 AS b")
    got = recursion.reachable(starts, links)
    assert got.count() == n * 40 and got.where("depth <> node").count() == 0
    assert max(t.count() for name, t in written if name not in ("starts", "sources")) <= 40 * (n // 64 + 4 + 1)  # four partitions at most


def test_reachable_with_more_sources_than_a_group_has(spark):
    rng = random.Random(3)
    links = [(rng.randrange(50), rng.randrange(50)) for _ in range(90)] + [(49, 60 + k) for k in range(40)]
    starts = [(7 * s, rng.randrange(50)) for s in range(1300)] + [(7, 3), (-5, 3)]
    settings = [(k, spark.conf.get(k, None)) for k in (*recursion.SETTINGS, *recursion.PARTITIONS)]
    got = recursion.reachable(spark.createDataFrame(starts, "source long, node long"), spark.createDataFrame(links, "a long, b long"))
    assert [(k, spark.conf.get(k, None)) for k, _ in settings] == settings
    want = {}
    for s, first in set(starts):
        frontier, depth = {first}, 0
        while frontier:
            want.update({(s, n): min(depth, want.get((s, n), depth)) for n in frontier})
            frontier, depth = {b for a, b in links if a in frontier and want.get((s, b), 1e9) > depth + 1}, depth + 1
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(s, n): d for s, n, d in rows} == want


def test_a_round_of_reachable_has_a_row_for_hundreds_of_sources(spark, monkeypatch):
    folders, plain = {}, Scratch.folder
    monkeypatch.setattr(Scratch, "folder", lambda self, name: folders.setdefault(name, plain(self, name)) if name == "rounds" else plain(self, name))
    links = spark.range(40).selectExpr("id AS a", "(id + 1) % 40 AS b")
    got = recursion.reachable(spark.range(500).selectExpr("id AS source", "0L AS node"), links)
    assert got.count() == 500 * 40 and got.where("depth <> node").count() == 0
    assert spark.read.parquet(folders["rounds"]).count() <= 2 * 40  # what was found, and what had been seen at the end


def test_groups_of_reachable_are_full_whatever_the_partitions(spark, monkeypatch):
    folders, plain = {}, Scratch.folder
    monkeypatch.setattr(Scratch, "folder", lambda self, name: folders.setdefault(name, plain(self, name)) if name == "rounds" else plain(self, name))
    monkeypatch.setattr(recursion, "_deal", lambda scratch, size: [scratch.spark.conf.set(k, v) for k, v in zip(recursion.PARTITIONS, (9, "false"))])
    got = recursion.reachable(spark.range(300).selectExpr("id AS source", "0L AS node"), spark.range(3).selectExpr("id AS a", "id + 1 AS b"))
    assert got.count() == 300 * 4 and got.where("depth <> node").count() == 0
    assert spark.read.parquet(folders["rounds"]).count() <= 2 * 4
