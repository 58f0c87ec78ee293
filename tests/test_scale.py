"""Layouts that readers skip in, and exact sums, measured and against brute force."""

import math
import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prismill.operators import exact_sum
from prismill.plans import scale
from prismill.sources import layout


def places(at):
    return Path(at.removeprefix("file://"))


def test_only_files_of_the_days_asked_for_are_read(spark, tiny):
    at = scale.daily_layout(spark, tiny)
    days = spark.read.parquet(f"{tiny}/events.parquet").select(F.to_date("ts").alias("day")).distinct().count()
    assert len(list(places(at).glob("day=*"))) == days
    e = spark.read.parquet(at)
    some = spark.createDataFrame([("2024-01-10",), ("2024-01-12",)], "d string").select(F.col("d").cast("date").alias("day"))
    found = e.join(F.broadcast(some.where("day > DATE '2024-01-01'")), "day", "left_semi")
    n = len(found.collect())
    read = layout.files_read(found)
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    assert 0 < n and 2 <= read["files"] <= 4 < days  # two days of files, and at most those of the small table


def test_row_groups_and_bloom_filters_skip(spark, tmp_path):
    d = spark.range(40_000).select((F.col("id") % 2).alias("day"), F.xxhash64("id").alias("k"), F.col("id").cast("string").alias("name"))
    at = str(tmp_path / "t")
    layout.write_sorted(d, at, "day", ["k"], bloom=["name"], group_bytes=64 << 10)
    files = list(Path(at).rglob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.num_row_groups for f in files]
    assert sum(groups) > 2 * len(files)
    for f in files:  # sorted, so row groups hold ranges that don't overlap
        m = pq.ParquetFile(f).metadata
        bounds = [m.row_group(i).column(0).statistics for i in range(m.num_row_groups)]
        assert all(a.max <= b.min for a, b in zip(bounds, bounds[1:]))
    one = d.where("name = '777'").first()
    for where in (f"k = {one.k}", "name = '777'", "name = '777x'"):
        found = spark.read.parquet(at).where(where)
        assert len(found.collect()) == (where != "name = '777x'")
        assert layout.files_read(found)["rows"] < 20_000, where


def test_replacing_partitions_leaves_the_others(spark, tmp_path):
    at = str(tmp_path / "t")
    layout.write_sorted(spark.range(90).select((F.col("id") % 3).alias("p"), "id"), at, "p", ["id"], parts=2)
    layout.write_sorted(spark.range(5).select(F.lit(1).cast("long").alias("p"), "id"), at, "p", ["id"], mode="replace")
    assert {r.p: r["count"] for r in spark.read.parquet(at).groupBy("p").count().collect()} == {0: 30, 1: 5, 2: 30}


def test_exact_parts_keep_the_sum():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-20, 20) for _ in range(rng.randint(0, 30))]
        parts = exact_sum.exact_parts(x)
        assert math.fsum(parts) == math.fsum(x) and math.fsum([*parts, *(-v for v in x)]) == 0
        assert all(abs(b) <= abs(a) * 2**-52 for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("held", [50_000, 1])
def test_exact_sums_against_exact_arithmetic(spark, monkeypatch, held):
    rng = random.Random(7)
    monkeypatch.setattr(exact_sum, "HELD", held)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1e16, -1e16, 1.0, 1e-9, rng.gauss(0, 1e5), None])) for _ in range(3000)]
    rows += [("inf", math.inf), ("inf", 1.0), ("nan", math.inf), ("nan", -math.inf), ("none", None)]
    want = {k: math.fsum(v for q, v in rows if q == k and v is not None) for k in ("hot", "b", None)}
    for parts in (1, 9):
        got = {r.g: r.s for r in exact_sum.exact_sum(spark.createDataFrame(rows, "g string, v double").repartition(parts), ["g"], "v", "s").collect()}
        assert {k: got[k] for k in want} == want and got["inf"] == math.inf and math.isnan(got["nan"]) and got["none"] is None and len(got) == 6
    assert exact_sum.exact_sum(spark.createDataFrame([], "g string, v double"), ["g"], "v", "s").count() == 0
