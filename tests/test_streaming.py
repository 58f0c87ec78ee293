"""Streams are drained and held against the same plan over the whole table."""

from pyspark.sql import functions as F

from prismill.plans import relational
from prismill.streaming import events, keyed, replay


def drained(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def source(spark, tiny):
    return events.stream(spark, tiny, "events.parquet")


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_tumbling(spark, tiny, tmp_path):
    same(drained(events.tumbling(source(spark, tiny), "1 day"), "tumbling", tmp_path, "complete"), relational.window_tumbling(spark, tiny))


def test_sliding(spark, tiny, tmp_path):
    same(drained(events.sliding(source(spark, tiny), "2 hours", "1 hour"), "sliding", tmp_path, "complete"), relational.window_sliding(spark, tiny))


def test_sessions(spark, tiny, tmp_path):
    same(drained(events.sessions(source(spark, tiny), "2 hours"), "sessions", tmp_path, "complete"), relational.window_session(spark, tiny))


def test_deduplication_drops_replayed_files(spark, tiny, tmp_path):
    spark.read.parquet(f"{tiny}/events.parquet").repartition(1).write.parquet(str(tmp_path / "a"))
    spark.read.parquet(f"{tiny}/events.parquet").limit(300).repartition(1).write.mode("append").parquet(str(tmp_path / "a"))
    got = drained(events.deduplicated(events.stream(spark, str(tmp_path / "a"), "*.parquet", 10)), "dedup", tmp_path, "append")
    assert got.count() == spark.read.parquet(f"{tiny}/events.parquet").count()


def test_stream_join(spark, tiny, tmp_path):
    s = source(spark, tiny)
    got = drained(events.followed(s.where("event_type = 'view'"), s.where("event_type = 'purchase'"), "6 HOURS"), "followed", tmp_path, "append")
    want = relational.join_interval(spark, tiny)
    same(got.select("a", "b"), want.select(F.col("first_id").alias("a"), F.col("second_id").alias("b")))


def test_running_totals(spark, tiny, tmp_path):
    got = drained(events.running_totals(source(spark, tiny)), "totals", tmp_path, "update")
    last = got.groupBy("user_id").agg(F.max("n").alias("n"))
    same(last, spark.read.parquet(f"{tiny}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n")))


def test_late_rows_are_counted_as_dropped_and_state_shrinks(spark, tiny):
    from oracle import duck

    from prismill.plans import streams

    progress = []
    e = streams.replayed(spark, tiny)
    rows = streams.drained(events.tumbling(e, "1 day", late="1 day"), "append", progress)
    want = duck(replay.ORACLE + "SELECT count(*) AS all_, count(*) FILTER (WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= seen - INTERVAL 1 DAY) AS late, max(step) + 1 AS steps FROM r", tiny)
    state = [p.stateOperators[0] for p in progress]
    groups = [o.numRowsTotal for o in state]
    # Rows that are dropped are counted once for each group and batch that they would have gone to.
    assert want.late[0] >= 5 and 0 < sum(o.numRowsDroppedByWatermark for o in state) <= want.late[0]
    assert rows.agg(F.sum("n")).first()[0] <= want.all_[0] - want.late[0]
    marks = [p.eventTime.get("watermark") for p in progress if p.numInputRows]
    assert len(marks) == want.steps[0] and marks == sorted(marks) and len(set(marks)) > 5
    assert max(groups) < rows.count() / 2 and groups[-1] < max(groups)


def test_steps_hold_every_event_and_come_in_order(spark, tiny, tmp_path):
    whole = spark.read.parquet(f"{tiny}/events.parquet")
    n = replay.write(whole, str(tmp_path / "steps"), close=["view"])
    back = spark.read.parquet(str(tmp_path / "steps"))
    assert back.where("event_id >= 0").count() == whole.count() and back.where("event_id < 0").count() == 1
    number = replay.steps(whole)
    assert n == number.agg(F.max("step")).first()[0] + 2
    out_of_order = number.alias("a").join(number.alias("b"), F.expr("a.ts < b.ts AND a.step > b.step")).count()
    assert out_of_order > 100


def test_a_batch_is_a_step_also_in_several_files(spark, tiny, tmp_path):
    from prismill.plans import streams

    whole = spark.read.parquet(f"{tiny}/events.parquet")
    counts = {r.step: r["count"] for r in replay.steps(whole).groupBy("step").count().collect()}
    assert min(counts.values()) < 4  # so a step has fewer rows than files
    n = replay.write(whole, str(tmp_path / "steps"), 4, close=["view"])
    progress = []
    streams.drained(events.stream(spark, str(tmp_path / "steps"), "*.parquet", 4), "append", progress)
    assert [p.numInputRows for p in progress] == [counts.get(i, 0) for i in range(n - 1)] + [1]


def test_files_and_partitions_follow_the_rows(spark, tiny, monkeypatch):
    from prismill.plans import streams

    def shape():
        progress = []
        e, sized = streams._replayed(spark, tiny)
        streams.drained(events.tumbling(e, "1 day", late="1 day"), "append", progress, **sized)
        return {p.stateOperators[0].numShufflePartitions for p in progress if p.stateOperators}

    assert shape() == {streams.LEAST}
    monkeypatch.setattr(replay, "ROWS", 8)
    monkeypatch.setattr(streams, "LEAST", 1)
    top = replay.steps(spark.read.parquet(f"{tiny}/events.parquet")).groupBy("step").count().agg(F.max("count")).first()[0]
    assert shape() == {-(-top // 8)}


def test_pairs_at_the_ends_of_stretches(spark):
    at = lambda h: f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {h} HOURS"
    hours = [-13, -12, -7, -6, -1, 0, 5, 6, 11, 12, 13, 17, 18, 19, 24, 100]
    table = lambda k: spark.sql(" UNION ALL ".join(f"SELECT {k + i}L AS event_id, {at(h)} AS ts, 1L AS user_id" for i, h in enumerate(hours)))
    got = events.followed_or_not(table(0), table(100), "6 HOURS")
    want = [(i, 100 + j) for i, h in enumerate(hours) for j, g in enumerate(hours) if 0 <= g - h <= 6]
    assert sorted((r.a, r.b) for r in got.collect()) == want
    alone = events.followed_or_not(table(0), table(100).where("event_id > 104"), "6 HOURS").where("b IS NULL")
    assert sorted(r.a for r in alone.collect()) == [0, 1, 2]


def test_left_join_gives_nulls_only_when_the_watermark_has_passed(spark, tiny):
    from prismill.plans import streams

    e = streams.replayed(spark, tiny)  # no closing row: the last ten days stay open
    out = streams.drained(events.followed_or_not(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "6 HOURS", late="10 days"), "append")
    whole = spark.read.parquet(f"{tiny}/events.parquet")
    end = whole.agg(F.max("ts")).first()[0]
    alone = out.where("b IS NULL").join(whole, F.col("a") == F.col("event_id"))
    assert alone.count() > 10 and alone.where(F.col("ts") > F.lit(end) - F.expr("INTERVAL 10 DAYS 6 HOURS")).count() == 0


def test_sessions_by_timers_with_events_out_of_order(spark, tmp_path):
    minutes = {1: [0, 90, 30, 119, 300, 299, 421], 2: [5], 3: [1000, 0, 500, 120, 119]}
    rows = [(u, i, m) for u, times in minutes.items() for i, m in enumerate(times)]
    for i in range(max(map(len, minutes.values()))):  # one event of each user in each batch, as listed
        part = [(n, m, u) for n, (u, j, m) in enumerate(rows) if j == i]
        d = spark.createDataFrame(part, "event_id long, m long, user_id long")
        at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(m AS INT), 0)")
        whole = d.select("event_id", at.alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        whole.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole.limit(1).withColumn("ts", F.expr("TIMESTAMP_NTZ '2025-01-01 00:00:00'")).withColumn("user_id", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from prismill.plans import streams

    out = streams.drained(keyed.sessions(events.stream(spark, str(tmp_path / "in"), "*.parquet"), 7_200_000, late="20 hours"), "append", **keyed.STORE)
    minute = lambda t: int(t.timestamp() - 1704067200) // 60
    got = sorted((r.user_id, minute(r.start), minute(r.end), r.n) for r in out.collect())
    assert got == [(1, 0, 239, 4), (1, 299, 420, 2), (1, 421, 541, 1), (2, 5, 125, 1), (3, 0, 240, 3), (3, 500, 620, 1), (3, 1000, 1120, 1)]


class Handle:
    """State of one bucket, without Spark."""

    def __init__(self):
        self.kept, self.timers = {}, set()

    def getListState(self, name, shape):  # noqa: N802
        return State(self.kept, name)

    getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class State:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def exists(self):
        return self.name in self.kept

    def get(self):
        return self.kept[self.name]

    def update(self, value):
        self.kept[self.name] = value

    put = update

    def appendValue(self, value):  # noqa: N802
        self.kept.setdefault(self.name, []).append(value)

    def clear(self):
        self.kept.pop(self.name, None)


def test_one_state_holds_the_sessions_of_many_users():
    import random
    from types import SimpleNamespace

    import pandas as pd

    rng, gap = random.Random(4), 100
    users = [None, 0, -1, *range(5, 40)]
    seen = sorted({(rng.randrange(3000) * 1000 + rng.randrange(1000), rng.randrange(len(users))) for _ in range(1500)})
    handle, got = Handle(), []
    p = keyed.Sessions(gap)
    p.init(handle)
    for low in range(0, 5000, 400):  # batches, and out of order in each; the watermark is 700 behind
        part = [(t, users[u]) for t, u in seen if low <= t // 1000 < low + 400]
        rng.shuffle(part)
        frame = pd.DataFrame({"none": [u is None for _, u in part], "user_id": pd.array([u or 0 for _, u in part], "int64"), "at": pd.array([t for t, _ in part], "int64")})
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda low=low: low - 700)
        list(p.handleInputRows((1,), iter([frame]), mark))
        for at in [t for t in handle.timers if t <= low - 700]:
            handle.timers.remove(at)
            for f in p.handleExpiredTimer((1,), mark, None):
                got += [tuple(None if pd.isna(x) else int(x) for x in r) for r in f.itertuples(index=False)]
        assert len(handle.timers) <= 1
    want = []
    for u, name in enumerate(users):
        times = [t for t, v in seen if v == u]
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] >= gap * 1000:
                want.append([name, t, t, 0])
            want[-1][2:] = [t, want[-1][3] + 1]
    assert sorted(map(str, got)) == sorted(str(tuple(w)) for w in want) and not handle.timers and not handle.kept
