"""Recursion over a table of links, as rounds that look at new rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from prismill.sources.scratch import Scratch

#: With the first a written table's shuffle files go when it has been written, not when the driver collects its garbage; with the second a task writes both parts of a round without sorting.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "2"}
#: Shuffles of a round have a partition for so many bytes of the files that it reads; a fixed number makes small rounds wait for files. Joins of partitions that are smaller than half of it need no sorting.
EACH, LEAST = 16 << 20, 1 << 20
PARTITIONS = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
#: Words of 64 bits, one bit for each source of a group.
WORDS = 8


def reachable(start: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """From (source, node) along links (a, b) every (source, node, depth): each pair once, with the fewest links that lead there.

    Sources go in groups of 64 times ``WORDS``, a bit for each: a row (grp, node,
    bits) stands for up to as many pairs, so what rounds read, shuffle and write has a
    row for each group and node, and single pairs are made only as the result is read.
    A round is one job: it follows the links of the bits that the last one found and
    keeps those that are new, until none is or ``most`` links are used. So depth and
    rows are bounded by the data, cycles end, and no pair is followed twice. What
    rounds found is kept; what had been seen is kept of the last one. A node with very
    many links is a join side that can be split.
    Nulls in links or starts lead nowhere; repeated links and starts count once;
    no start or no link give what there is.
    """
    conf = start.sparkSession.conf
    before = {k: conf.get(k, None) for k in [*SETTINGS, *PARTITIONS]}
    for k, v in SETTINGS.items():
        conf.set(k, v)
    try:
        return _reachable(start, links, most, Scratch(start.sparkSession, "reachable"))
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def _reachable(start: DataFrame, links: DataFrame, most: int | None, scratch: Scratch) -> DataFrame:
    links = scratch.table(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "links")
    first = scratch.table(start.where("source IS NOT NULL AND node IS NOT NULL").select("source", "node").distinct(), "starts")
    _deal(scratch, scratch.size(*first.inputFiles()))
    # Numbers begin at a multiple of 2^33 in each partition; with the sources of the partitions before they are dense, so a group's bits are places in its lists of members, one for each word.
    dealt = first.select("source").distinct().repartitionByRange("source").sortWithinPartitions("source")
    dealt = scratch.table(dealt.withColumn("i", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("i", 33).alias("part")
    before = dealt.groupBy(part).agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    dealt = dealt.withColumn("part", part).join(F.broadcast(before), "part").select("source", F.expr("i - shiftleft(part, 33) + before").alias("i"))
    group, word = F.expr(f"i div {64 * WORDS}").alias("grp"), F.expr(f"CAST(i % {64 * WORDS} div 64 AS INT)").alias("word")
    members = dealt.groupBy(group, word).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "source"))), lambda x: x["source"]).alias("members"))
    members = scratch.table(members, "members")
    bits, new, seen = ([f"{name}{w}" for w in range(WORDS)] for name in ("bits", "new", "seen"))
    first = first.join(dealt, "source").select(group, "node", word, F.expr("shiftleft(1L, CAST(i & 63 AS INT))").alias("bit"))
    found = first.groupBy("grp", "node").agg(*(F.expr(f"bit_or(IF(word = {w}, bit, 0L)) AS {x}") for w, x in enumerate(bits)))
    rounds, depth, read, links_size = scratch.folder("rounds"), 0, start.sparkSession.read.schema(found.schema), scratch.size(*links.inputFiles())
    _write(found.select("grp", "node", *_as(bits, new), *_as(bits, seen)), f"{rounds}/depth=0")
    while (most is None or depth < most) and (fresh := scratch.size(f"{rounds}/depth={depth}/fresh=true")):
        last = f"{rounds}/depth={depth}"
        _deal(scratch, links_size + 8 * fresh + scratch.size(f"{last}/fresh=false"))  # a node has several links
        step = read.parquet(f"{last}/fresh=true").join(links, F.col("node") == F.col("a")).groupBy("grp", F.col("b").alias("node")).agg(*(F.bit_or(x).alias(x) for x in bits))
        both = step.join(read.parquet(f"{last}/fresh=false").select("grp", "node", *_as(bits, seen)), ["grp", "node"], "full")
        depth += 1
        got, known = ([f"coalesce({x}, 0L)" for x in names] for names in (bits, seen))
        _write(both.select("grp", "node", *_as([f"{x} & ~{y}" for x, y in zip(got, known, strict=True)], new), *_as([f"{x} | {y}" for x, y in zip(got, known, strict=True)], seen)), f"{rounds}/depth={depth}")
        scratch.delete(f"{last}/fresh=false")
    found = start.sparkSession.read.schema(StructType([*found.schema, StructField("depth", IntegerType()), StructField("fresh", BooleanType())])).parquet(rounds).where("fresh")
    words = found.select("grp", "node", "depth", F.inline(F.array(*(F.struct(F.lit(w).alias("word"), F.col(x).alias("bits")) for w, x in enumerate(bits))))).where("bits <> 0")
    pairs = words.join(members, ["grp", "word"]).select("node", "depth", "bits", F.posexplode("members").alias("i", "source"))
    return pairs.where("getbit(bits, i) = 1").select("source", "node", "depth")


def _deal(scratch: Scratch, size: int) -> None:
    """From now on shuffles have as many partitions as that many bytes take: evenly over all cores, or over fewer where it is little."""
    cores = scratch.spark.sparkContext.defaultParallelism
    parts = min(cores, 1 + size // LEAST) * max(1, -(-size // (EACH * cores)))
    for k, v in zip(PARTITIONS, (parts, "false", EACH // 2, EACH // 2), strict=True):
        scratch.spark.conf.set(k, v)


def _as(values: list[str], names: list[str]) -> list[Column]:
    return [F.expr(v).alias(n) for v, n in zip(values, names, strict=True)]


def _write(state: DataFrame, at: str) -> None:
    """A round in two parts: what it found, where it found something, and what has been seen by its end."""
    new, seen = ([f"{name}{w}" for w in range(WORDS)] for name in ("new", "seen"))
    part = lambda fresh, names: F.struct(F.lit(fresh).alias("fresh"), *(F.col(x).alias(f"bits{w}") for w, x in enumerate(names)))
    some = F.expr(" OR ".join(f"{x} <> 0" for x in new))
    parts = F.when(some, F.array(part(True, new), part(False, seen))).otherwise(F.array(part(False, seen)))
    state.select("grp", "node", F.inline(parts)).write.partitionBy("fresh").options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(at)
