"""Nearest vectors by cosine with an index of cells: k-means cells, probes by cell, exact ranks among what they hold.

Rows of one and the same vector are one node, with its least ids. Means of
cells come from a bounded sample of nodes; every node goes to the cell of its
nearest mean and the table is written once. A cell also keeps its radius, the
greatest distance of a node from the mean, among vectors of length 1.

A search pairs each query with cells, never with rows. Nodes of a cell are
dealt into blocks of about ``BLOCK``, its queries into parts of about ``PART``,
and a task multiplies one part by one block at a time. So a cell that holds a third of all
rows is many tasks, and nothing larger than a block and a part is held. Products in single
precision choose what is compared again in double precision; only the best of
each query leave a task.

``nearest`` looks into so many nearest cells; ``probes_for`` fits that number to a
share of true neighbours, on ``TRIED`` queries. ``exact_nearest`` takes what a few cells hold as a bound and goes on with every cell that may hold something as near,
by the distance from its mean less its radius, so its result is whole.

Defined results
- a vector that is null, of another length than ``size``, all zeros, or with a null or a number that isn't finite: not in the index, and as a query without neighbours
- a query doesn't find its own id; equal vectors under other ids are found
- equal similarities (rounded to nine digits) by ascending id; fewer rows than asked for where there are no more
- repeated rows count once; an id with several vectors is found by each, and asks with each for one list of the best
- a null id is not in the index and no query; an empty table gives an empty table
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismill.sources.scratch import Scratch

#: Nodes that cells' means are made from, rounds of that, and cells at most (their means go to every task); below that as many as the root of the nodes.
SAMPLE, ROUNDS, MOST_CELLS = 20_000, 10, 4096
BLOCK, PART = 8192, 2048
#: Numbers that a task holds at once when rows meet means, or as pairs with vectors that it gives out.
HELD = 1 << 20
#: Queries that the number of probes is fitted on.
TRIED = 256
DIGITS = 9


def unit(column: str, size: int):
    """The vector at length 1 in double precision; null where it has no direction or another size."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    ok = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.coalesce(ok, F.lit(False)) & (length > 0), F.transform(v, lambda x: x / length))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def means(sample: np.ndarray, cells: int, seed: int = 5) -> np.ndarray:
    """Means of so many cells of a sample at most, by Lloyd's rounds; an empty cell takes the row that is farthest from its mean."""
    rng = np.random.default_rng(seed)
    m = sample[rng.permutation(len(sample))[: min(cells, len(sample))]]
    for _ in range(ROUNDS):
        far = (m**2).sum(1) - 2 * sample @ m.T
        own = far.argmin(1)
        n = np.bincount(own, minlength=len(m))
        total = np.zeros_like(m)
        np.add.at(total, own, sample)
        m = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], m)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            m[empty] = sample[np.argsort(-far[np.arange(len(sample)), own])[: len(empty)]]
    return m


@dataclass
class Cells:
    """An index: its means, the written nodes (cell, node, ids, v) and cells (cell, n, radius)."""

    mean: np.ndarray
    nodes: DataFrame
    cells: DataFrame
    size: int
    copies: int
    scratch: Scratch


def build(rows: DataFrame, key: str, vector: str, size: int, best: int = 10, cells: int | None = None) -> Cells:
    """Index every row. Of equal vectors the least ``best`` + 1 ids are kept, which is all that a search can return."""
    scratch = Scratch(rows.sparkSession, "cells")
    d = rows.select(F.col(key).alias("id"), unit(vector, size).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").distinct()
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("k") <= best + 1)  # cut before and after the shuffle
    node = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "v")
    node = scratch.table(node, "nodes")
    n = node.count()
    sample = node.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").collect()
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    mean = means(np.array([r.v for r in sample]), cells) if sample else np.zeros((1, size))
    kind = node.schema["node"].dataType.simpleString()

    def placed(batches):
        for b in batches:
            x = matrix(b.column("v"), size)
            own = np.concatenate([_far(x[r], mean).argmin(1) for r in _slices(len(x), len(mean))] or [np.zeros(0, int)])
            gap = np.sqrt(((x - mean[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(gap), *(b.column(c) for c in ("node", "ids", "v"))], names=["cell", "gap", "node", "ids", "v"])

    kept = scratch.table(node.mapInArrow(placed, f"cell int, gap double, node {kind}, ids array<{kind}>, v array<double>"), "placed")
    sizes = scratch.table(kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")), "cells")
    return Cells(mean, kept.drop("gap"), sizes, size, best + 1, scratch)


def _far(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Squared distances from the means, less what is the same for all of them."""
    return (mean**2).sum(1) - 2 * x @ mean.T


def _slices(rows: int, width: int) -> list[slice]:
    """Stretches of rows of so many numbers each that hold ``HELD`` numbers at most, or one row."""
    step = max(1, HELD // max(1, width))
    return [slice(i, min(rows, i + step)) for i in range(0, rows, step)]


def _pairs(b: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, size: int):
    """Pairs (q, v, cell) of a batch's rows and cells, in batches that are bounded however many cells a row has."""
    for r in _slices(len(row), size):
        at = pa.array(row[r])
        yield pa.RecordBatch.from_arrays([b.column("q").take(at), b.column("v").take(at), pa.array(cell[r])], names=["q", "v", "cell"])


def _probes(index: Cells, queries: DataFrame, probes: int, kind: str) -> DataFrame:
    """(q, v, cell) of each query's nearest cells; cells that hold nothing don't count."""
    live = sorted(r.cell for r in index.cells.select("cell").collect())  # MOST_CELLS numbers
    mean, live, size = index.mean[live], np.array(live, np.int32), index.size

    def run(batches):
        for b in batches:
            x = matrix(b.column("v"), size)
            k = min(probes, len(live))
            for r in _slices(len(x), len(live)):
                near = np.argpartition(_far(x[r], mean), k - 1, 1)[:, :k] if k else np.zeros((r.stop - r.start, 0), int)
                yield from _pairs(b, np.repeat(np.arange(r.start, r.stop), k), live[near.ravel()], size)

    return queries.select("q", "v").mapInArrow(run, f"q {kind}, v array<double>, cell int")


def _within(index: Cells, bounded: DataFrame, kind: str) -> DataFrame:
    """(q, v, cell) of cells that may hold something as near as the query's bound ``far``."""
    about = sorted((r.cell, r.radius) for r in index.cells.select("cell", "radius").collect())  # MOST_CELLS rows
    live, radius, size = np.array([c for c, _ in about], np.int32), np.array([r for _, r in about]), index.size
    mean = index.mean[live]

    def run(batches):
        for b in batches:
            x, far = matrix(b.column("v"), size), b.column("far").to_numpy()
            for r in _slices(len(x), len(live)):
                gap = np.sqrt(np.maximum(0, (x[r] ** 2).sum(1)[:, None] + _far(x[r], mean)))
                row, cell = np.nonzero(gap - radius <= far[r, None] + 1e-6)
                yield from _pairs(b, row + r.start, live[cell], size)

    return bounded.select("q", "v", "far").mapInArrow(run, f"q {kind}, v array<double>, cell int")


def _scanned(index: Cells, pairs: DataFrame, kind: str) -> DataFrame:
    """(q, ids, similarity): the best nodes of each query among those of its cells."""
    best, size = index.copies, index.size
    pairs = index.scratch.table(pairs, "pairs")
    load = pairs.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts")).join(index.cells.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks")), "cell")
    load = F.broadcast(index.scratch.table(load, "load"))  # MOST_CELLS rows
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = pairs.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).withColumn("block", spread("blocks")).select("cell", "part", "block", "q", "v")
    b = index.nodes.join(load, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("part", spread("parts")).select("cell", "part", "block", "ids", "v")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if left.num_rows and right.num_rows:
            x, y = matrix(left.column("v"), size), matrix(right.column("v"), size)
            first = np.array([i[0] for i in right.column("ids").to_pylist()])
            near = x.astype(np.float32) @ y.astype(np.float32).T
            k = min(best, len(y))
            least = -np.partition(-near, k - 1, 1)[:, k - 1] - 1e-5
            for row in range(len(x)):
                some = np.flatnonzero(near[row] >= least[row])
                s = np.round((y[some] * x[row]).sum(1), DIGITS)
                top = np.lexsort((first[some], -s))[:k]
                out_q.append(np.full(len(top), row))
                out_i.append(some[top])
                out_s.append(s[top])
        none = np.zeros(0, np.int64)
        q, i = (pa.array(np.concatenate([none, *v]), pa.int64()) for v in (out_q, out_i))
        return pa.table({"q": left.column("q").take(q), "ids": right.column("ids").take(i), "similarity": pa.array(np.concatenate([none.astype(float), *out_s]))})

    keys = ["cell", "part", "block"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: scan(x, y), f"q {kind}, ids array<{kind}>, similarity double")
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), F.col("ids")[0])
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).drop("rank")
    return index.scratch.table(top, "found")


def _asked(index: Cells, queries: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame, str]:
    """Distinct vectors of the queries (q, v), and which ids ask for each (q, id)."""
    d = queries.select(F.col(key).alias("id"), unit(vector, index.size).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    d = index.scratch.table(d, "queries")
    one = index.scratch.table(d.groupBy("v").agg(F.min("id").alias("q")), "asked")
    return one, d.join(one, "v").select("q", "id").distinct(), d.schema["id"].dataType.simpleString()


def _ranked(index: Cells, found: DataFrame, own: DataFrame, best: int) -> DataFrame:
    """(id, rank, neighbour, similarity) for each id that asks."""
    ids = found.select("q", "similarity", F.explode("ids").alias("neighbour"))
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour")
    ids = index.scratch.table(ids.withColumn("at", F.row_number().over(order)).where(F.col("at") <= best + 1), "ranked")
    mine = Window.partitionBy("id").orderBy("at")
    out = own.join(ids, "q").where("neighbour <> id").withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= best)
    return out.select("id", "rank", "neighbour", "similarity")


def nearest(index: Cells, queries: DataFrame, key: str, vector: str, best: int = 10, probes: int = 8) -> DataFrame:
    """The best neighbours in each query's nearest cells."""
    if best >= index.copies:
        raise ValueError(f"the index keeps {index.copies - 1} ids of equal vectors")
    one, own, kind = _asked(index, queries, key, vector)
    return _ranked(index, _scanned(index, _probes(index, one, probes, kind), kind), own, best)


def probes_for(index: Cells, queries: DataFrame, key: str, vector: str, best: int = 10, share: float = 0.93) -> int:
    """How many nearest cells hold this share of the true neighbours of ``TRIED`` queries, those of the least hash."""
    some = queries.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(TRIED)
    some = index.scratch.table(some.select(F.col(key).alias("id"), F.col(vector).alias("x"), unit(vector, index.size).alias("v")).where("v IS NOT NULL"), "tried")
    found = exact_nearest(index, some, "id", "x", best).select("id", "neighbour")
    where = index.nodes.select("cell", F.explode("ids").alias("neighbour"))
    rows = where.join(F.broadcast(found), "neighbour").join(F.broadcast(some.select("id", "v")), "id").select("v", "cell").collect()  # best for each of TRIED
    if not rows:
        return 1
    live = np.array(sorted(r.cell for r in index.cells.select("cell").collect()))
    x, mean = np.array([r.v for r in rows]), index.mean[live]
    far = (mean**2).sum(1) - 2 * x @ mean.T
    own = far[np.arange(len(x)), np.searchsorted(live, [r.cell for r in rows])]
    return int(np.quantile((far <= own[:, None]).sum(1), share, method="higher"))


def exact_nearest(index: Cells, queries: DataFrame, key: str, vector: str, best: int = 10, probes: int = 4) -> DataFrame:
    """The best neighbours among all rows of the index."""
    if best >= index.copies:
        raise ValueError(f"the index keeps {index.copies - 1} ids of equal vectors")
    one, own, kind = _asked(index, queries, key, vector)
    first = _scanned(index, _probes(index, one, probes, kind), kind)
    upto = first.groupBy("q").agg(F.sum(F.size("ids")).alias("n"), F.min("similarity").alias("least"))
    far = F.when(F.col("n") > best, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("least")))).otherwise(F.lit(4.0))
    bounded = one.join(upto, "q", "left").select("q", "v", F.coalesce(far, F.lit(4.0)).alias("far"))
    return _ranked(index, _scanned(index, _within(index, bounded, kind), kind), own, best)
