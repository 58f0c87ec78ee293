"""Ranked lexical search: an inverted index in shards, and MaxScore within each shard.

One reading of the texts writes the index. A task closes a shard whenever the
texts since the last one have ``SHARD_BYTES``, so a shard is bounded and belongs
to one task. Its rows are (shard, term, docs, tfs), and one of the empty term
has its documents' ids and lengths. Document frequencies, the number of
documents and their total length are aggregates of that table.

For a search the index is dealt out by shard and read shard by shard in the
order of terms. MaxScore in a shard: a term's upper bound is its weight times
the greatest impact in its list. Terms from the least bound on whose bounds sum
to less than the tenth best score known are non-essential: no document can
qualify by them alone. Lists of the other terms are added up; non-essential
lists are then probed from the greatest bound down, only for documents whose
score so far and the bounds still to come reach the tenth best. That threshold is
carried on from shard to shard of a task, which gives its ten best of each
item in the end; the best of all tasks are ranked by a window.

Items are worked on in blocks of about ``ITEM_BYTES`` of text, each sent to the
tasks with its terms' weights; only terms of items are indexed where these have
``TERM_BYTES`` at most, all terms otherwise. Both ways give the same rows.

Defined results
- null or empty text, or one without terms: a document that counts nowhere, an item without rows
- equal scores by ascending id, null ids last; rows of one id are documents of their own
- each row of the items is an item of its own, with a null id as with any other
- terms that stand nowhere, or whose weight is 0, add nothing; documents with a score of 0 aren't returned
- columns other than id and text aren't read; empty tables give an empty table
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismill.llm import wordhash
from prismill.llm.bpe import texts
from prismill.llm.store import Scratch

BEST = 10
SHARD_BYTES = 8 << 20
ITEM_BYTES = 4 << 20
TERM_BYTES = 8 << 20

#: Of bytes in UTF-8: A-Z in lower case, other ASCII but letters and digits as space; bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8."""
    return (text or "").encode().translate(_TERMS).split()


class _Shard:
    """Postings of some documents as they are read."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes, self.bytes = array("i"), 0
        self.lists: dict[bytes, tuple[array, array]] = {}

    def add(self, key: object, words: list[bytes], only: frozenset[bytes] | None) -> None:
        n, lists = len(self.ids), self.lists
        self.ids.append(key)
        self.sizes.append(len(words))
        for term, tf in Counter(words).items() if only is None else Counter(filter(only.__contains__, words)).items():
            if (at := lists.get(term)) is None:
                at = lists[term] = (array("i"), array("i"))
            at[0].append(n)
            at[1].append(tf)

    def batch(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        names = sorted(self.lists)
        docs, tfs = ([np.frombuffer(self.lists[t][i], np.int32) for t in names] for i in (0, 1))
        none = np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number] * (len(names) + 1), pa.int64()), pa.array([b"", *names], pa.binary()).cast(pa.string()),
                wordhash.lists([none, *docs], pa.int32()), wordhash.lists([np.frombuffer(self.sizes, np.int32), *tfs], pa.int32()),
                pa.array([self.ids, *[[]] * len(names)], pa.list_(kind)),
            ],
            names=["shard", "term", "docs", "tfs", "ids"],
        )


def index(docs: DataFrame, scratch: Scratch, only: frozenset[bytes] | None = None, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The written index (shard, term, docs, tfs, ids) of all terms or of these only; documents are numbered within their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for part in texts(batch.column(1)):
                for t in part:
                    key, words = next(keys), terms(t)
                    if words:
                        shard.add(key, words, only)
                        shard.bytes += len(t)
                    if shard.bytes >= shard_bytes:
                        yield shard.batch(number, batch.column(0).type)
                        number, shard = number + 1, _Shard()
        if shard.ids:
            yield shard.batch(number, batch.column(0).type)

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return scratch.table(d.mapInArrow(run, f"shard bigint, term string, docs array<int>, tfs array<int>, ids array<{kind}>"), "index")


def frequencies(postings: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(term, df) of all terms, the number of documents that have a term, and the number of all their terms."""
    total = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    n, length = postings.where("term = ''").agg(F.sum(F.size("ids")), F.sum(total)).first()
    df = postings.where("term <> ''").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    return scratch.table(df, "frequencies"), n or 0, length or 0


class MaxScore:
    """The best documents of each item over shards that come one after the other."""

    def __init__(self, items: list[dict[str, int]], weights: dict[str, int], n: int, length: int, best: int = BEST):
        self.items = [[(t, times * weights[t]) for t, times in item.items() if weights.get(t)] for item in items]
        self.n, self.length, self.best = n, length, best
        self.top: list[list[tuple]] = [[] for _ in items]  # (-score, id is null, id), the best first
        self.probed = self.added = 0  # postings read, and of these the ones of non-essential lists

    def shard(self, ids: list, sizes: np.ndarray, lists: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        m = 25 + 75 * sizes.astype(np.int64) * self.n // self.length
        impacts = {}
        for t, (docs, tfs) in lists.items():
            tf = tfs.astype(np.int64)
            x = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
            impacts[t] = (docs, x, int(x.max()))
        for number, item in enumerate(self.items):
            self._search(number, [(w * impacts[t][2], w, *impacts[t][:2]) for t, w in item if t in impacts], ids)

    def _search(self, number: int, lists: list[tuple], ids: list) -> None:
        top = self.top[number]
        least = -top[-1][0] if len(top) == self.best else 1  # equal scores may still win by their id
        lists.sort(key=lambda x: x[0])
        bounds = np.cumsum([0, *(x[0] for x in lists)])
        split = int(np.searchsorted(bounds[1:], least))  # so many lists together stay below the threshold
        if split == len(lists):
            return
        score = np.zeros(len(ids), np.int64)
        for _, w, docs, x in lists[split:]:
            score[docs] += w * x
            self.added += len(docs)
        some = np.flatnonzero(score)
        for at in range(split - 1, -1, -1):
            if len(some) > self.best:  # what documents have already is a bound too
                least = max(least, int(np.partition(score[some], -self.best)[-self.best]))
            some = some[score[some] + bounds[at + 1] >= least]
            if not len(some):
                return
            _, w, docs, x = lists[at]
            place = np.minimum(np.searchsorted(docs, some), len(docs) - 1)
            there = docs[place] == some
            score[some[there]] += w * x[place[there]]
            self.probed += int(there.sum())
        if len(some) > self.best:
            least = max(least, int(np.partition(score[some], -self.best)[-self.best]))
        some = some[score[some] >= least]
        new = [(-s, ids[i] is None, ids[i] or 0) for i, s in zip(some.tolist(), score[some].tolist(), strict=True)]
        self.top[number] = sorted([*top, *new])[: self.best]


def _found(batches: Iterator[pa.RecordBatch], items: list[dict[str, int]], weights: dict[str, int], n: int, length: int, best: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    search, now, ids, sizes, lists = MaxScore(items, weights, n, length, best), None, [], None, {}
    for batch in batches:
        docs, tfs = batch.column("docs"), batch.column("tfs")
        for i, (shard, term) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("term").to_pylist(), strict=True)):
            if term == "":
                if now is not None:
                    search.shard(ids, sizes, lists)
                now, ids, sizes, lists = shard, batch.column("ids")[i].as_py(), tfs[i].values.to_numpy().copy(), {}
            elif term in weights:
                assert shard == now, "rows of a shard come together, its documents first"
                lists[term] = docs[i].values.to_numpy().copy(), tfs[i].values.to_numpy().copy()
    if now is not None:
        search.shard(ids, sizes, lists)
    rows = [(i, None if null else key, -s) for i, top in enumerate(search.top) for s, null, key in top]
    cols = zip(*rows, strict=True) if rows else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), kind, pa.int64()), strict=True)], names=["number", "doc", "score"])


def ranked(
    docs: DataFrame, items: DataFrame, best: int = BEST, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    shard_bytes: int = SHARD_BYTES, item_bytes: int = ITEM_BYTES, term_bytes: int = TERM_BYTES,
) -> DataFrame:
    """Per row of items and rank: item, rank (from 1), doc and score of its best documents."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "search")
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    q = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    parts = 1 + size // item_bytes
    blocks = [q] if parts == 1 else [q.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p) for p in range(parts)]
    only = frozenset(t for r in blocks[0].select("text").collect() for t in terms(r.text)) if size <= term_bytes and parts == 1 else None
    postings = index(docs, scratch, only, key, text, shard_bytes)
    df, n, length = frequencies(postings, scratch)
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    d = docs.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"item {q.schema['item'].dataType.simpleString()}, rank int, doc {d}, score long")
    for block in blocks:
        rows = block.collect()
        asked = [dict(Counter(t.decode() for t in terms(r.text))) for r in rows]
        own = spark.createDataFrame([(t,) for t in sorted(set().union(*asked))], "term string")
        own = scratch.table(own.join(df, "term").select("term", weight.alias("w")).where("w > 0"), "weights")
        weights = {r.term: r.w for r in own.collect()}  # of one block's terms
        near = postings if len(blocks) == 1 else postings.join(own.select("term").unionByName(spark.range(1).select(F.lit("").alias("term"))), "term", "left_semi")
        kind = to_arrow_type(docs.schema[key].dataType)
        dealt = near.repartition("shard").sortWithinPartitions("shard", "term")
        found = dealt.mapInArrow(lambda b, a=asked, w=weights: _found(b, a, w, n, length, best, kind), f"number long, doc {d}, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        named = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"number long, item {q.schema['item'].dataType.simpleString()}")
        out = out.unionByName(found.join(F.broadcast(named), "number").select("item", "rank", "doc", "score"))  # a block's ids
    return out.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
