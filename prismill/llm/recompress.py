"""Repeated passages of whole corpora by recompression.

Words are symbols. A round names maximal runs of one symbol, then splits the
alphabet in two by a hash and names each pair of a left symbol followed by a
right one. Names are hashes of what they cover, so every task gives equal
substrings equal names without asking the others. With each symbol goes the
range of words that it depends on; a window that holds this range holds the
symbol, wherever the window stands.

1. Each window of ``WINDOW`` words is put under one symbol that it holds by
   this rule, the one with the least hash; consecutive windows under one symbol
   are one row. A window without such a symbol is put under its own hash.
2. Symbols that are seen once in the corpus lead to no repeat. The passages
   under the others (their windows together) are hashed with 95 bits. All but
   the earliest of equal passages are repeats as a whole.
3. The windows of the earliest passages are hashed as well, which finds those
   that repeat a part of another passage. Words of repeats are removed.

Aggregates are combined before they are shuffled and joins are on single rows
for each key, so a passage that a third of all texts share is a skewed join
side that adaptive execution splits. Tables between steps are written to the
shared folder, and shuffles of finished steps are let go.

Defined results
- null or empty text: no words, nothing removed; texts shorter than a window lose nothing
- order is by id, null first; rows that share an id come in order of a hash of their texts
- rows alike in id and text are one document and get one result each
- windows overlap freely and also repeat within one document; they are judged on the input
- columns other than id and text aren't read; an empty table gives an empty table
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm import wordhash
from prismill.llm.bpe import texts
from prismill.llm.store import Scratch
from prismill.llm.wordhash import mix, signed

WINDOW = 20
ROUNDS = 2
#: Bytes of text worked on at once.
CHUNK = 3 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FAR = 1 << 20


def compressed(w: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a row of texts after so many rounds: names, first words, and how far they depend on words before and after their first.

    doc numbers the text of each word. What depends on a text's edge depends on words out of reach.
    """
    name, at, d = w, np.arange(len(w)), doc
    low, high = at, at + 1
    for k in range(rounds):
        if not len(name):
            break
        edge = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (d[1:] != d[:-1])]))
        last = np.append(edge[1:], len(name)) - 1
        times = last - edge + 1
        base, d_run = name[edge], d[edge]
        left, right = np.maximum(edge - 1, 0), np.minimum(last + 1, len(name) - 1)
        low_run = np.minimum(low[edge], np.where((edge > 0) & (d[left] == d_run), low[left], -_FAR + at[edge]))
        high_run = np.maximum(high[last], np.where((last + 1 < len(name)) & (d[right] == d_run), high[right], _FAR + at[edge]))
        runs = np.where(times > 1, mix(base * _A + times.astype(np.uint64) * _B + np.uint64(k)), base)
        side = (mix(base ^ np.uint64(0x5851F42D4C957F2D + 2 * k)) >> np.uint64(40)) & np.uint64(1)
        head = np.zeros(len(base), bool)
        head[:-1] = (side[:-1] == 1) & (side[1:] == 0) & (d_run[1:] == d_run[:-1])
        tail = np.concatenate([[False], head[:-1]])
        i = np.flatnonzero(~tail)
        pair = head[i]
        j = i + pair
        name = np.where(pair, mix(runs[i] * _A + mix(runs[j] + _B) + np.uint64(k)), runs[i])
        at, d, low, high = at[edge][i], d_run[i], np.minimum(low_run[i], low_run[j]), np.maximum(high_run[i], high_run[j])
    return name, at, np.minimum(at - low, _FAR), np.minimum(high - at, _FAR)


def _ranges(w: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the words of each range."""
    base = (int(_B) * (2 * seed + 1) + 4 * seed) % (1 << 64)
    power = np.cumprod(np.full(len(w) + 1, np.uint64(base)))
    back = np.cumprod(np.full(len(w) + 1, np.uint64(pow(base, -1, 1 << 64))))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * power[:-1])])
    return mix((total[end] - total[start]) * back[start])


def chosen(w: np.ndarray, doc: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of texts: keys of the symbols chosen, the first window under each, and how many windows follow."""
    m = len(w) - window + 1
    none = np.zeros(0, np.int64)
    if m <= 0:
        return none.view(np.uint64), none, none
    name, at, before, after = compressed(w, doc, rounds)
    far = np.int16(window + 1)
    b, a, h = np.full(len(w), far), np.full(len(w), far), np.zeros(len(w), np.uint32)
    b[at], a[at] = np.minimum(before, far), np.minimum(after, far)
    h[at] = (mix(name ^ _B) >> np.uint64(33)).astype(np.uint32)
    best, who = np.full(m, np.uint32(0xFFFFFFFF)), np.full(m, -1, np.int64)
    p = np.arange(m)
    for t in range(window):
        ok = (b[t : t + m] <= t) & (a[t : t + m] <= window - t) & (h[t : t + m] < best)
        best[ok] = h[t : t + m][ok]
        who[ok] = p[ok] + t
    inside = doc[:m] == doc[window - 1 :]
    key = np.zeros(len(w), np.uint64)
    near = (before <= window) & (after <= window)
    key[at[near]] = mix(name[near] + _ranges(w, at[near] - before[near], at[near] + after[near]))
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (who[1:] < 0) | ~inside[:-1]])
    start = np.flatnonzero(new & inside)
    cut = np.flatnonzero(new | ~inside)
    end = np.append(cut, m)[np.searchsorted(cut, start, "right")]
    own = who[start]
    keys = np.where(own >= 0, key[own], 0)
    lone = start[own < 0]
    if len(lone):
        keys[own < 0] = wordhash.sequences(w, window, seed=3)[lone]
    return keys, start, end - start


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    at = 0
    for part in texts(batch.column("text"), CHUNK):
        yield batch.slice(at, len(part)), list(wordhash.documents(part))
        at += len(part)


def _anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, found in _parts(batch):
            size = np.array([len(x) for x in found])
            doc = np.repeat(np.arange(len(found)), size)
            keys, start, n = chosen(np.concatenate(found), doc, window)
            of = doc[start]
            first = (np.cumsum(size) - size)[of]
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), rows.column("doc").take(pa.array(of)), pa.array((start - first) * 32 + n)], names=["sym", "doc", "span"])


def _listed(spans: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """First windows and numbers of windows of each row's spans."""
    return [((s := np.array(x, np.int64)) >> 5, s & 31) for x in spans.to_pylist()]


def _hashed(rows: pa.RecordBatch, high: list, low: list, of: list, *more: tuple[str, list]) -> pa.RecordBatch:
    cols = [pa.array(signed(np.concatenate(high))), pa.array((np.concatenate(low) >> np.uint64(33)).astype(np.int32)), rows.column("doc").take(pa.array(np.concatenate(of)))]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(np.concatenate(x).astype(np.int32)) for _, x in more)], names=["high", "low", "doc", *(n for n, _ in more)])


def _passages(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each listed span: the hash of all its words, where it starts and how many windows it has."""
    for batch in batches:
        for rows, found in _parts(batch):
            high, low, of, at, size = [], [], [], [], []
            for i, (w, (start, n)) in enumerate(zip(found, _listed(rows.column("spans")), strict=True)):
                end = start + n + window - 1
                high.append(_ranges(w, start, end, 5) + n.astype(np.uint64))
                low.append(_ranges(w, start, end, 6))
                of.append(np.full(len(start), i))
                at.append(start)
                size.append(n)
            if high:
                yield _hashed(rows, high, low, of, ("at", at), ("n", size))


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the listed spans."""
    for batch in batches:
        for rows, found in _parts(batch):
            high, low, of, at = [], [], [], []
            for i, (w, (start, n)) in enumerate(zip(found, _listed(rows.column("spans")), strict=True)):
                pos = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                high.append(wordhash.sequences(w, window, seed=3)[pos])
                low.append(wordhash.sequences(w, window, seed=4)[pos])
                of.append(np.full(len(pos), i))
                at.append(pos)
            if high:
                yield _hashed(rows, high, low, of, ("at", at))


def _kept(batches: Iterator[pa.RecordBatch], window: int, texts_too: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in texts(batch.column("text"), CHUNK):
            rows = batch.slice(at, len(part))
            at += len(part)
            out = []
            for t, spans in zip(part, rows.column("repeats").to_pylist(), strict=True):
                words = (t or "").encode().split()
                n = len(words)
                if spans:
                    gone, s = np.zeros(n + 1, np.int32), np.array(spans)
                    np.add.at(gone, s >> 5, 1)
                    np.subtract.at(gone, (s >> 5) + (s & 31) + window - 1, 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts_too else None))
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc"), *cols], names=["doc", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Texts under a key of their own that orders them, and the key's id where that isn't the id itself."""
    n = docs.agg(F.count("*").alias("n"), F.count("doc").alias("m")).first()
    twice = docs.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if n.n == n.m and not twice:
        return docs, None
    d = docs.withColumnRenamed("doc", "id").withColumn("tie", F.xxhash64("text"))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    d = d.distinct().repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    d = scratch.table(d.withColumn("doc", F.monotonically_increasing_id()), "keyed")
    return d.select("doc", "text"), d


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, texts_too: bool = False) -> DataFrame:
    """Per row: key, n_words, n_removed and kept_sha256, with texts_too also kept_text: the words outside later copies of a window.

    A window may have 31 words at most.
    """
    if not 2 <= window <= 31:
        raise ValueError("a window has 2 to 31 words")
    scratch = Scratch(docs.sparkSession, "recompress")
    given = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    d, named = _keyed(given, scratch)
    kind = d.schema["doc"].dataType.simpleString()

    def by_doc(spans: DataFrame, name: str) -> DataFrame:
        """Each text's spans, packed, in one list. Texts are dealt before they are gathered, so a span is moved as two numbers."""
        return scratch.table(spans.select("doc", "span").repartition("doc").groupBy("doc").agg(F.collect_list("span").alias(name)), name)

    packed = F.col("at").cast("long") * 32
    anchors = scratch.table(d.mapInArrow(lambda b: _anchors(b, window), f"sym bigint, doc {kind}, span bigint"), "anchors")
    shared = scratch.table(anchors.groupBy("sym").agg(F.count("*").alias("n")).where("n > 1").select("sym"), "shared")
    spans = by_doc(anchors.join(shared, "sym"), "spans")
    scratch.drop(anchors, shared)
    passages = scratch.table(d.join(spans, "doc").mapInArrow(lambda b: _passages(b, window), f"high bigint, low int, doc {kind}, at int, n int"), "passages")
    first = passages.groupBy("high", "low").agg(F.min(F.struct("doc", "at")).alias("first")).select("high", "low", F.col("first.doc").alias("doc0"), F.col("first.at").alias("at0"))
    first = scratch.table(first, "earliest")
    roles = passages.join(first, ["high", "low"]).select("doc", (packed + F.col("n")).alias("span"), ((F.col("doc") == F.col("doc0")) & (F.col("at") == F.col("at0"))).alias("first"))
    roles = scratch.table(roles, "roles")
    scratch.drop(passages, spans)
    scratch.settle()
    heads = by_doc(roles.where("first"), "spans")
    wins = scratch.table(d.join(heads, "doc").mapInArrow(lambda b: _windows(b, window), f"high bigint, low int, doc {kind}, at int"), "windows")
    scratch.settle()
    first = wins.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at")).alias("first")).where("n > 1")
    first = scratch.table(first.select("high", "low", F.col("first.doc").alias("doc0"), F.col("first.at").alias("at0")), "first")
    scratch.settle()
    partly = wins.join(first, ["high", "low"]).where("doc <> doc0 OR at <> at0").select("doc", (packed + 1).alias("span"))
    partly = scratch.table(partly, "partly")
    scratch.drop(wins, first, heads)
    later = by_doc(roles.where("NOT first").select("doc", "span").unionByName(partly), "repeats")
    scratch.drop(roles, partly)
    schema = f"doc {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"
    out = d.join(later, "doc", "left").mapInArrow(lambda b: _kept(b, window, texts_too), schema)
    if named is not None:
        out = named.select("doc", F.col("id").alias("own_id"), F.col("text").alias("own_text")).join(out, "doc").drop("doc")
        out = given.join(out, F.col("doc").eqNullSafe(F.col("own_id")) & F.col("text").eqNullSafe(F.col("own_text"))).select("doc", "n_words", "n_removed", "kept_sha256", "kept_text")
    out = out.withColumnRenamed("doc", key)
    return out if texts_too else out.drop("kept_text")
