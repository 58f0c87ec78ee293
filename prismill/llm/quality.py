"""Quality of documents by attention-based learning from passages: a label belongs to a document, not to any of its passages.

A document's passages are its words, ``PASSAGE`` at a time. Each is encoded by
what it is written with (shares of ASCII characters and of others, lengths of
words, new words, words by hash) and a layer of tanh units. Gated attention gives each
passage a weight from its own encoding, tanh(V h) * sigmoid(U h), over all
of the document; the weighted encoding gives the score. All of it is learned at
once from documents' labels by gradient descent, in numpy.

Learning takes ``SAMPLE_DOCS`` labels at most, those of the least hash of their
ids, and of their documents the first whose passages are ``SAMPLE_PASSAGES``
together; that bounds the driver's memory and what is sent to the tasks. Scoring
reads all texts whole, in the tasks that read them. A long text's passages are encoded together, some 800
bytes for each 400 of text.

Defined results
- null or empty text, or white space only: one passage without words, with the score that its encoding gets
- a null id: scored, not held out, never learned from; rows of one id are scored each
- several labels of one id count as several documents; a null label isn't learned from
- without any label (an empty table, or none that may be learned from) every score is 0.5
- columns other than id and text aren't read; an empty table gives an empty table
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismill.llm import wordhash
from prismill.llm.bpe import texts

PASSAGE = 64
SAMPLE_DOCS, SAMPLE_PASSAGES = 4_000, 80_000
#: Buckets of words by hash, units of the encoding and of the attention.
HASHED, UNITS, GATES = 96, 24, 12
EPOCHS, BATCH_DOCS, RATE, DECAY = 30, 32, 4e-3, 1e-4

#: Classes of bytes: each ASCII sign its own, small letters, capitals, digits and white space one each, other characters one.
_KIND = np.zeros(256, np.int64)
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[_SIGNS] = np.arange(5, 5 + len(_SIGNS))
_KIND[10] = 5 + len(_SIGNS)
KINDS = 6 + len(_SIGNS)
FEATURES = KINDS + 4 + HASHED


def held_out(key: str = "doc_id") -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def encoded(part: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and how many passages each text has."""
    raw = [(t or "").encode() for t in part]
    data = b"\n".join(raw)
    first, last = wordhash.spans(data)
    ends = np.cumsum([len(r) + 1 for r in raw])
    words = np.diff(np.searchsorted(first, ends), prepend=0)  # of each text
    passages = np.maximum(1, -(-words // PASSAGE))
    base, begin = np.cumsum(passages) - passages, np.cumsum(words) - words
    which = np.repeat(base, words) + (np.arange(len(first)) - np.repeat(begin, words)) // PASSAGE
    n = int(passages.sum())
    counts = np.bincount(which, minlength=n)

    # Each byte belongs to the passage of the last word that starts at or before it; those before a text's first word to its first passage.
    start = np.full(n, 0, np.int64)
    start[base] = ends - [len(r) + 1 for r in raw]
    head = np.flatnonzero((np.arange(len(first)) - np.repeat(begin, words)) % PASSAGE == 0)
    inner = head[~np.isin(which[head], base)]
    start[which[inner]] = first[inner]
    size = np.diff(start, append=len(data) + 1)
    kinds = _KIND[np.frombuffer(data + b"\n", np.uint8)]
    chars = np.bincount(np.repeat(np.arange(n), size) * KINDS + kinds, minlength=n * KINDS).reshape(n, KINDS)
    chars[base + passages - 1, _KIND[10]] -= 1  # the one that parts texts

    out = np.zeros((n, FEATURES), np.float32)
    out[:, :KINDS] = np.sqrt(chars / np.maximum(1, chars.sum(1, keepdims=True)))
    length = (last - first).astype(np.float64)
    many = np.maximum(1, counts)
    mean = np.bincount(which, length, n) / many
    out[:, KINDS] = np.log1p(mean)
    out[:, KINDS + 1] = np.log1p(np.sqrt(np.maximum(0, np.bincount(which, length**2, n) / many - mean**2)))
    h = wordhash.hashes(data, first, last)
    order = np.lexsort((h, which))
    same = (np.diff(h[order]) == 0) & (np.diff(which[order]) == 0) if len(h) else np.zeros(0, bool)
    out[:, KINDS + 2] = 1 - np.bincount(which[order][1:][same], minlength=n) / many
    out[:, KINDS + 3] = counts / PASSAGE
    bucket = (h >> np.uint64(20)) % np.uint64(HASHED)
    hashed = np.bincount(which * HASHED + bucket.astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    out[:, KINDS + 4 :] = np.sqrt(hashed / many[:, None])
    return out, passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    """Parameters of the network, and the means and deviations that features are put to."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int) -> Attention:
        rng = np.random.default_rng(seed)
        shape = {"w": (FEATURES, UNITS), "b": (UNITS,), "v": (UNITS, GATES), "u": (UNITS, GATES), "g": (GATES,), "c": (UNITS,), "d": (1,)}
        p = {k: (rng.standard_normal(s) / np.sqrt(s[0]) if len(s) > 1 or k in "gc" else np.zeros(s)) for k, s in shape.items()}
        return cls(x.mean(0), np.where(x.std(0) > 1e-6, x.std(0), 1), p)

    def forward(self, x: np.ndarray, passages: np.ndarray) -> tuple:
        """Of documents' passages: everything that is worked out on the way to the scores."""
        p, heads = self.p, np.cumsum(passages) - passages
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * s) @ p["g"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), passages))
        a /= np.repeat(np.add.reduceat(a, heads), passages)
        z = np.add.reduceat(a[:, None] * h, heads)
        return x, h, t, s, a, z, _sigmoid(z @ p["c"] + p["d"])

    def gradients(self, x: np.ndarray, passages: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, s, a, z, score = self.forward(x, passages)
        do = weight * (score - y) / len(y)
        dz = np.repeat(do, passages)[:, None] * p["c"]
        rate = (dz * h).sum(1)
        heads = np.cumsum(passages) - passages
        de = a * (rate - np.repeat(np.add.reduceat(a * rate, heads), passages))
        dts = de[:, None] * p["g"]
        dt, ds = dts * s * (1 - t**2), dts * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h**2)
        out = {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "g": (t * s).T @ de, "c": z.T @ do, "d": do.sum(keepdims=True)}
        return {k: v + DECAY * p[k] for k, v in out.items()}


def learned(x: np.ndarray, passages: np.ndarray, y: np.ndarray, seed: int = 12) -> Attention:
    """The network after some rounds over these documents, in Adam's steps; both labels weigh the same in all."""
    model, rng = Attention.fresh(x, seed), np.random.default_rng(seed)
    heads = np.cumsum(passages) - passages
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(len(y)), RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH_DOCS):
            docs = order[at : at + BATCH_DOCS]
            rows = np.concatenate([np.arange(heads[i], heads[i] + passages[i]) for i in docs])
            step += 1
            for k, g in model.gradients(x[rows], passages[docs], y[docs], weight[docs]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Attention | None:
    """Learn from labelled documents that aren't held out; None if there are none."""
    own = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"))
    own = own.orderBy(F.xxhash64("key"), "key", "y").limit(SAMPLE_DOCS)
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(own), "key")  # SAMPLE_DOCS rows
    d = d.select("y", "text", F.xxhash64("key").alias("place"), F.xxhash64("text").alias("copy"))
    chosen = d.select("place", "copy", F.length("text").alias("size")).orderBy("place", "copy").limit(SAMPLE_DOCS).collect()
    upto = int(np.searchsorted(np.cumsum([1 + r.size // (2 * PASSAGE) for r in chosen]), SAMPLE_PASSAGES, "right"))  # words have a sign and a space at least
    if not upto:
        return None
    end = chosen[upto - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in texts(batch.column("text")):
                x, n = encoded(part)
                rows = np.split(x, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in ("y", "place", "copy")), pa.array([r.tobytes() for r in rows], pa.binary())], names=["y", "place", "copy", "x"])
                at += len(part)

    some = d.where((F.col("place") < end.place) | (F.col("place") == end.place) & (F.col("copy") <= end.copy))
    got = some.mapInArrow(run, "y double, place long, copy long, x binary").orderBy("place", "copy").limit(upto).collect()  # bounded as chosen
    got.sort(key=lambda r: (r.place, r.copy, r.y))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in got]
    return learned(np.concatenate(x), np.array([len(r) for r in x]), np.array([r.y for r in got]))


def scored(docs: DataFrame, model: Attention | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1), n_passages, and focus, the number of the passage of the greatest weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in texts(batch.column(1)):
                x, n = encoded(part)
                score, focus = np.full(len(n), 0.5), np.zeros(len(n), np.int64)
                if model:
                    *_, a, _, score = model.forward(x, n)
                    heads = np.cumsum(n) - n
                    top = np.repeat(np.maximum.reduceat(a, heads), n) == a
                    rows = np.flatnonzero(top)
                    owner = np.repeat(np.arange(len(n)), n)[rows]
                    _, one = np.unique(owner, return_index=True)
                    focus = rows[one] - heads
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(score, pa.float64()), pa.array(n.astype(np.int64)), pa.array(focus)], names=["key", "score", "n_passages", "focus"])
                at += len(part)

    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(run, f"key {kind}, score double, n_passages long, focus long").withColumnRenamed("key", key)
