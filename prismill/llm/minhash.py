"""Near-duplicate links by HyperMinHash registers, banding and verification on full sets.

A set's 64-bit hashes fall into ``BUCKETS`` buckets; of the least hash of each
a register keeps the leading-zero count and ten mantissa bits, 16 bits in all.
An empty bucket borrows the register of another one that a fixed sequence
names. Bands of compressed registers give candidates, an estimate corrected
for chance collisions of registers thins them, and the full sets decide.

Work is kept near linear in a group's size. Documents of one set are one node.
In a band's group, nodes of other components are compared with a pivot, the
node c that meets most others in bands; what that links becomes one component.
After ``ROUNDS`` rounds the groups that still hold several components are
finished exactly, by what their nodes have beyond c and lack of it. For nodes
s and x that aren't both linked with c, |s & x| = |s & x & c| + |(s - c) & (x - c)|
and the first part is at most |c| less the larger lack, so a link needs so
many shared hashes beyond c or, where x is smaller than c and the sizes allow
it, a shared lack. An inverted index of these differences brings nodes
together. It holds of each node the prefix that such an overlap must touch, in
an order that puts the hashes of most nodes last: what many unlinked nodes
share is in it only where it could be most of what a link needs. In the join,
what follows the common hash on both sides bounds the overlap, so a pair whose
rest is too short goes by four numbers; the condition then compares the
differences from c, which gives the similarity exactly, and only links come
out. No group is capped or sampled.

With 32 bands of 5 registers a pair at similarity 0.85 is missed by all bands
with a probability of 7e-9, one at 0.8 with 3e-6, where registers are
independent. Sets smaller than the number of buckets borrow most of theirs, from sources
that differ from bucket to bucket; tests measure how many true links bands
find for sets from 6 to 3,000 hashes. Sets are of 64-bit hashes of shingles,
and so are their sizes and what is compared in the end.

Defined results
- null or empty text, or no words: empty set, linked with nothing, kept
- fewer words than a shingle has: the whole sequence is the one shingle
- a null id: no link, component null, kept; rows with one id are one document for linking
- equal sets always link; columns other than id and text aren't read; an empty table gives an empty table
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismill.llm import wordhash
from prismill.llm.bpe import texts
from prismill.llm.components import components
from prismill.llm.store import Scratch
from prismill.llm.wordhash import mix, signed

BANDS, ROWS, MANTISSA = 32, 5, 10
BUCKETS = BANDS * ROWS
ROUNDS = 2
#: Standard deviations below the threshold down to which an estimate still leads to verification.
SIGMAS = 5.0
#: Sizes are told apart up to two to this power.
LARGEST = 41
#: Hashes beyond a pivot that so many of its nodes have at most are not told apart by how many have them.
COMMON = 8

_SEQ = np.random.default_rng(7).integers(0, BUCKETS, (4096, BUCKETS))


def shingle_set(w: np.ndarray, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, from its word hashes."""
    if not len(w):
        return w
    return np.unique(wordhash.sequences(w, min(len(w), shingle), seed=min(len(w), shingle)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set, none of them empty; a row depends on its own set and on no other."""
    out = np.full((len(sets), BUCKETS), -1, np.int32)
    for row, u in zip(out, sets, strict=True):
        which = ((u >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
        first = np.flatnonzero(np.diff(which.astype(np.int64), prepend=-1))
        rest = u[first] * np.uint64(BUCKETS) | np.uint64(1)
        top = np.frexp((rest >> np.uint64(11)).astype(np.float64) + 0.5)[1]  # exact: 53 bits
        zeros = np.clip(53 - top, 0, 62).astype(np.int64)
        bits = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        row[which[first].astype(np.int64)] = zeros.astype(np.int32) << MANTISSA | bits.astype(np.int32)
    full = out.copy()
    lone = (out >= 0).sum(1) <= 1  # nothing to choose from: an empty set, or one bucket
    full[lone] = np.maximum(out[lone].max(1, keepdims=True, initial=-1), 0)
    for sources in _SEQ:
        r, c = np.nonzero(full < 0)
        if not len(r):
            break
        full[r, c] = out[r, sources[c]]
    for i in np.unique(np.nonzero(full < 0)[0]):  # no source named a filled bucket: the next one to the right
        filled, empty = np.flatnonzero(out[i] >= 0), np.flatnonzero(full[i] < 0)
        full[i, empty] = out[i, filled[np.searchsorted(filled, empty) % len(filled)]]
    return full.astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, which also names the band."""
    factors = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BANDS, ROWS)
    x = regs.astype(np.uint64).reshape(-1, BANDS, ROWS)
    return mix(((x + np.uint64(1)) * factors).sum(2, dtype=np.uint64) + factors[:, 0])


@functools.cache
def _chances() -> np.ndarray:
    """Chance that registers of two sets without a shared hash are equal, by the logarithms (base 2) of the sets' sizes.

    A filled bucket of a set of n hashes holds a Poisson number of them, one at least, of mean
    n / BUCKETS; the least falls into a register's interval with the probability summed here.
    """
    mean = (2.0 ** np.arange(LARGEST) / BUCKETS)[:, None]
    out = np.zeros((LARGEST, LARGEST))
    for zeros in range(63):
        edges = 2.0 ** -(zeros + 1) * (1 + np.arange((1 << MANTISSA) + 1) / (1 << MANTISSA))
        p = -np.diff(np.exp(-mean * edges)) / -np.expm1(-mean)
        out += p @ p.T
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers of sets of n and m hashes, less the share that collides by chance."""
    log = lambda x: np.clip(np.rint(np.log2(np.maximum(x, 1))), 0, LARGEST - 1).astype(np.int64)
    chance = _chances()[log(n), log(m)]
    return np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in texts(batch.column(1)):
            ids = batch.column(0).slice(at, len(part))
            at += len(part)
            sets = [shingle_set(w, shingle) for w in wordhash.documents(part, lower)]
            regs = registers(sets)
            keys = [np.array([mix(s).sum(dtype=np.uint64), (s * (s >> np.uint64(32) | np.uint64(1))).sum(dtype=np.uint64)], np.uint64) if len(s) else np.zeros(2, np.uint64) for s in sets]
            k = signed(np.array(keys, np.uint64).reshape(-1, 2))
            bands = signed(band_keys(regs))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), wordhash.lists(list(bands), pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc", "n", "k1", "k2", "bands", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, lower: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for part in texts(batch.column("text")):
            rows = batch.slice(at, len(part))
            at += len(part)
            sets = [shingle_set(w, shingle) for w in wordhash.documents(part, lower)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc", "n", "k1", "k2")), pa.array([mix(s).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "n", "k1", "k2", "own", "hashes"])


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose registers don't rule the threshold out."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
        n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
        sigma = np.sqrt(threshold * (1 - threshold) / np.minimum(BUCKETS, np.minimum(n, m)))
        ok = estimate(a, b, n, m) >= threshold - SIGMAS * sigma
        yield batch.filter(pa.array(ok)).select(["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            shared = len(p) + len(q) - len(np.union1d(p, q))
            ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
        yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of nodes a with their pivots b: what a has beyond b, what it lacks (under another name), and the shared hashes beyond b that any link needs.

    low is the least size of a node of the pivot. A partner is no smaller, and
    no smaller than the share of a's own size that a link asks for.
    """
    share = percent / (100 + percent)
    for batch in batches:
        beyonds, lacks, leasts = [], [], []
        for x, y, low in zip(batch.column("ha"), batch.column("hb"), batch.column("low").to_pylist(), strict=True):
            p, c = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            beyond, lack = np.setdiff1d(p, c, assume_unique=True), mix(np.setdiff1d(c, p, assume_unique=True))
            partner = max(low, -(-percent * len(p) // 100))
            leasts.append(int(np.ceil(share * (len(p) + partner) - len(c) + len(lack) - 1e-9)))
            beyonds.append(signed(beyond))
            lacks.append(signed(lack))
        sizes = [pa.array([len(y.as_buffer()) // 8 for y in batch.column("hb")], pa.int64()), pa.array([len(v) for v in lacks], pa.int64())]
        lists = [wordhash.lists(v, pa.int64()) for v in (beyonds, lacks)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "low")), *sizes, pa.array(leasts, pa.int64()), *lists], names=["doc", "pivot", "n", "low", "np", "lack", "least", "beyond", "lacks"])


def differences_index(diff: DataFrame, scratch: Scratch) -> DataFrame:
    """(pivot, doc, comp, hash, rest) of the hashes by which nodes of a pivot can be linked; rest is how many of a node's hashes beyond the pivot follow, -1 for a lack.

    A node's hashes beyond the pivot stand in one order for all nodes of the
    pivot: those of at most ``COMMON`` nodes by themselves, then the others from
    the fewest nodes to the most. Two nodes that share ``least`` of them share
    one among the first of each, all but the last least - 1.
    """
    each = diff.select("pivot", "doc", F.explode("beyond").alias("hash"))
    often = scratch.table(each.groupBy("pivot", "hash").agg(F.count("*").alias("nodes")).where(F.col("nodes") > COMMON), "often")
    last = each.join(often, ["pivot", "hash"]).groupBy("pivot", "doc").agg(F.sort_array(F.collect_list(F.struct("nodes", "hash")))["hash"].alias("last"))
    ends = F.coalesce("last", F.array().cast("array<bigint>"))
    ordered = diff.join(last, ["pivot", "doc"], "left").select("pivot", "doc", "comp", "least", F.concat(F.array_except("beyond", ends), ends).alias("order"))
    size = F.size("order")
    first = F.slice("order", F.lit(1), F.greatest(F.lit(0), size - F.greatest("least", F.lit(1)) + 1).cast("int"))
    beyond = ordered.select("pivot", "doc", "comp", size.alias("size"), F.posexplode(first).alias("at", "hash")).select("pivot", "doc", "comp", "hash", (F.col("size") - F.col("at") - 1).alias("rest"))
    lacks = diff.where("least <= 0 AND low < np").select("pivot", "doc", "comp", F.explode("lacks").alias("hash"), F.lit(-1).alias("rest"))
    return beyond.unionByName(lacks)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, percent: int = 85, lower: bool = True) -> DataFrame:
    """Per row: key, n_shingles, component_id (least id reachable by links) and kept (the id is its component's)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    kind = d.schema["doc"].dataType.simpleString()
    sig = scratch.table(d.mapInArrow(lambda b: _sketch(b, shingle, lower), f"doc {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>, regs binary"), "sketch")
    real = sig.where("n > 0 AND doc IS NOT NULL")
    equal = scratch.table(real.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep")), "equal")
    member = scratch.table(real.select("doc", "k1", "k2", "n").join(equal, ["k1", "k2", "n"]).where("doc <> rep").select("doc", "rep"), "member")
    scratch.settle()
    nodes = real.join(equal.select("k1", "k2", "n", F.col("rep").alias("doc")), ["k1", "k2", "n", "doc"])

    band = nodes.select("doc", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    groups = scratch.table(band.join(scratch.table(shared, "shared"), "band"), "groups")
    some = groups.groupBy("doc").agg(F.sum("size").alias("meets"))
    node = scratch.table(nodes.join(some, "doc").groupBy("doc").agg(*(F.first(c).alias(c) for c in ("n", "k1", "k2", "regs", "meets"))), "nodes")
    full = d.join(node.select("doc", "n", "k1", "k2"), "doc").mapInArrow(lambda b: _sets(b, shingle, lower), f"doc {kind}, n bigint, k1 bigint, k2 bigint, own bigint, hashes binary")
    sets = scratch.table(full.where("own = k1").groupBy("doc").agg(F.first("hashes").alias("hashes")), "sets")

    scratch.settle()

    def side(t: DataFrame, c: str, **names: str) -> DataFrame:
        return t.select(F.col("doc").alias(c), *(F.col(v).alias(k) for k, v in names.items()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs (a, b)."""
        p = pairs.join(side(node, "a", na="n", ra="regs"), "a").join(side(node, "b", nb="n", rb="regs"), "b")
        p = p.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        p = p.mapInArrow(lambda b: _likely(b, percent / 100), f"a {kind}, b {kind}")
        p = p.join(side(sets, "a", ha="hashes"), "a").join(side(sets, "b", hb="hashes"), "b")
        return p.mapInArrow(lambda b: _verified(b, percent), f"a {kind}, b {kind}")

    def labelled(links: DataFrame | None) -> DataFrame:
        """(doc, meets, comp, comp_size) of every node in a group."""
        if links is None:
            return node.select("doc", "meets", F.col("doc").alias("comp"), F.lit(1).cast("long").alias("comp_size"))
        c = scratch.table(components(links, scratch).select(F.col("node").alias("doc"), F.col("component").alias("comp")), "comps")
        sizes = c.groupBy("comp").agg((F.count("*") + 1).alias("comp_size"))
        c = c.unionByName(sizes.select(F.col("comp").alias("doc"), "comp")).join(sizes, "comp")
        c = node.select("doc", "meets").join(c, "doc", "left").select("doc", "meets", F.coalesce("comp", "doc").alias("comp"), F.coalesce("comp_size", F.lit(1)).alias("comp_size"))
        return scratch.table(c, "labels")

    def mixed(label: DataFrame, open_groups: DataFrame) -> DataFrame:
        """Members of groups that hold several components, with a pivot of each: of the smallest components' nodes the one that meets most."""
        g = scratch.table(open_groups.join(label, "doc"), "placed")
        order = F.struct("comp_size", -F.col("meets"), F.col("doc").alias("pivot"), F.col("comp").alias("pivot_comp"))
        top = g.groupBy("band").agg(F.min(order).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        top = scratch.table(top.select("band", "top.pivot", "top.pivot_comp"), "top")
        return scratch.table(g.join(top, "band").select("band", "doc", "comp", "pivot", "pivot_comp"), "mixed")

    links, label, left, first = None, labelled(None), groups.select("band", "doc"), None
    for _ in range(ROUNDS):
        m = mixed(label, left)
        first = first if first is not None else m.select("band", "doc", "pivot")
        pairs = m.where("comp <> pivot_comp").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
        new = scratch.table(verified(pairs), "links")
        links = new if links is None else links.unionByName(new)
        label = labelled(links)
        scratch.settle()
        left = m.select("band", "doc")

    comps = label.select("doc", "comp")
    rest = scratch.table(first.join(comps, "doc"), "rest")
    several = rest.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    pairs = rest.join(scratch.table(several, "several"), "band").where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct().join(side(node, "a", na="n"), "a")
    pairs = scratch.table(pairs, "open")
    pairs = pairs.join(scratch.table(pairs.groupBy("b").agg(F.min("na").alias("low")), "low"), "b")
    pairs = pairs.join(side(sets, "a", ha="hashes"), "a").join(side(sets, "b", hb="hashes"), "b")
    kinds = f"doc {kind}, pivot {kind}, n bigint, low bigint, np bigint, lack bigint, least bigint, beyond array<bigint>, lacks array<bigint>"
    diff = scratch.table(pairs.mapInArrow(lambda b: _differences(b, percent), kinds).join(comps, "doc"), "differences")
    index = scratch.table(differences_index(diff, scratch), "index")
    several = index.groupBy("pivot", "hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("pivot", "hash")
    whole = diff.select("pivot", "doc", "n", "np", "lack", F.concat("beyond", "lacks").alias("diff"))
    index = index.join(scratch.table(several, "several"), ["pivot", "hash"]).join(whole, ["pivot", "doc"])
    index = scratch.table(index, "shared")
    x, y = (index.select("pivot", "hash", *(F.col(c).alias(f"{c}_{s}") for c in ("doc", "comp", "n", "np", "lack", "rest", "diff"))) for s in "xy")
    linked = lambda meet: (100 + percent) * meet >= percent * (F.col("n_x") + F.col("n_y"))
    meet = F.col("np_x") - F.col("lack_x") - F.col("lack_y") + F.size(F.array_intersect("diff_x", "diff_y"))
    most = F.col("np_x") - F.greatest("lack_x", "lack_y") + 1 + F.least("rest_x", "rest_y")
    apart = (F.col("doc_x") < F.col("doc_y")) & (F.col("comp_x") != F.col("comp_y"))
    may = 100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")
    pairs = x.join(y, (x["pivot"] == y["pivot"]) & (x["hash"] == y["hash"]) & apart & may & linked(most) & linked(meet))
    links = links.unionByName(scratch.table(pairs.select(F.col("doc_x").alias("a"), F.col("doc_y").alias("b")).distinct(), "links"))
    comp = components(links, scratch).select(F.col("node").alias("rep"), "component")

    named = member.join(comp, "rep", "left").select("doc", F.coalesce("component", "rep").alias("c"))
    named = named.unionByName(comp.select(F.col("rep").alias("doc"), F.col("component").alias("c"))).groupBy("doc").agg(F.min("c").alias("c"))
    out = sig.select("doc", "n").join(named, "doc", "left")
    c = F.coalesce("c", "doc")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == F.col("doc"), F.lit(True)).alias("kept"))

