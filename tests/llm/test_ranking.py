"""Ranked search, quality and periodic runs against brute force, derivatives by differences and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import edge
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check

from prismill.llm import quality, queries, runs, search


def all_runs(w):
    """Every period over the whole text."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and i > s:
                out.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 7)), max_size=9), st.lists(st.sampled_from("abx"), max_size=12))
def test_runs_against_every_period(parts, tail):
    w = [c.encode() for part, n in parts for c in part * n] + [c.encode() for c in tail]
    w += w[: len(w) // 2]
    assert runs.runs(w) == all_runs(w)


def test_runs_of_large_and_nested_periods():
    rng = random.Random(4)
    inner = [f"w{rng.randrange(9)}".encode() for _ in range(40)] + [b"x"] * 9
    w = inner * 5 + [b"y"] + inner[20:] * 7 + [b"a", b"b"] * 400 + [str(i).encode() for i in range(50)] + inner * 4
    assert runs.runs(w) == all_runs(w) and len(runs.runs(w)) > 12


def test_factors_are_the_longest_with_an_earlier_occurrence():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.choice("aabc") for _ in range(rng.randrange(40))]
        at = 0
        for begin, end, source in runs.factors(w, [(0, len(w))]):
            size = max((k for k in range(1, len(w) - begin + 1) for s in range(begin) if w[s : s + k] == w[begin : begin + k]), default=0)
            assert (begin, end - begin) == (at, max(size, 1)) and (source < 0) == (size == 0)
            assert source < 0 or source < begin and w[source : source + size] == w[begin:end]
            at = end
        assert at == len(w)


def described_by_force(doc_id, text):
    w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randrange(90))) for _ in range(200)]
    texts += [None, "", " \n\t ", "a\x0b\x0ca a\ra a a", "é é é é é é 😀 x    ", texts[3], "one", *(f"p{i} " * 7 + "q r " * 5 for i in range(20))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, "a a a a a a a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((described_by_force(i, t) for i, t, _ in rows), key=str)
    assert sum(r[1] > 0 for r in got) >= 40
    assert runs.described(docs.limit(0)).count() == 0
    plain = {r.doc_id: r.n_runs for r in runs.described(edge.documents(spark)).collect()}
    assert plain[0] == plain[1] == plain[7] == 0 and plain[6] == 1  # 4,001 words over and over
    other = {r.key: r.period for r in runs.described(spark.createDataFrame([("k", "a b " * 4)], "key string, body string"), "key", "body").collect()}
    assert other == {"k": 2}


def ranked_by_force(docs, items, best=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [(i, Counter(words(t)), len(words(t))) for i, t in docs if words(t)]
    n, length = len(terms), sum(x for *_, x in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c, size in terms:
            m = 25 + 75 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            found += [(-score, doc is None, doc)] if score > 0 else []
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "Ünder", "X9", f"w{int(rng.expovariate(0.04))}", f"w{int(rng.expovariate(0.2))}"])
    docs = [(i, " ,".join(word() for _ in range(rng.randrange(40)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "..."), (2003, edge.LONG), (2004, edge.WORD)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(25)))) for i in range(40)]
    items += [(3, items[3][1]), (None, items[4][1]), (90, None), (91, "???"), (92, "nowhere1 nowhere2"), (93, docs[5][1] + " w0 W0")]
    want = ranked_by_force(docs, items)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for sizes in ({}, {"shard_bytes": 500}, {"shard_bytes": 2000, "item_bytes": 1000}, {"term_bytes": 0}):
        assert sorted(map(tuple, search.ranked(d, q, **sizes).collect()), key=str) == want, sizes
    for empty in (search.ranked(d.limit(0), q), search.ranked(d, q.limit(0))):
        assert empty.columns == ["item_id", "rank", "doc_id", "score"] and empty.count() == 0


def test_terms_are_those_of_the_pattern():
    every = "".join(f"a{chr(c)}B" for c in range(0x250)) + "日本 語😀Σ"
    want = [t.encode() for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), every))]
    assert search.terms(every) == want and search.terms(None) == []


def test_non_essential_lists_are_hardly_read():
    rng = np.random.default_rng(2)
    n, shards = 3000, 4
    common = [("the", 0.9), ("of", 0.8), ("and", 0.7)]
    full = search.MaxScore([{"the": 1, "of": 1, "and": 1, "rare": 2}], {"the": 3, "of": 5, "and": 8, "rare": 5000}, n * shards, 100 * n * shards)
    for shard in range(shards):
        lists = {t: (d := np.flatnonzero(rng.random(n) < p).astype(np.int32), np.ones(len(d), np.int32)) for t, p in [*common, ("rare", 0.02)]}
        full.shard(list(range(shard * n, shard * n + n)), np.full(n, 100, np.int32), lists)
    assert len(full.top[0]) == 10 and full.added + full.probed < 0.35 * shards * n * 2.4


def test_search_query(spark, tiny):
    check(spark, queries.op11_ranked_search, queries.ORACLES["op11_ranked_search"], tiny)


def test_derivatives_of_the_network():
    rng = np.random.default_rng(1)
    passages = np.array([1, 3, 2, 5])
    x, y, weight = rng.standard_normal((11, quality.FEATURES)), np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 0.5, 1])
    model = quality.Attention.fresh(x, 3)

    def loss():
        s = model.forward(x, passages)[-1]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean() + quality.DECAY / 2 * sum((v**2).sum() for v in model.p.values())

    for k, g in model.gradients(x, passages, y, weight).items():
        at = tuple(rng.integers(s) for s in g.shape)
        before, step = model.p[k][at], 1e-5
        model.p[k][at] = before + step
        up = loss()
        model.p[k][at] = before - step
        down = loss()
        model.p[k][at] = before
        assert abs((up - down) / (2 * step) - g[at]) < 1e-6, k


def test_attention_weights_of_a_document_sum_to_one_and_find_the_passage():
    rng = random.Random(8)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts, labels = [], []
    for i in range(240):
        parts = [plain(64) for _ in range(rng.randint(3, 6))]
        if i % 2:
            parts[rng.randrange(len(parts))] = " ".join(["#$x"] * 64)
        texts.append(" ".join(parts))
        labels.append(1.0 - i % 2)
    x, n = quality.encoded(texts)
    model = quality.learned(x, n, np.array(labels))
    *_, a, _, score = model.forward(x, n)
    heads = np.cumsum(n) - n
    assert np.allclose(np.add.reduceat(a, heads), 1) and ((score > 0.5) == (np.array(labels) > 0.5)).mean() > 0.97
    hit = [int(np.argmax(a[h : h + k])) == next(j for j in range(k) if "#" in " ".join(t.split()[64 * j : 64 * j + 64])) for h, k, t in list(zip(heads, n, texts, strict=True))[1::2]]
    assert np.mean(hit) > 0.9


def test_features_do_not_depend_on_other_texts():
    texts = [*edge.TEXTS, "  lead " + "w " * 64 + "x", "ends\n", None]
    x, n = quality.encoded(texts)
    own = [quality.encoded([t]) for t in texts]
    assert n.tolist() == [int(k[0]) for _, k in own] and np.allclose(x, np.concatenate([f for f, _ in own]), atol=1e-6)
    assert n[texts.index(edge.LONG)] == math.ceil(60_000 / 64) and n[0] == 1


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op12_quality(spark, folder).toPandas()
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out, strict=True))
    known = got.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.quality).mean() > 0.93 and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x) for x in (labels, turned))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_quality_edges(spark):
    d = edge.documents(spark)
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(10)] + [(None, 1, "x"), (3, None, "x"), (4, 1, "y")], "doc_id long, quality int, text string")
    model = quality.fit(d, labels)
    got = quality.scored(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 and 0 <= r.focus < r.n_passages for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2)}) == 2  # null and empty alike; white space has a sign
    assert quality.fit(d, labels.limit(0)) is None and {r.score for r in quality.scored(d, None).collect()} == {0.5}
    assert quality.scored(edge.empty(spark), model).count() == 0 and quality.fit(edge.empty(spark), labels) is None
