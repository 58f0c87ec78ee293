"""Nearest vectors against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismill.operators import vectors


def rows(seed, n=260, size=6):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 1) + 3 * (i % 4 == j) for j in range(size)]) for i in range(n)]
    out += [(n + i, out[3][1]) for i in range(90)]  # one vector of very many
    out += [(n + 100, [2 * x for x in out[5][1]]), (n + 101, None), (n + 102, [0.0] * size), (n + 103, [1.0] * (size - 1)), (n + 104, [math.nan, *[1.0] * (size - 1)])]
    return [*out, (n + 105, [None, *[1.0] * (size - 1)]), (None, out[7][1]), (n + 106, [math.inf, *[1.0] * (size - 1)]), out[9]]


def by_force(data, size, best):
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in data if i is not None and v and len(v) == size and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    out = {}
    for i, v in ok.items():
        if i % 3 == 0:
            out[i] = sorted((-round(float(v @ w), 7), j) for j, w in ok.items() if j != i)[:best]
    return out


@pytest.mark.parametrize("seed,cells", [(1, 1), (2, 12)])
def test_exact_nearest_against_all_pairs(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "PART", 30)
    data = rows(seed)
    d = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    index = vectors.build(d, "id", "v", 6, best=5, cells=cells)
    got = {}
    for r in vectors.exact_nearest(index, d.where("id % 3 = 0"), "id", "v", best=5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((-round(r.similarity, 7), r.neighbour))
        assert r.rank == len(got[r.id])
    want = by_force(data, 6, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [s for s, _ in got[i]] == pytest.approx([s for s, _ in want[i]], abs=2e-7)
        assert len({j for _, j in got[i]}) == 5 and i not in {j for _, j in got[i]}
    assert got[3] == want[3]  # the ids of equal vectors in order


def test_cells_find_most_and_no_pair_outside_them_is_made(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 8)) * 4
    data = [(i, (centres[i % 20] + rng.standard_normal(8)).tolist()) for i in range(2000)]
    d = spark.createDataFrame(data, "id long, v array<double>")
    q = d.where("id % 20 < 3")
    index = vectors.build(d, "id", "v", 8)
    probes = vectors.probes_for(index, q, "id", "v")
    found = {(r.id, r.neighbour) for r in vectors.nearest(index, q, "id", "v", probes=probes).collect()}
    exact = {(r.id, r.neighbour) for r in vectors.exact_nearest(index, q, "id", "v").collect()}
    assert len(found & exact) >= 0.9 * len(exact) and probes < len(index.mean) / 2
    pairs = vectors._probes(index, q.select(F.col("id").alias("q"), vectors.unit("v", 8).alias("v")), probes, "bigint")
    assert pairs.count() == probes * q.count()


def test_empty_tables_and_too_few_rows(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    index = vectors.build(d, "id", "v", 2, best=3)
    assert [tuple(r) for r in vectors.exact_nearest(index, d, "id", "v", best=3).orderBy("id").collect()] == [(1, 1, 2, 1.0), (2, 1, 1, 1.0)]
    none = vectors.build(d.limit(0), "id", "v", 2, best=3)
    assert vectors.exact_nearest(none, d, "id", "v", best=3).count() == 0 and vectors.nearest(index, d.limit(0), "id", "v", best=3).count() == 0
    assert vectors.probes_for(index, d.limit(0), "id", "v", best=3) == 1
    with pytest.raises(ValueError):
        vectors.nearest(index, d, "id", "v", best=4)


def test_no_batch_of_pairs_grows_with_the_cells(monkeypatch):
    import pyarrow as pa

    class Frame:  # holds what would run in a task
        def select(self, *columns):
            return self

        def mapInArrow(self, run, shape):  # noqa: N802
            return run

    class Live:
        def select(self, *columns):
            return self

        def collect(self):
            from pyspark.sql import Row

            return [Row(cell=i, radius=4.0) for i in range(300)]

    rng = np.random.default_rng(1)
    monkeypatch.setattr(vectors, "HELD", 2000, raising=False)
    index = vectors.Cells(rng.standard_normal((300, 8)), None, Live(), 8, 11, None)
    x = rng.standard_normal((50, 8))
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(x.tolist()), pa.array([9.0] * 50)], names=["q", "v", "far"])
    for run, n in ((vectors._within(index, Frame(), "bigint"), 300), (vectors._probes(index, Frame(), 40, "bigint"), 40)):
        out = list(run([b]))
        assert max(o.num_rows for o in out) <= 2000 // 8 and sum(o.num_rows for o in out) == 50 * n
        pairs = {(q, c): v for o in out for q, v, c in zip(*(o.column(k).to_pylist() for k in ("q", "v", "cell")))}
        assert len(pairs) == 50 * n and all(v == x[q].tolist() for (q, _), v in pairs.items())
    far = ((x[:, None] - index.mean[None]) ** 2).sum(2)
    assert set(pairs) == {(q, int(c)) for q in range(50) for c in np.argsort(far[q])[:40]}
