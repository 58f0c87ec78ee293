"""A sum of doubles that is right to the last bit, however rows are dealt: partial states in Arrow batches, merged by key.

A state is a list of doubles that don't overlap and whose sum is exact. A task
adds up its batches and gives one state for each key; states of a key meet in
``SALTS`` groups first and then in one, so a key of very many tasks isn't held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose states a task holds at once; beyond that they are given out early, and merged as others are.
HELD = 50_000
SALTS = 32


def exact_parts(numbers: list[float]) -> list[float]:
    """Doubles of the same exact sum, of which none overlaps another: what is left after rounding the sum, again and again."""
    parts, rest = [], list(numbers)
    while True:
        top = math.fsum(rest)
        if top == 0 or not math.isfinite(top):
            return [*parts, top] if top else parts
        parts.append(top)
        rest.append(-top)


def exact_sum(df: DataFrame, by: list[str], value: str, to: str) -> DataFrame:
    """Per group the correctly rounded sum. Nulls don't count; a group of nulls has null; NaN and infinities as in any sum."""
    d = df.select(*by, F.col(value).cast("double").alias("v"))
    key = d.select(*by).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key)
    state = f"{fields}, n long, odd double, parts array<double>"

    def batch(held: dict, columns: list) -> pa.RecordBatch:
        keys = list(held)
        arrays = [pa.array([k[i] for k in keys], c) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([held[k][i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.list_(pa.float64()))))], names=[*by, "n", "odd", "parts"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = {}, None
        for b in batches:
            kinds = [b.schema.field(c).type for c in by]
            t = pa.Table.from_batches([b]).group_by(by).aggregate([("v", "list")])
            for row in zip(*(t.column(c).to_pylist() for c in [*by, "v_list"]), strict=True):
                x = np.array([y for y in row[-1] if y is not None])
                fine = x[np.isfinite(x)]
                n, odd, parts = held.get(row[:-1], (0, 0.0, []))
                held[row[:-1]] = (n + len(x), odd + float(x[~np.isfinite(x)].sum()), exact_parts([*parts, *fine.tolist()]))
            if len(held) > HELD:
                yield batch(held, kinds)
                held = {}
        if held:
            yield batch(held, kinds)

    def merged(t: pa.Table) -> pa.Table:
        parts = exact_parts([x for p in t.column("parts").to_pylist() for x in p])
        head = t.slice(0, 1).select(by)
        more = [pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([sum(t.column("odd").to_pylist())], pa.float64()), pa.array([parts], pa.list_(pa.float64()))]
        return pa.table([*head.columns, *more], names=[*by, "n", "odd", "parts"])

    states = d.mapInArrow(partial, state)
    some = states.withColumn("salt", F.pmod(F.xxhash64("n", "parts"), F.lit(SALTS))).groupBy(*by, "salt").applyInArrow(lambda t: merged(t.drop_columns(["salt"])), state)
    whole = some.groupBy(*by).applyInArrow(lambda t: merged(t), state)
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    return whole.select(*by, F.when(F.col("n") > 0, F.when((F.col("odd") != 0) | F.isnan("odd"), F.col("odd")).otherwise(total)).alias(to))
