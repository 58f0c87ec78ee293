"""Tables laid out so that readers skip: partitions, sorted files with small row groups, bloom filters, partitions replaced one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, partition_by: str, sort_by: list[str], bloom: list[str] = (), group_bytes: int = 64 << 20, parts: int = 1, mode: str = "overwrite", files: int | None = None) -> None:
    """Write a folder for each value of a column, its files sorted, so that row groups hold ranges of the first sort column.

    Rows of a value are dealt into ``parts`` ranges by the sort columns: a value that holds a large share of all rows is
    several tasks and files. ``bloom`` names columns whose filters say which row groups can't hold a value.
    ``mode`` "replace" overwrites only the partitions that the rows have.
    """
    dealt = df.repartitionByRange(files, partition_by, *sort_by) if files else df.repartitionByRange(partition_by, *sort_by)
    if parts > 1:
        dealt = df.repartition(partition_by, F.pmod(F.xxhash64(*sort_by), F.lit(parts)))
    w = dealt.sortWithinPartitions(partition_by, *sort_by).write.option("parquet.block.size", str(group_bytes))
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if mode == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    w.mode("overwrite" if mode == "replace" else mode).partitionBy(partition_by).parquet(path)


def files_read(df: DataFrame) -> dict[str, int]:
    """What the scans of a plan that has run have read: files, partitions, rows."""
    out = {"files": 0, "partitions": 0, "rows": 0}
    names = {"numFiles": "files", "numPartitions": "partitions", "numOutputRows": "rows"}

    def walk(node) -> None:
        kind = node.nodeName()
        if kind == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if kind.startswith("Scan"):
            for k, name in names.items():
                if node.metrics().contains(k):
                    out[name] += node.metrics().apply(k).value()
        inner = node.plan() if kind.endswith("QueryStage") else None
        if inner is not None:
            walk(inner)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out
