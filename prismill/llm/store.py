"""Tables and folders that driver and executors share.

Every intermediate result that has to outlive a stage is written below the
folder that the cluster names in ``spark.checkpoint.dir``. Only where that
setting is missing, as in tests, a temporary folder takes its place.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows go to Python in batches; whole texts and sets of hashes are long, so there are fewer of them in one while a table is written.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; where it names none, one made for it on the only machine of a local session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="prismill-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of one query below the shared one; it goes when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        atexit.register(self.close)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: later plans start from files that any executor can read."""
        at, conf = self.folder(name), self.spark.conf
        before = conf.get(BATCH)
        conf.set(BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            conf.set(BATCH, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.tables.append((out, at))
        return out

    def settle(self) -> None:
        """Let go of the shuffle files of steps that are over: Spark removes them once the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for at in [at for t, at in self.tables if any(t is x for x in tables)]:
            remove(self.spark, at)
        self.tables = [x for x in self.tables if not any(x[0] is y for y in tables)]
        self.settle()

    def close(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # the session has ended before; its folder is then the cluster's to clean
            pass
