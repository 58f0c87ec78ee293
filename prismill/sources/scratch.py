"""Tables and folders of a query that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one made for the only machine of a local session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="prismill-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """A folder of one query below the shared one; it goes when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back: later plans start from files that any executor can read."""
        at = self.folder(name)
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this folder that no plan reads any more."""
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if f"/{self.path.rpartition('/')[2]}/" in folder:
                self.delete(folder)

    def size(self, *paths: str) -> int:
        """Bytes of files and folders; those that don't exist have none."""
        total, conf = 0, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            files = where.getFileSystem(conf)
            total += files.getContentSummary(where).getLength() if files.exists(where) else 0
        return total

    def delete(self, folder: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        try:
            self.delete(self.path)
        except Exception:  # the session has ended before; its folder is then the cluster's to clean
            pass
