"""Tables written once in the folder that driver and executors share.

A stored table is computed once, however often it is read, and lost executors cost no
recomputation of what came before it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a single machine, a new temporary folder, on a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _tidy() -> None:
    """Removes what lazily read results still needed, when the program ends before its session."""
    for path, spark in _folders.items():
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


class Store:
    """Stored tables of one use; they go when the program ends, or with ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _folders[self.root] = spark

    def put(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """The table, written and read back; ``by`` names a column of few values that readers prune by."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def drop(self) -> None:
        remove(self.spark, self.root)
        _folders.pop(self.root, None)
