"""Spark-side helpers of the corpus operators: shared work folder, bounded bitmaps, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of a batch between Spark and Python while tables are written; both sides hold a few at once.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of ``BATCH_BYTES`` for the jobs that run meanwhile; the session's own setting comes back afterwards."""
    before = spark.conf.get(_BATCH_SETTING, None)
    spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH_SETTING)
        else:
            spark.conf.set(_BATCH_SETTING, before)


def trim() -> None:
    """Hands freed memory back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a ``mapInArrow``, which leaves no freed memory with the worker that waits for its next task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return tidied


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset on a single machine, as in tests, a new temporary folder is chosen and set;
    on a cluster, whose machines share no such folder, that is an error.
    """
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


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with underscores in front until no column has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


_folders: dict[str, SparkSession] = {}


@atexit.register
def _tidy() -> None:
    """Removes the folders that lazily read results still needed, when the program ends before its session."""
    for path, spark in _folders.items():
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Workspace:
    """Tables written once in the shared folder, so that lost executors cost no recomputation.

    Each use has a folder of its own; ``drop`` removes a table that nothing reads any more, and
    what is left goes when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _folders[self.root] = spark

    def write(self, df: DataFrame, small: bool = False) -> DataFrame:
        """The table, read back; ``small`` ones, of a few numbers a row, get two files a core at most."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        if small:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def release(self) -> None:
        """Lets Spark remove the shuffle files of finished jobs: it does so when their plans are garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes a result and removes all other tables."""
        hold = Workspace(self.spark, "result")
        out = hold.write(df)
        _remove(self.spark, self.root)
        _folders.pop(self.root, None)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_tidemark_path", None)
            if path:
                _remove(self.spark, path)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@functools.cache
def bitmap_size(log_bits: int) -> int:
    """The largest prime below 2**log_bits: values in arithmetic progressions spread over all slots."""
    n = (1 << log_bits) - 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):
        n -= 2
    return n


def bitmap_slots(x: np.ndarray, log_bits: int) -> np.ndarray:
    """Slot of 64-bit values in a bitmap of 2**log_bits bits."""
    return x.view(np.int64) % bitmap_size(log_bits)


def bitmap(df: DataFrame, column: str, log_bits: int) -> np.ndarray:
    """A bitmap of the values' slots as uint8 bytes: 2**(log_bits - 3) bytes, whatever the rows are.

    A value whose bit is not set is surely absent; a set bit may be another value's. The driver
    gets blocks of 4096 bytes, one at a time.
    """
    slot = F.pmod(F.col(column), F.lit(bitmap_size(log_bits)))
    blocks = df.filter(F.col(column).isNotNull()).select(F.shiftright(slot, 15).alias("w"), slot.bitwiseAND(F.lit(32767)).alias("b"))
    out = np.zeros(max((1 << log_bits) >> 15, 1) * 4096, np.uint8)
    for r in blocks.groupBy("w").agg(F.bitmap_construct_agg("b").alias("m")).toLocalIterator():
        out[r["w"] * 4096 : (r["w"] + 1) * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def in_bitmap(bits: np.ndarray, x: np.ndarray, log_bits: int) -> np.ndarray:
    s = bitmap_slots(x, log_bits)
    return (bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1


def bitmap_bits(values: int, least: int = 16, most: int = 28) -> int:
    """log2 of a bitmap's bits: sixteen a value, 2**28 (32 MB) at most."""
    return int(min(max(np.ceil(np.log2(max(values, 1) * 16)), least), most))


def without(docs: DataFrame, gone: DataFrame, key: Column, repeated: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``key``, a long, is not in ``gone(key)``; of rows with one key of ``repeated(key)`` one stays.

    A bitmap of bounded size tells which rows may be concerned. Only these, and not the texts of
    all others, meet the keys in a shuffle. Of rows with the same key the smallest stays; rows
    whose key is null all stay.
    """
    asked = gone if repeated is None else gone.union(repeated)
    log_bits = bitmap_bits(4 * asked.count())
    bits = bitmap(asked, "key", log_bits)
    own, mark = (free_name(x, docs.columns) for x in ("key", "concerned"))

    @F.pandas_udf("boolean")
    def concerned(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bits, x.to_numpy(np.int64), log_bits))

    # Without nulls, with which pandas would make doubles of the keys.
    marked = docs.withColumn(own, key.cast("long"))
    marked = marked.withColumn(mark, F.col(own).isNotNull() & concerned(F.coalesce(own, F.lit(0).cast("long"))))
    left = marked.filter(mark).drop(mark).join(gone.select(F.col("key").alias(own)), own, "left_anti")
    if repeated is not None:
        again = repeated.select(F.col("key").alias(own)).distinct()
        # Equal rows combine before the shuffle, however many there are.
        ordered = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
        row = F.struct(*docs.columns)
        one = left.join(again, own, "left_semi").groupBy(own).agg(F.min_by(row, F.struct(*ordered)).alias("r")).select("r.*")
        left = left.join(again, own, "left_anti").select(*docs.columns).unionByName(one)
    return marked.filter(f"not `{mark}`").select(*docs.columns).unionByName(left.select(*docs.columns))


def contracted(edges: DataFrame, ws: Workspace, rounds: int | None = None) -> DataFrame:
    """Edges ``(u, v)``, u larger than v, of the same connected components as ``edges(a, b)``; after all rounds v is the smallest vertex.

    Alternating large-star and small-star rounds; every round is aggregations and joins over the
    edges, written to the shared folder. A vertex with very many edges is one aggregated minimum
    and a join that Spark may split. Edges that have become equal are one.
    """
    cur = ws.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), small=True)
    before, done = None, 0
    while rounds is None or done < rounds:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = ws.write(large.distinct(), small=True)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = ws.write(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), small=True)
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first() if rounds is None else None
        ws.drop(cur, large)
        cur, done = nxt, done + 1
        if rounds is None and now == before:
            break
        before = now
    return cur


def labels(cur: DataFrame, ws: Workspace) -> DataFrame:
    """``(c, k)`` for every vertex of contracted edges, k some vertex of its component: the smallest after all rounds."""
    label = cur.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("k"))
    roots = cur.select(F.col("v").alias("c")).distinct().join(label, "c", "left_anti").select("c", F.col("c").alias("k"))
    return ws.write(label.union(roots), small=True)


def components(edges: DataFrame, ws: Workspace, rounds: int | None = None) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(c, k)`` for every vertex, k the smallest vertex reachable.

    After a limited number of rounds, k is some vertex of the component, not the same for all of
    it: enough where labels only save work.
    """
    cur = contracted(edges, ws, rounds)
    out = labels(cur, ws)
    ws.drop(cur)
    return out
