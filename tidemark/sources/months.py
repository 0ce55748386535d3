"""A raw zone of months that stay as they were first read.

Each write puts its files into a folder of its own, where no reader looks. A month comes to be, or
changes, only by its manifest: a small file that lists the month's files with their rows, checksum
and the time of reading, written last under a temporary name and put in place by one atomic
rename. A writer that dies before leaves nothing that is seen; readers take the files that the
manifests named when they began, so a refresh meanwhile does not mix with what they read.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError

_MANIFESTS, _DATA = "_manifests", "data"


class _Folder:
    """The few calls of Hadoop's file systems that manifests need; paths may be of any store Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway, self.root = spark._jvm, spark.sparkContext._gateway, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes under a temporary name and renames over what is there, in one step."""
        temporary = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        target = self.fs.makeQualified(self.path(name))
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(self.fs.makeQualified(temporary), target, options)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifests(spark: SparkSession, path: str) -> dict[str, dict]:
    """The manifests of all months: ``files``, ``rows``, ``checksum``, ``read_at``, ``version``."""
    folder = _Folder(spark, path)
    return {n.removesuffix(".json"): json.loads(folder.read(f"{_MANIFESTS}/{n}")) for n in folder.names(_MANIFESTS) if n.endswith(".json")}


def _sums(rows: DataFrame) -> DataFrame:
    """Rows and checksum of each month; neither the order of rows nor that of files changes it."""
    h = F.xxhash64(*(c for c in rows.columns if c != "month"))
    return rows.groupBy("month").agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("checksum"))


def write_months(df: DataFrame, path: str, time: str, *, force: bool = False, read_at: dt.datetime | None = None) -> list[str]:
    """Adds the frame's months that the zone does not have; with ``force`` also replaces those it has. Returns what it wrote.

    Rows of frozen months are left out before anything is computed for them, so that a repeated run
    over a lazily read source fetches only what is missing. Rows without a time are refused.
    """
    spark = df.sparkSession
    folder, frozen = _Folder(spark, path), manifests(spark, path)
    month = F.date_format(time, "yyyy-MM")
    rows = df.withColumn("month", F.when(F.col(time).isNull(), F.raise_error(F.lit(f"a row has no {time}"))).otherwise(month))
    if frozen and not force:
        rows = rows.filter(~F.coalesce(month.isin(list(frozen)), F.lit(False)))
    version = uuid.uuid4().hex
    target = f"{path.rstrip('/')}/{_DATA}/version={version}"
    rows.write.partitionBy("month").parquet(target)
    names = [n.removeprefix("month=") for n in folder.names(f"{_DATA}/version={version}") if n.startswith("month=")]
    if not names:
        folder.remove(f"{_DATA}/version={version}")
        return []
    # Read back with the schema that was written: the months are names, not numbers.
    back = spark.read.schema(rows.schema).parquet(target)
    sums = {r["month"]: r for r in _sums(back).collect()}
    files: dict[str, list[str]] = {n: [] for n in names}
    for n in names:
        files[n] = [f"{_DATA}/version={version}/month={n}/{f}" for f in folder.names(f"{_DATA}/version={version}/month={n}") if not f.startswith(("_", "."))]
    at = (read_at or dt.datetime.now(dt.timezone.utc)).isoformat()
    for n in names:
        folder.put(f"{_MANIFESTS}/{n}.json", json.dumps({"month": n, "version": version, "files": files[n], "rows": sums[n]["rows"], "checksum": sums[n]["checksum"], "read_at": at, "schema": df.schema.json()}))
    return names


def read_months(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The rows of the months first to last as their manifests have them now, with the month in ``month``."""
    own = {n: m for n, m in manifests(spark, path).items() if first <= n <= last}
    if not own:
        raise ContractError(f"no month from {first} to {last} in {path}")
    root = path.rstrip("/")
    read = spark.read.option("basePath", f"{root}/{_DATA}").option("mergeSchema", "true")
    out = read.parquet(*(f"{root}/{f}" for m in own.values() for f in m["files"]))
    columns = [c for c in out.columns if c not in ("version", "month")]
    return out.select(*columns, F.date_format(F.col("month").cast("string"), "yyyy-MM").alias("month"))


def verify_months(spark: SparkSession, path: str) -> DataFrame:
    """For every month the rows and checksum of its manifest beside those of its files, and whether they agree."""
    own = manifests(spark, path)
    names = list(own)
    told = spark.createDataFrame([(n, own[n]["rows"], own[n]["checksum"]) for n in names], "month string, rows_told long, checksum_told string")
    if not names:
        return told.withColumns({"rows": F.lit(0).cast("long"), "checksum": F.lit(""), "agrees": F.lit(True)})
    seen = _sums(read_months(spark, path, min(names), max(names)))
    return told.join(seen, "month", "left").withColumn("agrees", F.coalesce((F.col("rows") == F.col("rows_told")) & (F.col("checksum") == F.col("checksum_told")), F.lit(False)))


def remove_old_versions(spark: SparkSession, path: str, keep: set[str] | None = None) -> list[str]:
    """Removes the files of writes that no manifest names any more, but those to ``keep``; for times when nobody reads or writes."""
    folder = _Folder(spark, path)
    named = {m["version"] for m in manifests(spark, path).values()} | (keep or set())
    gone = [n.removeprefix("version=") for n in folder.names(_DATA) if n.startswith("version=") and n.removeprefix("version=") not in named]
    for v in gone:
        folder.remove(f"{_DATA}/version={v}")
    return gone
