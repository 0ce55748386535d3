"""Named views over Parquet, landed JSON envelopes, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def register_views(spark: SparkSession, base: str, names: list[str], required: list[str] | None = None) -> list[str]:
    """A view for every table that exists; a required one that does not is an error, and so is one that cannot be read."""
    found = []
    for name in names:
        try:
            read_table(spark, base, name).createOrReplaceTempView(name)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(name)
    if missing := sorted(set(required or []) - set(found)):
        raise ContractError(f"no table {missing} in {base}")
    return found


def query_file(spark: SparkSession, path: str, **params) -> DataFrame:
    """Runs a SQL file with named parameters."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.sql(text, args=params)


def read_envelopes(spark: SparkSession, path: str, schema: str, field: str = "data", drop: tuple[str, ...] = ("_id",)) -> DataFrame:
    """Rows of landed JSON responses: a list, or an object that holds the list in ``field`` (dots descend)."""
    inner = f"array<struct<{schema}>>"
    text = spark.read.text(path, wholetext=True)
    plain = F.from_json("value", inner)
    wrapped = F.from_json(F.get_json_object("value", f"$.{field}"), inner)
    rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), plain).otherwise(wrapped)).alias("r")).select("r.*")
    return rows.drop(*drop)


def read_many(spark: SparkSession, glob: str, exclude: list[str] | None = None) -> DataFrame:
    """All Parquet files of a pattern but those whose name holds an excluded word."""
    df = spark.read.option("mergeSchema", "true").parquet(glob)
    for word in exclude or []:
        df = df.filter(~F.col("_metadata.file_name").contains(word))
    return df


def write_report(report: DataFrame, path: str) -> None:
    """A quality report as JSON lines."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_clustered(df: DataFrame, path: str, time: str, by: list[str] | None = None, *, files: int | None = None, most_rows: int = 5_000_000) -> None:
    """Writes a table in the order of ``time`` (then ``by``): files of a range of times each, sorted, of at most ``most_rows`` rows.

    The least and greatest time of each file and row group are those of its range, so that readers
    with a restriction in time skip the others. ``files`` is the number of ranges; as many as the
    session's shuffles have if None. Instants are written as microseconds, since Parquet keeps no
    bounds for Spark's default form of them.
    """
    spark = df.sparkSession
    kind = "spark.sql.parquet.outputTimestampType"
    before = spark.conf.get(kind)
    ranged = df.repartitionByRange(files, time) if files else df.repartitionByRange(time)
    spark.conf.set(kind, "TIMESTAMP_MICROS")
    try:
        ranged.sortWithinPartitions(time, *(by or [])).write.mode("overwrite").option("maxRecordsPerFile", most_rows).parquet(path)
    finally:
        spark.conf.set(kind, before)
