"""Exact quantiles by distributed selection.

A quantile needs one or two rows of a sorted column. Equal values are counted first, then the
counts are range-partitioned by column, group and value, so that a large group is many parts.
Ranks follow from two levels of prefix sums: over the parts' totals, a table of a few rows a part,
and inside the parts that hold an asked rank. All columns are selected in one go; no task holds a
group, and parts without an asked rank are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import Store


def join_groups(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null equals null; the keys come once, from the left side."""
    right = b.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys))
    return a.join(right, same, how).drop(*(f"_right_{k}" for k in keys))


def exact_quantiles(df: DataFrame, values: dict[str, Column], asked: dict[str, tuple[str, float]], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Quantiles of each group, interpolated between the two nearest values.

    Args:
        values: names of the measured columns; nulls in them do not count.
        asked: a column to return for each (measured column, level from 0 to 1).
        by: grouping columns, null being a group of its own; without any, one row for the table.
        parts: range partitions; as many as the session's shuffles have if None.

    A group without a value of any column has no row; one without a value of some has nulls there.
    """
    by = by or []
    store = Store(df.sparkSession, "quantiles")
    names = list(values)
    order = list(asked)
    cells = F.inline(F.array(*(F.struct(F.lit(i).alias("_q"), values[n].cast("double").alias("_x")) for i, n in enumerate(names))))
    counts = df.select(*by, cells).filter("_x is not null").groupBy(*by, "_q", "_x").agg(F.count("*").alias("_n"))
    key = ["_q", *by]
    ranged = counts.repartitionByRange(parts, *key, "_x") if parts else counts.repartitionByRange(*key, "_x")
    # The parts are stored with their rows: a second run of the range partitioning might draw other bounds.
    counts = store.put(ranged.withColumn("_part", F.spark_partition_id()), by="_part")

    whole = Window.partitionBy(*key)
    totals = counts.groupBy(*key, "_part").agg(F.sum("_n").alias("_m"))
    totals = totals.withColumns({"_all": F.sum("_m").over(whole), "_before": F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_m")})
    asks = []
    for i, (name, level) in enumerate(asked.values()):
        at = F.lit(float(level)) * (F.col("_all") - 1)
        asks += [F.struct(F.lit(names.index(name)).alias("q"), F.lit(i).alias("i"), F.lit(hi).alias("hi"), (F.ceil(at) if hi else F.floor(at)).alias("rank"), (at - F.floor(at)).alias("share")) for hi in (False, True)]
    mine = F.filter(F.array(*asks), lambda a: (a["q"] == F.col("_q")) & (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_m")))
    wanted = totals.withColumn("_asks", mine).filter(F.size("_asks") > 0).select(*key, "_part", "_before", "_asks")

    rows = join_groups(counts, wanted, [*key, "_part"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*key, "_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_upto", upto).withColumn("_a", F.explode("_asks")).filter("_a.rank < _upto and _a.rank >= _upto - _n")
    cell = lambda i, hi, field: F.max(F.when((F.col("_a.i") == i) & (F.col("_a.hi") == hi), F.col(field)))
    columns = []
    for i in range(len(order)):
        low, high, share = cell(i, False, "_x"), cell(i, True, "_x"), cell(i, False, "_a.share")
        columns.append((low * (1 - share) + high * share).alias(order[i]))
    return rows.groupBy(*by).agg(*columns)


def with_quantiles(one: DataFrame, found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A table of one row a group, or of one row, with the quantiles of its groups."""
    if not by:
        return one.crossJoin(F.broadcast(found))
    return join_groups(one, found, by, "left")
