"""As-of joins: each left row with the latest right row published before it.

The join is a union of both sides and one window that carries the last right row forward: one
shuffle by key, no matter how many right rows a key has. Keys of more than ``hot_rows`` rows, as
counted in the same plan, are cut into slices of time that have about so many; with ``bucket`` all
keys are cut at time buckets. What earlier slices leave is carried over a table with one row per key
and slice, so that no key, and no series without a key, has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import instant
from .quantiles import join_groups

#: Rows of a key, of both sides, above which its window is cut into slices.
HOT_ROWS = 1_000_000


def _carry(left: DataFrame, right: DataFrame, part: list[str], strict: bool) -> DataFrame:
    """``left(part, _t, _l)`` with ``_r``, the last ``right(part, _t, _r)`` before."""
    side = 1 if strict else -1
    both = left.withColumn("_s", F.lit(0)).unionByName(right.withColumn("_s", F.lit(side)), allowMissingColumns=True)
    w = Window.partitionBy(*part).orderBy("_t", "_s", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_s") == 0)


def _sliced(left: DataFrame, right: DataFrame, names: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_b``, a slice of time, and ``_hot``: keys with more rows have slices of equal length, about ``hot_rows`` rows each."""
    t = F.unix_micros("_t")
    sizes = left.select(*names, "_t").unionByName(right.select(*names, "_t")).groupBy(*names).agg(F.count("*").alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi")).filter(F.col("_n") > hot_rows)
    sizes = sizes.select(*names, "_lo", (F.col("_hi") - F.col("_lo") + 1).alias("_wide"), F.ceil(F.col("_n") / hot_rows).alias("_k"))
    place = F.least(F.floor((t - F.col("_lo")).cast("double") / F.col("_wide") * F.col("_k")), F.col("_k") - 1)
    cut = lambda df: join_groups(df, sizes, names, "left").withColumns({"_b": F.coalesce(place, F.lit(0)), "_hot": F.col("_k").isNotNull()}).drop("_lo", "_wide", "_k")
    return cut(left), cut(right)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_time: str,
    right_time: str,
    on: list[str] | None = None,
    columns: dict[str, str] | None = None,
    strict: bool = True,
    tie: list[str] | None = None,
    bucket: str | None = None,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Left as-of join: every left row once, with columns of the latest earlier right row of its key.

    Args:
        on: key columns of both sides; without any, ``bucket`` is 'day' by default.
        columns: right columns to add and their new names; all but the keys if None.
        strict: a right row at the very instant of the left one does not count.
        tie: right columns that decide between right rows of one instant (the largest counts).
        bucket: cuts every key at these times; without it keys of more than ``hot_rows`` rows are cut,
            which costs a count of both sides' keys, or none if that is None.

    Rows with a null key or time match nothing. Left columns keep their names.
    """
    keys = on or []
    bucket = bucket or (None if keys else "day")
    columns = columns or {c: c for c in right.columns if c not in keys}
    kept = F.struct(*(F.col(c).alias(c) for c in left.columns))
    keyed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    added = F.struct(*(F.col(a).alias(b) for a, b in columns.items()))
    order = F.struct(*tie).alias("_o") if tie else F.lit(0).alias("_o")
    some = instant(right_time).isNotNull()
    for k in keys:
        some = some & F.col(k).isNotNull()
    r = right.filter(some).select(*keyed, instant(right_time).alias("_t"), order, added.alias("_r"))
    lf = left.select(*keyed, instant(left_time).alias("_t"), kept.alias("_l"))
    if bucket is None and hot_rows is None:
        out = _carry(lf, r, names, strict)
    else:
        if bucket is None:
            lf, r = _sliced(lf, r, names, hot_rows)
        else:
            lf, r = (x.withColumns({"_b": F.date_trunc(bucket, "_t"), "_hot": F.lit(True)}) for x in (lf, r))
        where = [*names, "_b"]
        near = _carry(lf.drop("_hot"), r.drop("_hot"), where, strict)
        # One row per key and slice: what the slice leaves to later ones.
        leaves = r.filter("_hot").groupBy(*where).agg(F.max_by("_r", F.struct("_t", "_o")).alias("_x"))
        asked = lf.filter("_hot").select(*where).distinct().join(leaves, where, "full")
        w = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        before = asked.select(*where, F.last("_x", ignorenulls=True).over(w).alias("_x"))
        out = join_groups(near, before, where, "left").select("_l", "_t", F.coalesce("_r", "_x").alias("_r"))
    ok = F.col("_t").isNotNull()
    return out.select("_l.*", *(F.when(ok, F.col("_r")[b]).alias(b) for b in columns.values()))


def asof_by_max(left: DataFrame, right: DataFrame, *, key: str, left_id: str, left_time: str, right_time: str, value: str) -> DataFrame:
    """The same join by another route, inequality join and ``max_by``: for checks of the first."""
    r = right.select(F.col(key).alias("_k"), instant(right_time).alias("_t"), F.col(value).alias("_v"))
    j = left.join(r, (left[key] == r["_k"]) & (r["_t"] < instant(left[left_time])), "left")
    return j.groupBy(left_id).agg(F.max_by("_v", "_t").alias(value))


def too_late(left: DataFrame, right: DataFrame, on: list[str], left_time: Column, right_time: Column, left_id: str) -> DataFrame:
    """Right rows of a left row's key that came at or after it: rows and left rows concerned."""
    j = left.join(right, on).filter(right_time >= left_time)
    return j.agg(F.count("*").alias("n_late"), F.countDistinct(left_id).alias("n_rows_late"))


def point_in_time(targets: DataFrame, prices: DataFrame, vintages: dict[str, tuple[DataFrame, dict[str, str]]], *, target: str = "target_time", decision: str = "decision_time", published: str = "published_at") -> DataFrame:
    """One row per target: the price of the target, and of every vintage table the values published strictly before the decision.

    ``vintages`` maps a prefix to its table (unique in target and publication, so a target has few)
    and the columns to take with their new names; ``<prefix>_published_at`` comes with them.
    """
    out = targets.join(prices, target, "left")
    for prefix, (table, columns) in vintages.items():
        cols = columns | {published: f"{prefix}_published_at"}
        out = asof_join(out, table, on=[target], left_time=decision, right_time=published, columns=cols, hot_rows=None)
    return out


def availability_check(frame: DataFrame, decision: str, published: list[str]) -> DataFrame:
    """Attached publications that are not strictly before the decision, and the least margin in hours."""
    bad = [F.count_if(F.col(p) >= F.col(decision)).alias(f"{p}_late") for p in published]
    margin = [F.min((F.unix_timestamp(decision) - F.unix_timestamp(p)) / 3600).alias(f"{p}_margin_hours") for p in published]
    return frame.agg(*bad, *margin)
