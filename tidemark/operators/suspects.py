"""Audit of a run of suspect days as one plan: was the block made again after the fact?

The run is found where the data has it, the longest of a year, and joined back as a row; the
windows it is compared in (the block, the same season of control years, the year outside the
season) are rows as well, and all bootstrap pairs come from one table of draws. Nothing passes
the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from . import scoring
from .series import date_runs

BLOCK, CONTROLS, OUTSIDE = "block", "controls", "outside"


@dataclass(frozen=True)
class SuspectColumns:
    """Names of a frame's columns: a row a half hour, of forecast and outturn."""

    date: str = "settlement_date"
    period: str = "settlement_period"
    forecast: str = "forecast"
    actual: str = "actual"
    capacity: str = "capacity"
    suspect: str = "suspect"


def with_errors(frame: DataFrame, columns: SuspectColumns) -> DataFrame:
    """The rows with forecast and outturn, with ``error``, ``abs_error``, ``error_share`` and ``abs_share``."""
    c = columns
    out = frame.withColumns(rules.errors(F.col(c.forecast), F.col(c.actual), F.col(c.capacity)))
    return out.withColumn("abs_share", F.abs("error_share")).dropna(subset=[c.forecast, c.actual, "abs_share"])


def longest_block(frame: DataFrame, columns: SuspectColumns, year: int) -> DataFrame:
    """``first_day``, ``last_day`` and ``n_days`` of the longest run of suspect days of a year, the first of equal ones; no row without one."""
    c = columns
    days = frame.filter((F.year(c.date) == year) & F.col(c.suspect)).select(F.col(c.date).cast("date").alias("_day"))
    runs = date_runs(days, "_day")
    best = runs.agg(F.max_by(F.struct("first_day", "last_day", "n_days"), F.struct("n_days", -F.unix_date("first_day"))).alias("b"))
    return best.filter("b is not null").select("b.*")


def starts_agree(frame: DataFrame, columns: SuspectColumns, year: int, one: str, other: str) -> DataFrame:
    """Whether two sources name the same start for each row; and rows, rows dropped for a missing value, and the block."""
    c = columns
    gone = F.col(c.forecast).isNull() | F.col(c.actual).isNull() | (F.coalesce(F.col(c.capacity), F.lit(0)) <= 0)
    counts = frame.agg(F.count("*").alias("rows"), F.count_if(F.col(one) == F.col(other)).alias("starts_agree"), F.count_if(gone).alias("dropped"))
    return counts.join(F.broadcast(longest_block(with_errors(frame, c), c, year)), how="left")


def in_windows(frame: DataFrame, columns: SuspectColumns, year: int, controls: list[int]) -> DataFrame:
    """The rows with errors that lie in a window, with its name in ``window``: the block's season of its year and of each
    control year (``control <year>``), and days of the year outside the season that are not suspect."""
    c = columns
    rows = with_errors(frame, c)
    season = lambda d: F.month(d) * 100 + F.day(d)
    rows = rows.crossJoin(F.broadcast(longest_block(rows, c, year)))
    same = season(F.col(c.date)).between(season(F.col("first_day")), season(F.col("last_day")))
    own = F.year(c.date) == year
    name = F.when(same & own, BLOCK).when(same & F.year(c.date).isin(controls), F.concat(F.lit("control "), F.year(c.date).cast("string"))).when(own & ~F.col(c.suspect), OUTSIDE)
    return rows.withColumn("window", name).filter("window is not null").drop("first_day", "last_day", "n_days")


def block_windows(frame: DataFrame, columns: SuspectColumns, year: int, controls: list[int], early: int = 16, late: int = 33) -> DataFrame:
    """Errors of each window, as shares of capacity: days, periods, MAE, RMSE, bias, correlation, and growth over the day."""
    c = columns
    rows = in_windows(frame, c, year, controls)
    part = lambda when: F.avg(F.when(when, F.col("abs_share")))
    out = rows.groupBy("window").agg(
        F.countDistinct(c.date).alias("days"), F.count("*").alias("periods"), F.avg("abs_share").alias("mae"), F.sqrt(F.avg(F.col("error_share") * F.col("error_share"))).alias("rmse"),
        F.avg("error_share").alias("bias"), scoring.correlation(c.forecast, c.actual).alias("corr"), part(F.col(c.period) <= early).alias("mae_early"), part(F.col(c.period) >= late).alias("mae_late"),
    )
    return out.withColumn("growth", F.when(F.col("mae_early") > 0, F.col("mae_late") / F.col("mae_early")))


def bootstrap_groups(days: DataFrame, group: str, date: str, value: str, seeds: dict[str, int], replicates: int, block: int) -> DataFrame:
    """Mean of circular blocks of each group's days: ``group``, ``rep``, ``mean``; all groups in one table of draws.

    ``days`` has one row a group and date; a group's draws depend on its seed only.
    """
    w = Window.partitionBy(group).orderBy(date)
    pre = days.select(group, F.row_number().over(w).cast("long").alias("i"), F.count("*").over(Window.partitionBy(group)).alias("n"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("s"))
    n = pre.filter("i = n").select(group, "n", F.col("s").alias("all"))
    pre = pre.select(group, "i", "s").unionByName(n.select(group, F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s")))
    seed = F.create_map(*(F.lit(x) for kv in seeds.items() for x in kv))[F.col(group)]
    blocks = n.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)))
    draws = blocks.crossJoin(days.sparkSession.range(replicates).select(F.col("id").alias("rep")))
    start = F.pmod(F.pmod(F.col("rep") * scoring.A + F.col("blk") * scoring.B + seed * scoring.C, F.lit(scoring.P)), F.col("n"))
    draws = draws.withColumn("a", start).withColumn("e", F.col("a") + F.least(F.lit(block).cast("long"), F.col("n") - F.col("blk") * block))
    draws = draws.withColumn("m", F.when(F.col("e") > F.col("n"), F.col("e") - F.col("n")).otherwise(F.col("e")))
    j = draws.join(pre.select(group, F.col("i").alias("a"), F.col("s").alias("sa")), [group, "a"]).join(pre.select(group, F.col("i").alias("m"), F.col("s").alias("sm")), [group, "m"])
    wrapped = F.when(F.col("e") > F.col("n"), F.col("all")).otherwise(0.0)
    return j.groupBy(group, "rep").agg((F.sum(F.col("sm") - F.col("sa") + wrapped) / F.first("n")).alias("mean"))


def block_ratios(frame: DataFrame, columns: SuspectColumns, year: int, controls: list[int], replicates: int = 10_000, block: int = 7) -> DataFrame:
    """Ratio of mean daily errors with its interval: the block to all controls, with a verdict, and the first control to the second.

    One row a pair: ``pair``, ``ratio``, ``lo``, ``hi``, ``verdict`` (of the first pair). A pair
    whose windows have no rows is left out.
    """
    c = columns
    names = [f"control {y}" for y in controls]
    rows = in_windows(frame, c, year, controls).filter(F.col("window") != OUTSIDE)
    daily = rows.groupBy("window", F.col(c.date).alias("day")).agg(F.avg("abs_share").alias("mae"))
    both = F.when(F.col("window") == BLOCK, F.array("window")).otherwise(F.array("window", F.lit(CONTROLS)))
    daily = daily.withColumn("sample", F.explode(both)).drop("window")
    pairs = [(BLOCK, CONTROLS)] + [tuple(names[:2])] * (len(names) > 1)
    seeds = {s: i + 1 for i, s in enumerate([BLOCK, CONTROLS, *names])}
    reps = bootstrap_groups(daily, "sample", "day", "mae", seeds, replicates, block)
    at = lambda df, by, v: df.groupBy(*by).agg(*(F.max(F.when(F.col("sample") == s, F.col(v))).alias(s) for s in seeds))
    ratio = lambda: F.inline(F.array(*(F.struct(F.lit(f"{a} / {b}").alias("pair"), F.try_divide(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("ratio")) for a, b in pairs)))
    drawn = at(reps, ["rep"], "mean").select(ratio()).filter("ratio is not null")
    bounds = drawn.groupBy("pair").agg(F.percentile("ratio", F.lit(0.025)).alias("lo"), F.percentile("ratio", F.lit(0.975)).alias("hi"))
    seen = at(daily.groupBy("sample").agg(F.avg("mae").alias("mean")), [], "mean").select(ratio())
    judged = F.when(F.col("pair") == f"{BLOCK} / {CONTROLS}", scoring.verdict(F.col("lo"), F.col("hi")))
    return seen.join(bounds, "pair").select("pair", "ratio", "lo", "hi", judged.alias("verdict"))


def shared_days(one: DataFrame, other: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Both tables' rows of the days that both have."""
    days = one.select(date).distinct().join(other.select(date).distinct(), date, "left_semi")
    return one.join(days, date, "left_semi"), other.join(days, date, "left_semi")


def only_the_first(one: DataFrame, other: DataFrame, date: str) -> DataFrame:
    """Whether ``one`` has, beyond the days of ``other``, exactly one: its own first; and how many days it has beyond."""
    extra = one.select(date).distinct().join(other.select(date).distinct(), date, "left_anti").agg(F.count("*").alias("extra_days"), F.min(date).alias("_e"))
    first = one.agg(F.min(date).alias("_f"))
    return extra.crossJoin(F.broadcast(first)).select("extra_days", ((F.col("extra_days") == 1) & F.coalesce(F.col("_e") == F.col("_f"), F.lit(False))).alias("only_the_first"))
