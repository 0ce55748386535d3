"""Gaps, frozen runs and short fills of regular series, and the whole cleaning pass.

All rules look a bounded number of steps around a row, so a long series is cut into chunks of
time with a halo of neighbouring rows on each side: windows partition by series and chunk, and no
series has to fit one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock, rules
from .contracts import holding, require_columns
from .quantiles import join_groups

CHUNK_DAYS = 32


def latest_revision(df: DataFrame, keys: list[str], revised: str) -> DataFrame:
    """The row of each key that was revised last; equal times are decided by the whole row."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(revised, *[c for c in rest if c != revised])).alias("_x"))
    return best.select(*keys, "_x.*")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*keys, "_x.*")


def regular_grid(df: DataFrame, series: list[str], time: str, step: int = 1800) -> DataFrame:
    """Every step from a series' first to its last instant, with the rows that exist; missing ones are explicit.

    The job fails at a reading between two steps, which would have no place, and at one without a time.
    """
    t = F.unix_timestamp(clock.instant(time))
    ends = df.groupBy(*series).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    steps = ends.select(*series, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias("_t"))
    rows = df.withColumn("_t", t).drop(time)
    out = holding(steps.withColumn("_step", F.lit(True)).join(rows, [*series, "_t"], "full"), F.col("_step").isNull(), f"readings lie between the steps of {step} seconds")
    return out.withColumn(time, F.timestamp_seconds("_t")).drop("_t", "_step").select(*series, time, *[c for c in df.columns if c not in series and c != time])


def with_halo(df: DataFrame, time: str, halo_seconds: int, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Adds ``_chunk``, with rows near a chunk's ends repeated in the neighbour, and ``_core``, true once a row."""
    size = chunk_days * 86400
    t = F.unix_timestamp(clock.instant(time))
    own = F.floor(t / size)
    chunks = F.array_distinct(F.array(F.floor((t - halo_seconds) / size), own, F.floor((t + halo_seconds) / size)))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(chunks)).withColumn("_core", F.col("_chunk") == F.col("_own")).drop("_own")


def core(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_chunk")


def _run_size(part: list[str], time: str, changed: Column, df: DataFrame, name: str) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(time)
    df = df.withColumn("_run", F.sum(F.when(changed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*part, "_run"))).drop("_run")


def stuck_runs(df: DataFrame, series: list[str], time: str, value: str, min_run: int = 6, step: int = 1800, name: str = "stuck") -> DataFrame:
    """Marks values of runs of at least ``min_run`` equal readings; a null belongs to no run."""
    d = with_halo(df, time, min_run * step)
    w = Window.partitionBy(*series, "_chunk").orderBy(time)
    d = d.withColumn("_ch", F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)))
    d = _run_size([*series, "_chunk"], time, F.col("_ch"), d, "_n")
    return core(d.withColumn(name, F.col(value).isNotNull() & (F.col("_n") >= min_run)).drop("_ch", "_n"))


def zero_runs(df: DataFrame, series: list[str], time: str, value: str, min_run: int = 12, step: int = 1800, name: str = "zero_run") -> DataFrame:
    """Marks zeros of runs of at least ``min_run``: a feed that writes absence as zero."""
    d = with_halo(df, time, min_run * step).withColumn("_z", F.coalesce(F.col(value) == 0, F.lit(False)))
    w = Window.partitionBy(*series, "_chunk").orderBy(time)
    d = d.withColumn("_ch", F.coalesce(F.lag("_z").over(w) != F.col("_z"), F.lit(True)))
    d = _run_size([*series, "_chunk"], time, F.col("_ch"), d, "_n")
    return core(d.withColumn(name, F.col("_z") & (F.col("_n") >= min_run)).drop("_z", "_ch", "_n"))


def run_lengths(df: DataFrame, series: list[str], time: str, state: Column, name: str = "run", chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Length of the run of equal states (null equal to null) that each row belongs to, however long.

    Runs are found chunk by chunk. Only a chunk's first and last run can go on beyond it: these, two
    rows a chunk at most, are put together in the order of the chunks, and what they come to is
    joined back. No window holds the rows of a series.
    """
    where = [*series, "_chunk"]
    t = F.unix_timestamp(clock.instant(time))
    d = df.withColumn("_chunk", F.floor(t / (chunk_days * 86400))).withColumn("_state", F.struct(state.alias("v")))
    w = Window.partitionBy(*where).orderBy(time)
    new = ~F.coalesce(F.lag("_state").over(w).eqNullSafe(F.col("_state")), F.lit(False))
    d = d.withColumn("_new", new).withColumn("_run", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = d.groupBy(*where, "_run").agg(F.first("_state").alias("_state"), F.count("*").alias("_n"))
    ends = runs.withColumn("_last", F.max("_run").over(Window.partitionBy(*where))).filter("_run = 1 or _run = _last")
    c = Window.partitionBy(*series).orderBy("_chunk", "_run")
    goes_on = F.coalesce(F.lag("_state").over(c).eqNullSafe(F.col("_state")) & (F.lag("_chunk").over(c) != F.col("_chunk")), F.lit(False))
    ends = ends.withColumn("_on", goes_on).withColumn("_whole", F.count_if(~F.col("_on")).over(c.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("_total", F.sum("_n").over(Window.partitionBy(*series, "_whole"))).select(*where, "_run", "_total")
    out = join_groups(d, ends, [*where, "_run"], "left")
    own = F.count("*").over(Window.partitionBy(*where, "_run"))
    return out.withColumn(name, F.coalesce("_total", own)).drop("_chunk", "_state", "_new", "_run", "_total")


def gap_lengths(df: DataFrame, series: list[str], time: str, value: str, name: str = "gap") -> DataFrame:
    """Length of the run of nulls a row belongs to, 0 where a value is present; runs may be of any length."""
    d = run_lengths(df, series, time, F.col(value).isNull(), name)
    return d.withColumn(name, F.when(F.col(value).isNull(), F.col(name)).otherwise(0))


def fill_short_gaps(df: DataFrame, series: list[str], time: str, value: str, max_gap: int = 2, step: int = 1800) -> DataFrame:
    """Linear interpolation in time of null runs of at most ``max_gap``, never beyond the ends; ``<value>_interpolated`` marks them."""
    d = with_halo(df, time, (max_gap + 1) * step)
    point = F.when(F.col(value).isNotNull(), F.struct(F.unix_timestamp(clock.instant(time)).alias("t"), F.col(value).alias("x")))
    part = Window.partitionBy(*series, "_chunk")
    a = F.last(point, ignorenulls=True).over(part.orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    b = F.last(point, ignorenulls=True).over(part.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_a", a).withColumn("_b", b)
    t = F.unix_timestamp(clock.instant(time))
    short = F.col(value).isNull() & F.coalesce((F.col("_b.t") - F.col("_a.t")) / step - 1 <= max_gap, F.lit(False))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (t - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    d = d.withColumn(f"{value}_interpolated", short).withColumn(value, F.when(short, line).otherwise(F.col(value)))
    return core(d.drop("_a", "_b"))


def longest_run(df: DataFrame, series: list[str], time: str, value: str) -> DataFrame:
    """Length of the longest run of equal values of each series; nulls do not end a run."""
    d = run_lengths(df.filter(F.col(value).isNotNull()), series, time, F.col(value), "n")
    return d.groupBy(*series).agg(F.max("n").alias("longest_run"))


def _islands(d: DataFrame, date: str, part: list[str]) -> DataFrame:
    """Runs of successive days within windows by ``part``: first and last day."""
    day = F.date_sub(date, F.row_number().over(Window.partitionBy(*part).orderBy(date)))
    return d.withColumn("_g", day).groupBy(*part, "_g").agg(F.min(date).alias("first_day"), F.max(date).alias("last_day")).drop("_g")


def date_runs(df: DataFrame, date: str, series: list[str] | None = None, chunk_days: int = 366) -> DataFrame:
    """Runs of successive dates: first and last day and length.

    Runs are found within chunks of days. Those that touch a chunk's end, two a chunk at most, are
    put together afterwards.
    """
    series = series or []
    number = lambda c: F.unix_date(c)
    d = df.select(*series, date).filter(F.col(date).isNotNull()).distinct().withColumn("_chunk", F.floor(number(date) / chunk_days))
    runs = _islands(d, date, [*series, "_chunk"])
    edge = (F.pmod(number("first_day"), F.lit(chunk_days)) == 0) | (F.pmod(number("last_day") + 1, F.lit(chunk_days)) == 0)
    w = Window.partitionBy(*series).orderBy("first_day")
    joins = F.coalesce(F.date_add(F.lag("last_day").over(w), 1) == F.col("first_day"), F.lit(False))
    ends = runs.filter(edge).withColumn("_on", joins).withColumn("_g", F.count_if(~F.col("_on")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.groupBy(*series, "_g").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")).drop("_g")
    out = runs.filter(~edge).select(*series, "first_day", "last_day").unionByName(ends)
    return out.withColumn("n_days", (F.datediff("last_day", "first_day") + 1).cast("long"))


def jumps(df: DataFrame, series: list[str], time: str, value: str, step: int = 1800) -> DataFrame:
    """Absolute change into and out of each row of a grid, from the step before and to the step after."""
    d = with_halo(df, time, step)
    w = Window.partitionBy(*series, "_chunk").orderBy(time)
    x = F.col(value)
    return core(d.withColumn("jump_in", F.abs(x - F.lag(value).over(w))).withColumn("jump_out", F.abs(F.lead(value).over(w) - x)))


def rolling_mean(df: DataFrame, series: list[str], date: str, value: str, rows: int = 7, least: int = 3, name: str = "rolling_mean") -> DataFrame:
    w = Window.partitionBy(*series).orderBy(date).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def trailing_days(df: DataFrame, series: list[str], date: str, value: str, first: int, last: int, name: str = "trailing_mean") -> DataFrame:
    """Mean over the calendar days ``first`` to ``last`` before each row's date, whichever of them have rows."""
    w = Window.partitionBy(*series).orderBy(F.unix_date(date)).rangeBetween(-first, -last)
    return df.withColumn(name, F.avg(value).over(w))


def cumulative(df: DataFrame, series: list[str], date: str, value: str, name: str = "cumulative", chunk_days: int = 366) -> DataFrame:
    """Running sum over a series' dates: within chunks of days, with what earlier chunks come to added."""
    where = [*series, "_chunk"]
    d = df.withColumn("_chunk", F.floor(F.unix_date(F.to_date(date)) / chunk_days))
    sums = d.groupBy(*where).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    own = F.sum(value).over(Window.partitionBy(*where).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = join_groups(d.withColumn(name, own), sums, where, "left")
    both = F.coalesce(F.col(name) + F.col("_before"), F.col(name), F.col("_before"))
    return out.withColumn(name, both).drop("_chunk", "_before")


@dataclass(frozen=True)
class CleaningPolicy:
    """Options of the cleaning pass; ``volumes`` maps a price column to its volume column."""

    prices: list[str] = field(default_factory=lambda: ["price"])
    volumes: dict[str, str] = field(default_factory=dict)
    bounds: tuple[float, float] = (-500.0, 6000.0)
    stuck_run: int = 6
    zero_run: int = 12
    max_gap: int = 2
    liquidity: float = rules.LIQUIDITY_THRESHOLD
    zone: str = clock.ZONE
    step: int = 1800


def clean_series(df: DataFrame, series: list[str], time: str, policy: CleaningPolicy) -> DataFrame:
    """Duplicates, grid, default prices, band, frozen runs, short fills and usability; judged, never deleted.

    A reading between the grid's steps has no place in it: the job fails there.

    Adds for every price column ``_defaulted``, ``_liquidity_anomaly``, ``_out_of_band``,
    ``_stuck``, ``_interpolated``; and ``settlement_date``, ``settlement_period``,
    ``period_usable`` and ``day_complete``, ``day_usable`` by the first price column. Band and
    runs are judged before filling, usability after it.
    """
    dup = [time, *series]
    df = keep_first(df, dup, sorted(c for c in df.columns if c not in dup))
    out = regular_grid(df, series, time, policy.step)
    out = out.withColumn("settlement_date", clock.local_date(F.col(time), policy.zone)).withColumn("settlement_period", clock.period(F.col(time), policy.zone))
    for p in policy.prices:
        raw = F.col(p)
        v = policy.volumes.get(p)
        if v is not None:
            require_columns(df, [v], f"the volume of {p}")
            out = out.withColumn(f"{p}_defaulted", rules.defaulted(raw, F.col(v), policy.liquidity))
            out = out.withColumn(f"{p}_liquidity_anomaly", rules.liquidity_anomaly(raw, F.col(v), policy.liquidity))
        else:
            out = zero_runs(out, series, time, p, policy.zero_run, policy.step, f"{p}_defaulted").withColumn(f"{p}_liquidity_anomaly", F.lit(False))
        out = out.withColumn(p, F.when(~F.col(f"{p}_defaulted"), raw)).withColumn(f"{p}_out_of_band", rules.out_of_band(raw, *policy.bounds))
        out = stuck_runs(out, series, time, p, policy.stuck_run, policy.step, f"{p}_stuck")
        out = fill_short_gaps(out, series, time, p, policy.max_gap, policy.step)
    main = policy.prices[0]
    out = out.withColumn("period_usable", F.col(main).isNotNull() & ~F.col(f"{main}_out_of_band") & ~F.col(f"{main}_stuck"))
    day = Window.partitionBy(*series, "settlement_date")
    out = out.withColumn("day_complete", F.count("*").over(day) == clock.expected_periods(F.col("settlement_date"), policy.zone))
    return out.withColumn("day_usable", F.col("day_complete") & F.bool_and("period_usable").over(day))


def day_usability(df: DataFrame, series: list[str], date: str = "settlement_date", usable: str = "period_usable", zone: str = clock.ZONE) -> DataFrame:
    """Observed and expected half hours of each day, and whether it is complete and usable."""
    d = df.groupBy(*series, date).agg(F.count("*").alias("observed"), F.bool_and(usable).alias("all_usable"))
    d = d.withColumn("expected", clock.expected_periods(F.col(date), zone)).withColumn("day_complete", F.col("observed") == F.col("expected"))
    return d.withColumn("day_usable", F.col("day_complete") & F.col("all_usable"))


def quality_report(clean: DataFrame, policy: CleaningPolicy, raw: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts of a cleaned table as (check, value) rows, from one pass over it.

    With the raw table and its keys (series and time) also the rows that came in, those that
    repeated a key, and those that the grid added.
    """
    checks: dict[str, Column] = {"rows_out": F.count("*")}
    for p in policy.prices:
        checks |= {f"{p}_missing": F.count_if(F.col(p).isNull())} | {f"{p}_{k}": F.count_if(F.col(f"{p}_{k}")) for k in ("interpolated", "out_of_band", "stuck", "defaulted", "liquidity_anomaly")}
    checks["days_total"] = F.countDistinct("settlement_date")
    checks["days_incomplete"] = F.countDistinct(F.when(~F.col("day_complete"), F.col("settlement_date")))
    checks["days_unusable"] = F.countDistinct(F.when(~F.col("day_usable"), F.col("settlement_date")))
    one = clean.agg(*(x.cast("long").alias(k) for k, x in checks.items()))
    names = list(checks)
    if raw is not None:
        came = raw.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows_in"), F.count("*").alias("_keys"))
        one = one.crossJoin(F.broadcast(came)).withColumns({"duplicates": F.col("rows_in") - F.col("_keys"), "inserted": F.col("rows_out") - F.col("_keys")})
        names += ["rows_in", "duplicates", "inserted"]
    return one.unpivot([], names, "check", "value")
