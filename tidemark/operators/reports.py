"""Report tables over feeds: one pass each, as (check, value) rows or small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, rules
from . import scoring, series
from .quantiles import exact_quantiles, with_quantiles


def as_checks(one_row: DataFrame) -> DataFrame:
    """The columns of a one-row table as (check, value) rows of doubles."""
    return one_row.select(*(F.col(c).cast("double").alias(c) for c in one_row.columns)).unpivot([], one_row.columns, "check", "value")


def provider_quality(wide: DataFrame, prices: dict[str, str]) -> DataFrame:
    """Missing, negative, least, greatest and mean of each price column, and its share of volume in percent."""
    total = sum((F.coalesce(F.sum(v), F.lit(0.0)) for v in prices.values()), F.lit(0.0))
    aggs = []
    for p, v in prices.items():
        aggs += [F.count_if(F.col(p).isNull()).alias(f"{p}_missing"), F.count_if(F.col(p) < 0).alias(f"{p}_negative"), F.min(p).alias(f"{p}_min"), F.max(p).alias(f"{p}_max"), F.avg(p).alias(f"{p}_mean"), (100 * F.try_divide(F.sum(v), total)).alias(f"{p}_volume_share")]
    return as_checks(wide.agg(F.count("*").alias("rows"), *aggs))


def compare_providers(wide: DataFrame, a: str, b: str, volumes: dict[str, str], large: float = 5.0) -> DataFrame:
    """Agreement of two providers' prices, and the level of each one's prices and volumes."""
    d = F.col(a) - F.col(b)
    levels = {"d": d, "abs_d": F.abs(d)} | {c: F.col(c) for pair in volumes.items() for c in pair}
    asked = {"median_diff": ("d", 0.5), "p95_abs_diff": ("abs_d", 0.95)} | {f"{c}_median": (c, 0.5) for pair in volumes.items() for c in pair}
    own = []
    for p, v in volumes.items():
        own += [F.avg(p).alias(f"{p}_mean"), F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max"), F.sum(v).alias(f"{v}_total")]
    one = wide.agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.count(d).alias("n_both"), F.corr(a, b).alias("corr"), F.avg(d).alias("mean_diff"),
        F.avg(F.abs(d)).alias("mean_abs_diff"), F.count_if(F.abs(d) > large).alias("n_large"), *own,
    )
    return as_checks(with_quantiles(one, exact_quantiles(wide, levels, asked)))


def outturn_quality(wide: DataFrame, by: list[str], time: str, fuels: list[str], moved: str, start: str, steady: str) -> DataFrame:
    """Missing values of each fuel, moved rows, how many own start times are the row's ``time``, and the
    mean jump of the ``steady`` column into, out of and outside moved rows: alike where the move was right."""
    m = F.coalesce(F.col(moved), F.lit(False))
    return as_checks(
        series.jumps(wide, by, time, steady).agg(
            F.count("*").alias("rows"), F.count_if(m).alias("moved"), F.count(start).alias("starts"), F.count_if(F.col(start) == F.col(time)).alias("starts_agree"),
            *(F.count_if(F.col(f).isNull()).alias(f"{f}_missing") for f in fuels),
            F.avg(F.when(m, F.col("jump_in"))).alias("jump_into_moved"), F.avg(F.when(m, F.col("jump_out"))).alias("jump_out_of_moved"), F.avg(F.when(~m, F.col("jump_in"))).alias("jump_elsewhere"),
        )
    )


def liquidity_audit(df: DataFrame, price: str, volume: str, threshold: float = rules.LIQUIDITY_THRESHOLD) -> DataFrame:
    p, v = F.col(price), F.col(volume)
    zero = F.abs(p) <= rules.ZERO_TOLERANCE
    return as_checks(
        df.agg(
            F.count("*").alias("rows"), F.count_if(zero).alias("zero_prices"), F.count_if(rules.defaulted(p, v, threshold)).alias("defaulted"), F.count_if(zero & (v >= threshold)).alias("traded_zeros"),
            F.count_if(zero & v.isNull()).alias("zero_without_volume"), F.count_if(rules.liquidity_anomaly(p, v, threshold)).alias("anomalies"),
        )
    )


def affected_days(df: DataFrame, date: Column, price: str, volume: str, threshold: float = rules.LIQUIDITY_THRESHOLD, most: int = 10) -> DataFrame:
    """Days with most default prices, ``most`` of them."""
    d = df.groupBy(date.alias("day")).agg(F.count_if(rules.defaulted(F.col(price), F.col(volume), threshold)).alias("n_defaulted"))
    return d.filter("n_defaulted > 0").orderBy(F.desc("n_defaulted"), "day").limit(most)


def timeliness(vintages: DataFrame, target: str, recorded: str, day_start: Column) -> DataFrame:
    """By target year: rows, late or missing publications, median and least lead in hours."""
    lead = (F.unix_timestamp(day_start) - F.unix_timestamp(recorded)) / 3600
    ok = F.coalesce(F.col(recorded) < day_start, F.lit(False))
    rows = vintages.select(F.year(target).alias("year"), ok.alias("ok"), F.when(ok, lead).alias("lead"))
    one = rows.groupBy("year").agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("late_or_missing"), F.min("lead").alias("min_lead"))
    return with_quantiles(one, exact_quantiles(rows, {"lead": F.col("lead")}, {"median_lead": ("lead", 0.5)}, ["year"]), ["year"])


def timezone_evidence(df: DataFrame, stamp: str, zone: str = clock.ZONE) -> DataFrame:
    """Median clock hour in winter and summer if stamps are UTC, and if they are local: the right reading does not move."""
    t = clock.instant(stamp)
    hour = lambda x: F.hour(x) + F.minute(x) / 60
    winter, summer = F.month(t).isin(12, 1, 2), F.month(t).isin(6, 7, 8)
    read = {"as_utc": hour(clock.local(t, zone)), "as_local": hour(t)}
    cells = {f"{k}_{n}": F.when(s, h) for k, h in read.items() for n, s in (("winter", winter), ("summer", summer))}
    return exact_quantiles(df, cells, {c: (c, 0.5) for c in cells})


def coverage(df: DataFrame, date: str, zone: str = clock.ZONE) -> DataFrame:
    """How many days have how many rows, beside the number they should have."""
    d = df.groupBy(date).agg(F.count("*").alias("n"))
    return d.groupBy("n", clock.expected_periods(F.col(date), zone).alias("expected")).agg(F.count("*").alias("days"))


def lead_summary(vintages: DataFrame, source: str, target: str, published: str, suspect: str) -> DataFrame:
    """Rows, least, median and largest lead in hours, and suspect rows of each source."""
    lead = (F.unix_timestamp(target) - F.unix_timestamp(published)) / 3600
    one = vintages.groupBy(source).agg(F.count("*").alias("rows"), F.min(lead).alias("min_lead"), F.max(lead).alias("max_lead"), F.count_if(suspect).alias("suspect"))
    return with_quantiles(one, exact_quantiles(vintages, {"lead": lead}, {"median_lead": ("lead", 0.5)}, [source]), [source])


def daily_range(df: DataFrame, time: str, price: str, zone: str = clock.ZONE) -> DataFrame:
    d = df.groupBy(clock.local_date(F.col(time), zone).alias("day")).agg((F.max(price) - F.min(price)).alias("range")).filter("range is not null")
    return d.agg(F.avg("range").alias("mean_range"), F.percentile("range", F.lit(0.5)).alias("median_range"), F.max_by("day", F.struct("range", "day")).alias("widest_day"), F.min_by("day", F.struct("range", "day")).alias("narrowest_day"))


def monthly(daily: DataFrame, date: str, by: list[str], columns: list[str]) -> DataFrame:
    return daily.groupBy(*by, F.trunc(date, "MM").alias("month")).agg(*(F.sum(c).alias(c) for c in columns))


def strategy_rollup(daily: DataFrame, date: str, strategies: list[str]) -> DataFrame:
    """Revenue of each strategy by year and overall (a null year)."""
    long = daily.unpivot([date], strategies, "strategy", "revenue").withColumn("year", F.year(date))
    by_year = long.groupBy("strategy", "year").agg(F.sum("revenue").alias("revenue"), F.count("revenue").alias("days"))
    total = by_year.groupBy("strategy").agg(F.sum("revenue").alias("revenue"), F.sum("days").alias("days"))
    return by_year.unionByName(total.withColumn("year", F.lit(None).cast("int")))


def strategy_table(daily: DataFrame, date: str, strategies: list[str], perfect: str, *, power: float = 1.0, energy: float = 1.0, replicates: int = 2000, block: int = 7) -> DataFrame:
    """One row a strategy, from ``<strategy>_net`` and ``<strategy>_mwh`` of each day: revenue a MW and
    year, cycles a year, days with a loss, and the share of perfect foresight with its interval.

    One draw of blocks serves all strategies. The interval of ``perfect`` itself is null.
    """
    names = [perfect, *strategies]
    reps = scoring.bootstrap_sums(daily, date, [f"{s}_net" for s in names], replicates, block)
    share = reps.select(*(F.try_divide(f"{s}_net", f"{perfect}_net").alias(s) for s in strategies)).unpivot([], strategies, "strategy", "share")
    bounds = share.groupBy("strategy").agg(F.percentile("share", F.lit(0.025)).alias("ci_low"), F.percentile("share", F.lit(0.975)).alias("ci_high"))
    parts = [F.struct(F.lit(s).alias("strategy"), F.col(f"{s}_net").alias("net"), F.col(f"{s}_mwh").alias("mwh"), F.col(f"{perfect}_net").alias("best")) for s in names]
    years = F.count("*") / 365.25
    out = daily.select(F.inline(F.array(*parts))).groupBy("strategy").agg(
        F.count("*").alias("days"),
        (F.sum("net") / power / years).alias("per_mw_year"),
        (F.sum("mwh") / energy / years).alias("cycles_year"),
        F.count_if(F.col("net") < -1e-6).alias("loss_days"),
        F.try_divide(F.sum("net"), F.sum("best")).alias("capture"),
    )
    return out.join(bounds, "strategy", "left")


def scenario_pivot(summary: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    return summary.groupBy(row).pivot(column, values).agg(F.first(value))


def describe_table(df: DataFrame) -> DataFrame:
    """Columns with type, number of rows and of nulls, and their least and greatest value as text."""
    one = df.agg(F.count("*").alias("_rows"), *(F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")).alias(c) for c in df.columns))
    kinds = F.create_map(*(F.lit(x) for kv in df.dtypes for x in kv))
    out = one.unpivot(["_rows"], df.columns, "column", "x")
    return out.select("column", kinds[F.col("column")].alias("type"), F.col("_rows").alias("rows"), "x.nulls", "x.least", "x.greatest")
