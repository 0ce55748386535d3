"""Local-clock calendars as column expressions.

A day of a zone with daylight saving has 46, 48 or 50 half hours. All conversions go through
UTC instants; labels (date, period) follow from the instant and are never the key of a series.
The session time zone is UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.contracts import assert_none

ZONE = "Europe/London"
STEP_MINUTES = 30


def instant(c: Column | str) -> Column:
    """A timestamp column as an instant; a zoneless one is read as UTC."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")


def plain(c: Column | str) -> Column:
    """An instant as the zoneless UTC timestamp that tables hold."""
    return instant(c).cast("timestamp_ntz")


def lenient(c: Column, zone: str | None = None) -> Column:
    """The instant of a written time, null where it is none; one without a zone of its own is read in ``zone``, or as UTC."""
    t = F.try_to_timestamp(c)
    return t if zone is None else F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.to_utc_timestamp(t, zone))


def local(c: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(instant(c), zone)


def local_date(c: Column, zone: str = ZONE) -> Column:
    return F.to_date(local(c, zone))


def day_start(date: Column, zone: str = ZONE) -> Column:
    """UTC instant of a day's local midnight."""
    return F.to_utc_timestamp(date.cast("timestamp"), zone)


def at_local(date: Column, minute: int, zone: str = ZONE) -> Column:
    """UTC instant of a local clock time of a date."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(date.cast("timestamp")) + minute * 60), zone)


def exists_locally(local_time: Column, zone: str = ZONE) -> Column:
    """False for a local time that the spring change skips."""
    return F.from_utc_timestamp(F.to_utc_timestamp(local_time, zone), zone) == local_time


def expected_periods(date: Column, zone: str = ZONE, step: int = STEP_MINUTES) -> Column:
    """Half hours of a local day."""
    seconds = F.unix_timestamp(day_start(F.date_add(date, 1), zone)) - F.unix_timestamp(day_start(date, zone))
    return (seconds / (step * 60)).cast("int")


def period(c: Column, zone: str = ZONE, step: int = STEP_MINUTES) -> Column:
    """1-based number of the half hour within its local day."""
    elapsed = F.unix_timestamp(instant(c)) - F.unix_timestamp(day_start(local_date(c, zone), zone))
    return (F.floor(elapsed / (step * 60)) + 1).cast("int")


def from_label(date: Column, number: Column, zone: str = ZONE, step: int = STEP_MINUTES) -> Column:
    """UTC start of a (date, period); null where the day has no such period."""
    start = F.timestamp_seconds(F.unix_timestamp(day_start(date, zone)) + (number - 1) * step * 60)
    return F.when((number >= 1) & (number <= expected_periods(date, zone, step)), start)


def minute_of_day(c: Column, zone: str = ZONE) -> Column:
    t = local(c, zone)
    return (F.hour(t) * 60 + F.minute(t)).cast("int")


def _offset(t: Column, zone: str) -> Column:
    """Seconds that the zone's clock is ahead of UTC at an instant."""
    return F.unix_timestamp(F.from_utc_timestamp(t, zone)) - F.unix_timestamp(t)


def first_pass(c: Column, zone: str = ZONE) -> Column:
    """Whether an instant is the first of its local date and clock time: the autumn change repeats some.

    A change within the three hours before that set the clock back by some time repeats that time:
    the same clock stood as far ahead of UTC as before the change, once already. Changes of any
    length up to three hours count, as those of half an hour; no row needs another.
    """
    t = instant(c)
    back = _offset(F.timestamp_seconds(F.unix_timestamp(t) - 3 * 3600), zone) - _offset(t, zone)
    before = _offset(F.timestamp_seconds(F.unix_timestamp(t) - back), zone)
    return ~((back > 0) & (before == _offset(t, zone) + back))


def grid(spark: SparkSession, start: str, end: str, zone: str = ZONE, step: int = STEP_MINUTES) -> DataFrame:
    """Every half hour of the local dates start to end: ``target_time``, ``settlement_date``, ``settlement_period``."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("settlement_date"))
    return grid_of(days, zone, step)


def grid_of(days: DataFrame, zone: str = ZONE, step: int = STEP_MINUTES) -> DataFrame:
    """The half hours of the dates in ``settlement_date``."""
    d = F.col("settlement_date")
    n = F.posexplode(F.sequence(F.lit(1), expected_periods(d, zone, step)))
    rows = days.select("settlement_date", n.alias("_p", "settlement_period"))
    return rows.select(from_label(d, F.col("settlement_period"), zone, step).alias("target_time"), "settlement_date", "settlement_period")


def decision_table(periods: DataFrame, decision_minute: int = 11 * 60, lead_days: int = 1, zone: str = ZONE) -> DataFrame:
    """Adds each row's decision instant: a fixed local clock time some days before its date."""
    return periods.withColumn("decision_time", at_local(F.date_sub("settlement_date", lead_days), decision_minute, zone))


def assert_decided_before(rows: DataFrame, date: str = "settlement_date", decision: str = "decision_time", zone: str = ZONE) -> DataFrame:
    """Refuses decisions that are not before the first half hour of their day."""
    return assert_none(rows, F.col(decision) >= day_start(F.col(date), zone), "decided after the day began")


def assert_aligned(rows: DataFrame, time: str, step: int = STEP_MINUTES) -> DataFrame:
    """Refuses instants that do not begin a period, whose label would be that of another instant."""
    t = instant(time)
    return assert_none(rows, (F.unix_micros(t) % (step * 60_000_000)) != 0, f"{time} lies between periods")


def calendar_table(periods: DataFrame, zone: str = ZONE) -> DataFrame:
    """Local-clock keys of each half hour."""
    t = F.col("target_time")
    return periods.select(
        "target_time",
        local_date(t, zone).alias("local_date"),
        minute_of_day(t, zone).alias("minute_of_day"),
        F.weekday(local(t, zone)).alias("day_of_week"),
        F.month(local(t, zone)).alias("month"),
        first_pass(t, zone).alias("first_occurrence"),
    )


def first_occurrence(periods: DataFrame, keys: list[str], time: str) -> Column:
    """First row of its keys by time, for calendars of other steps than whole parts of an hour."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(time)) == 1


def scheduled_publication(date: Column, minute: int, lead_days: int, zone: str = ZONE) -> Column:
    """Instant at which a feed for a date is due: a local clock time some days before."""
    return at_local(F.date_sub(date, lead_days), minute, zone)


def resolve_publication(recorded: Column, date: Column, minute: int, lead_days: int, zone: str = ZONE) -> dict[str, Column]:
    """The recorded publication instant if strictly before the day starts, else the scheduled one.

    Columns ``published_at``, ``published_at_source`` (archive or schedule), ``published_at_suspect``.
    """
    good = F.coalesce(recorded < day_start(date, zone), F.lit(False))
    return {
        "published_at": F.when(good, recorded).otherwise(scheduled_publication(date, minute, lead_days, zone)),
        "published_at_source": F.when(good, "archive").otherwise("schedule"),
        "published_at_suspect": ~good,
    }
