"""Calendars against the standard library's zones."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.functions import clock
from tidemark.operators.contracts import ContractError, assert_labels, assert_none, assert_unique, one_to_one, require_columns

LONDON, UTC = ZoneInfo("Europe/London"), dt.timezone.utc
CHANGES = [dt.date(2019, 3, 31), dt.date(2021, 10, 31), dt.date(2028, 3, 26)]
DAYS = CHANGES + [d + dt.timedelta(1) for d in CHANGES] + [dt.date(2018, 1, 1) + dt.timedelta(random.Random(4).randint(0, 3000)) for _ in range(4)]


def utc(day, minute=0):
    """UTC instant of a local clock time, without its zone."""
    local = dt.datetime.combine(day, dt.time(minute // 60, minute % 60), LONDON)
    return local.astimezone(UTC).replace(tzinfo=None)


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(d,) for d in sorted(set(DAYS))], "settlement_date date")


def test_grid_has_each_days_half_hours(spark, days):
    rows = clock.grid_of(days).collect()
    for d in set(DAYS):
        start, end = utc(d), utc(d + dt.timedelta(1))
        own = sorted((r["target_time"], r["settlement_period"]) for r in rows if r["settlement_date"] == d)
        assert own == [(start + dt.timedelta(minutes=30 * i), i + 1) for i in range((end - start) // dt.timedelta(minutes=30))]
    day = CHANGES[0].isoformat()
    assert clock.grid(spark, day, day).count() == 46


def test_labels_round_trip(days):
    t = F.col("target_time")
    back = clock.grid_of(days).select("target_time", "settlement_date", "settlement_period", clock.local_date(t).alias("d"), clock.period(t).alias("p"), clock.from_label(clock.local_date(t), clock.period(t)).alias("b"))
    assert back.filter("b <> target_time or p <> settlement_period or d <> settlement_date").count() == 0


def test_impossible_labels_are_null_or_refused(spark):
    df = spark.createDataFrame([(CHANGES[0], 47), (CHANGES[1], 50)], "d date, n int")
    assert {r["n"]: r["x"] is None for r in df.select("n", clock.from_label(F.col("d"), F.col("n")).alias("x")).collect()} == {47: True, 50: False}
    with pytest.raises(SparkRuntimeException, match="impossible period labels"):
        assert_labels(df, "d", "n", clock.ZONE).count()


def test_instants_between_half_hours_are_refused(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 5, 5, 10, 30),), (dt.datetime(2021, 5, 5, 10, 31),)], "t timestamp")
    assert clock.assert_aligned(df.limit(1), "t").count() == 1
    with pytest.raises(SparkRuntimeException, match="between periods"):
        clock.assert_aligned(df, "t").count()


def test_decisions_are_local_clock_times_of_the_eve(days):
    for r in clock.decision_table(days, 10 * 60 + 45).collect():
        assert r["decision_time"] == utc(r["settlement_date"] - dt.timedelta(1), 10 * 60 + 45)
    assert clock.assert_decided_before(clock.decision_table(days)).count() == len(set(DAYS))
    with pytest.raises(SparkRuntimeException, match="after the day began"):
        clock.assert_decided_before(clock.decision_table(days, 60, 0)).count()


def test_repeated_and_skipped_clock_times(spark):
    keys = clock.calendar_table(clock.grid(spark, "2021-10-31", "2021-10-31"))
    assert sorted(r["minute_of_day"] for r in keys.filter("not first_occurrence").collect()) == [60, 90]
    again = keys.withColumn("one", clock.first_occurrence(keys, ["local_date", "minute_of_day"], "target_time"))
    assert again.filter("one <> first_occurrence").count() == 0
    spring = spark.createDataFrame([(dt.datetime(2019, 3, 31, h, 15),) for h in (0, 1, 2)], "t timestamp")
    assert [r[0] for r in spring.select(clock.exists_locally(F.col("t"))).collect()] == [True, False, True]


def test_publication_counts_strictly_before_the_day(spark):
    day = dt.date(2022, 6, 10)
    stamps = [utc(day) - dt.timedelta(seconds=1), utc(day), None]
    df = spark.createDataFrame([(i, day, t) for i, t in enumerate(stamps)], "i int, d date, t timestamp")
    rows = df.select("i", *(c.alias(k) for k, c in clock.resolve_publication(F.col("t"), F.col("d"), 500, 2).items())).orderBy("i").collect()
    due = utc(day - dt.timedelta(2), 500)
    assert [(r["published_at"], r["published_at_source"], r["published_at_suspect"]) for r in rows] == [(stamps[0], "archive", False), (due, "schedule", True), (due, "schedule", True)]


def test_stamps_are_read_leniently(spark):
    df = spark.createDataFrame([("2022-06-10T09:30:00Z",), ("2022-06-10 10:30",), ("no date",), (None,)], "x string")
    got = [r[0] for r in df.select(clock.lenient(F.col("x"))).collect()]
    assert got == [dt.datetime(2022, 6, 10, 9, 30), dt.datetime(2022, 6, 10, 10, 30), None, None]
    local = [r[0] for r in df.select(clock.lenient(F.col("x"), clock.ZONE)).collect()]
    assert local[1] == dt.datetime(2022, 6, 10, 9, 30)


def test_contracts_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(ContractError, match="lacks"):
        require_columns(df, ["z"])
    with pytest.raises(SparkRuntimeException, match=r'table repeats \[.k.\]: \{"k":1\}'):
        assert_unique(df, ["k"]).collect()
    with pytest.raises(SparkRuntimeException, match="left repeats"):
        one_to_one(df, df.limit(1), ["k"]).count()
    assert one_to_one(df.limit(1), df.limit(1).withColumnRenamed("v", "w"), ["k"]).columns == ["k", "v", "w"]


def test_a_broken_contract_fails_the_write_that_it_guards(spark, tmp_path):
    """The plan is built without a job, and what is written from broken rows does not come to be."""
    tracker, group = spark.sparkContext.statusTracker(), "contracts"
    spark.sparkContext.setJobGroup(group, group)
    df = spark.range(2000).select((F.col("id") % 1999).alias("k"), "id")
    checked = assert_none(assert_unique(df, ["k"]), F.col("id") < 0, "negative")
    assert not tracker.getJobIdsForGroup(group)
    with pytest.raises(Exception, match="repeats"):
        checked.write.parquet(str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    assert_unique(df.filter("id < 1999"), ["k"]).write.parquet(str(tmp_path / "good"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1999


@pytest.mark.parametrize("zone,year", [("Australia/Lord_Howe", 2024), ("Europe/London", 2024), ("America/St_Johns", 2005), ("Antarctica/Troll", 2023), ("Asia/Kathmandu", 2024)])
def test_first_passes_of_zones_with_other_changes(spark, zone, year):
    """A year of instants, a quarter of an hour apart, against the clock times seen so far."""
    start = dt.datetime(year, 1, 1, tzinfo=UTC)
    instants = [start + dt.timedelta(minutes=15 * i) for i in range(4 * 24 * 366)]
    df = spark.createDataFrame([(t.replace(tzinfo=None),) for t in instants], "t timestamp")
    got = dict(df.select("t", clock.first_pass(F.col("t"), zone)).collect())
    seen = set()
    for t in instants:
        clock_time = t.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
        assert got[t.replace(tzinfo=None)] == (clock_time not in seen)
        seen.add(clock_time)
