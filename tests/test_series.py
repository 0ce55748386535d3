import datetime as dt
import itertools
import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.operators import series
from tidemark.sources import ingest

T0 = dt.datetime(2024, 1, 1)


def frame(spark, values, start=T0):
    return spark.createDataFrame([(0, start + dt.timedelta(minutes=30 * i), v) for i, v in enumerate(values)], "s int, t timestamp, x double")


def col(df, c):
    return [r[c] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("start", [T0, dt.datetime(2024, 1, 27, 22)])
def test_short_gaps_are_filled_and_long_ones_left(spark, start):
    df = frame(spark, [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None], start)
    out = series.fill_short_gaps(df, ["s"], "t", "x", 2)
    assert col(out, "x") == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None, None, None, 10.0, None]
    assert [i for i, f in enumerate(col(out, "x_interpolated")) if f] == [2, 4, 5]


def test_runs_gaps_and_zeros(spark):
    df = frame(spark, [5.0] * 6 + [None] + [5.0] * 5 + [0.0, 1.0] + [0.0] * 3)
    assert col(series.stuck_runs(df, ["s"], "t", "x", 6), "stuck") == [True] * 6 + [False] * 11
    assert col(series.zero_runs(df, ["s"], "t", "x", 3), "zero_run") == [False] * 14 + [True] * 3
    assert col(series.gap_lengths(frame(spark, [None, None, 1.0, None, 2.0]), ["s"], "t", "x"), "gap") == [2, 2, 0, 1, 0]
    assert series.longest_run(df, ["s"], "t", "x").first()["longest_run"] == 11


def test_chunks_do_not_change_runs(spark):
    values = [float(i // 7) for i in range(48 * 70)]
    df = frame(spark, values)
    assert all(col(series.stuck_runs(df, ["s"], "t", "x", 7), "stuck"))
    assert not any(col(series.stuck_runs(df, ["s"], "t", "x", 8), "stuck"))


def test_default_needs_a_volume(spark):
    df = spark.createDataFrame([(0.0, 10.0), (0.0, 25.0), (0.0, None), (5.0, 10.0), (None, 1.0)], "p double, v double")
    got = df.select(rules.defaulted(F.col("p"), F.col("v")).alias("d"), rules.liquidity_anomaly(F.col("p"), F.col("v")).alias("a")).collect()
    assert [r["d"] for r in got] == [True, False, False, False, False]
    assert [r["a"] for r in got] == [False, False, False, True, False]


def test_cleaning_pass(spark):
    rows = [(0, T0 + dt.timedelta(minutes=30 * i), 50.0 + i % 7, 100.0) for i in range(96) if i not in (10, 60, 61, 62)]
    rows[3] = (0, rows[3][1], 0.0, 1.0)
    rows.append((0, rows[5][1], 99.0, 100.0))
    df = spark.createDataFrame(rows, "s int, t timestamp, price double, volume double")
    policy = series.CleaningPolicy(volumes={"price": "volume"})
    out = series.clean_series(df, ["s"], "t", policy).cache()
    assert out.count() == 96
    by = {r["t"]: r for r in out.collect()}
    assert by[T0 + dt.timedelta(minutes=90)]["price_defaulted"] and by[T0 + dt.timedelta(minutes=90)]["price_interpolated"]
    assert by[T0 + dt.timedelta(minutes=300)]["price_interpolated"]
    assert by[T0 + dt.timedelta(minutes=30 * 61)]["price"] is None
    days = {r["settlement_date"].day: r["day_usable"] for r in series.day_usability(out, []).collect()}
    assert days == {1: True, 2: False}
    report = {r["check"]: r["value"] for r in series.quality_report(out, policy).collect()}
    assert (report["price_missing"], report["price_defaulted"], report["price_interpolated"], report["days_unusable"]) == (3, 1, 2, 1)


def test_revisions_and_date_runs(spark):
    df = spark.sql("select * from values ('a', 1, 10.0), ('a', 2, 20.0), ('b', 1, 5.0) v(k, at, x)")
    assert sorted((r["k"], float(r["x"])) for r in series.latest_revision(df, ["k"], "at").collect()) == [("a", 20.0), ("b", 5.0)]
    days = spark.sql("select explode(array(date'2024-01-01', date'2024-01-02', date'2024-01-04')) d")
    assert sorted(r["n_days"] for r in series.date_runs(days, "d").collect()) == [1, 2]


def test_rekey_quarantine_and_pivot(spark):
    rows = [("2024-03-31", 1 + i, dt.datetime(2024, 3, 31) + dt.timedelta(minutes=30 * i), "WIND", float(i)) for i in range(46)]
    rows[45] = ("2024-03-31", 48, rows[45][2], "WIND", 45.0)
    df = spark.createDataFrame(rows, "d string, n int, t timestamp, fuel string, x double").withColumn("d", F.to_date("d"))
    out = ingest.rekey(df, "d", "n", "t", fuel="fuel")
    assert out.filter("moved").select("n").first()["n"] == 46
    kept, bad = ingest.quarantine(df, "d", "n")
    assert (kept.count(), bad.count()) == (45, 1)
    with pytest.raises(SparkRuntimeException, match="46 of 46 periods"):
        ingest.rekey(df.withColumn("n", F.col("n") + 1), "d", "n", "t").count()
    twice = df.unionByName(df.filter("n = 48").withColumns({"n": F.lit(46), "t": F.lit(None).cast("timestamp")}))
    with pytest.raises(SparkRuntimeException, match="there already"):
        ingest.rekey(twice, "d", "n", "t", fuel="fuel").count()
    with pytest.raises(SparkRuntimeException, match="more than 0 rows"):
        ingest.quarantine(df, "d", "n", most=0)[0].count()
    wide = ingest.pivot_fuels(out.withColumn("at", F.lit(1)), ["d", "n"], "fuel", ["WIND", " coal"], "x", "at", moved="moved", start="t")
    assert wide.columns == ["d", "n", "gen_wind_mw", "gen_coal_mw", "rekeyed", "start_time"] and wide.count() == 46
    assert wide.filter("rekeyed").select("n", "start_time", "gen_wind_mw").first() == (46, rows[45][2], 45.0)
    with pytest.raises(SparkRuntimeException, match="provider rows repeats"):
        ingest.pivot_providers(df.unionByName(df), ["d", "n"], "fuel", ["WIND"], "x", "x").count()


def test_readings_between_the_steps_are_refused(spark):
    """A reading at 00:40 has no place on a half-hour grid: it must not vanish, nor a filled value take its place."""
    df = spark.createDataFrame([(0, T0 + dt.timedelta(minutes=m), 1.0) for m in (0, 40, 60)], "s int, t timestamp, price double")
    with pytest.raises(SparkRuntimeException, match="between the steps"):
        series.regular_grid(df, ["s"], "t").count()
    with pytest.raises(SparkRuntimeException, match="between the steps"):
        series.clean_series(df, ["s"], "t", series.CleaningPolicy()).collect()
    shifted = df.filter("minute(t) <> 40").withColumn("t", F.expr("t + interval 7 minutes"))
    assert series.regular_grid(shifted, ["s"], "t").count() == 3


@pytest.mark.parametrize("chunk_days", [1, 2, 50])
def test_runs_over_chunks_equal_a_plain_pass(spark, chunk_days):
    """Runs within a chunk, over one border and over many, of irregular instants and of several series."""
    rnd = random.Random(chunk_days)
    rows = []
    for s in ("a", "b", None):
        minute = 0
        for state, n in [(rnd.choice([1.0, 2.0, None]), rnd.choice([1, 2, 5, 40, 150])) for _ in range(40)]:
            for _ in range(n):
                rows.append((s, T0 + dt.timedelta(minutes=minute), state))
                minute += rnd.choice([30, 30, 30, 60, 2000])
    rows.append(("c", T0, None))
    df = spark.createDataFrame(rows, "s string, t timestamp, x double")
    got = {(r["s"], r["t"]): r["n"] for r in series.run_lengths(df, ["s"], "t", F.col("x"), "n", chunk_days).collect()}
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == s) if all(r[2] is not None for r in rows if r[0] == s) else sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        own = [(r[-2], r[-1]) for r in own]
        for _, group in itertools.groupby(own, key=lambda r: r[1]):
            group = list(group)
            want.update({(s, t): len(group) for t, _ in group})
    assert got == want


def test_longest_runs_gaps_and_sums_beyond_a_chunk(spark):
    values = [None] * 48 * 40 + [1.0] * 48 * 70 + [None, 1.0, 2.0] + [None] * 48 * 33
    df = frame(spark, values)
    gaps = col(series.gap_lengths(df, ["s"], "t", "x"), "gap")
    assert gaps == [48 * 40] * 48 * 40 + [0] * 48 * 70 + [1, 0, 0] + [48 * 33] * 48 * 33
    assert series.longest_run(df, ["s"], "t", "x").first()["longest_run"] == 48 * 70 + 1
    days = spark.sql("select s, d, dayofyear(d) / 7.0D x from (select explode(sequence(date'2019-11-05', date'2022-03-01')) d) cross join (select explode(array('p', null)) s)")
    total, want = 0.0, {}
    for i in range((dt.date(2022, 3, 1) - dt.date(2019, 11, 5)).days + 1):
        d = dt.date(2019, 11, 5) + dt.timedelta(i)
        total += d.timetuple().tm_yday / 7.0
        want[d] = total
    got = series.cumulative(days, ["s"], "d", "x").collect()
    assert len(got) == 2 * len(want) and all(r["cumulative"] == pytest.approx(want[r["d"]]) for r in got)


@pytest.mark.parametrize("chunk_days", [2, 7, 366])
def test_date_runs_over_chunks(spark, chunk_days):
    rnd = random.Random(chunk_days)
    days = sorted({dt.date(1969, 12, 20) + dt.timedelta(i) for i in range(400) if rnd.random() < 0.8})
    want, start = [], 0
    for i in range(1, len(days) + 1):
        if i == len(days) or days[i] - days[i - 1] > dt.timedelta(1):
            want.append((days[start], days[i - 1], i - start))
            start = i
    df = spark.createDataFrame([(d,) for d in days + days[:9]] + [(None,)], "d date")
    assert sorted(map(tuple, series.date_runs(df, "d", chunk_days=chunk_days).collect())) == want
    two = df.withColumn("s", F.explode(F.array(F.lit(1), F.lit(None).cast("int"))))
    assert sorted(tuple(r)[1:] for r in series.date_runs(two, "d", ["s"], chunk_days).collect()) == sorted(want * 2)
