"""The audit of suspect days against plain Python, and what is compared on shared days."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tidemark.operators import dispatch, scoring, suspects

COLUMNS = suspects.SuspectColumns()
SCHEMA = "settlement_date date, settlement_period int, forecast double, actual double, capacity double, suspect boolean, a timestamp, b timestamp"


def rows(share, seed=3):
    """Three years; in 2023 days of late June and of autumn are suspect, the error of the first shrinks to a share."""
    rnd = random.Random(seed)
    out = []
    for i in range(3 * 365 + 1):
        day = dt.date(2022, 1, 1) + dt.timedelta(i)
        late = day.year == 2023 and ((day.month == 6 and day.day >= 10) or (day.month == 10 and day.day < 9))
        for period in (1, 12, 20, 40, 48):
            actual = rnd.uniform(100, 900)
            error = rnd.gauss(10, 60) * (share if late and day.month == 6 else 1) * (1 + period / 48)
            forecast = None if rnd.random() < 0.02 else actual + error
            t = dt.datetime.combine(day, dt.time()) + dt.timedelta(minutes=30 * period)
            out.append((day, period, forecast, actual, rnd.choice([1000.0, 1000.0, 1000.0, 0.0]) if rnd.random() < 0.05 else 1000.0, late, t, t if rnd.random() < 0.9 else None))
    return out


def named(r, first, last):
    same = (first.month, first.day) <= (r[0].month, r[0].day) <= (last.month, last.day)
    if r[0].year == 2023:
        return "block" if same else (None if r[5] else "outside")
    return f"control {r[0].year}" if same and r[0].year in (2022, 2024) else None


@pytest.fixture(scope="module", params=[0.4, 1.0])
def case(spark, request):
    data = rows(request.param)
    return request.param, data, spark.createDataFrame(data, SCHEMA).repartition(4)


def test_block_and_starts(case):
    _, data, df = case
    got = suspects.starts_agree(df, COLUMNS, 2023, "a", "b").first()
    assert (got["first_day"], got["last_day"], got["n_days"]) == (dt.date(2023, 6, 10), dt.date(2023, 6, 30), 21)
    gone = sum(r[2] is None or r[4] == 0 for r in data)
    assert (got["rows"], got["dropped"], got["starts_agree"]) == (len(data), gone, sum(r[6] == r[7] for r in data))
    none = suspects.starts_agree(df, COLUMNS, 2022, "a", "b").first()
    assert none["rows"] == len(data) and none["first_day"] is None


def test_windows_equal_plain_python(case):
    _, data, df = case
    first, last = dt.date(2023, 6, 10), dt.date(2023, 6, 30)
    good = [r for r in data if r[2] is not None and r[4] > 0]
    got = {r["window"]: r for r in suspects.block_windows(df, COLUMNS, 2023, [2022, 2024]).collect()}
    assert set(got) == {"block", "control 2022", "control 2024", "outside"}
    for name, r in got.items():
        own = [x for x in good if named(x, first, last) == name]
        e = [(x[2] - x[3]) / x[4] for x in own]
        assert (r["days"], r["periods"]) == (len({x[0] for x in own}), len(own))
        want = {"mae": np.mean(np.abs(e)), "rmse": np.sqrt(np.mean(np.square(e))), "bias": np.mean(e), "corr": np.corrcoef([x[2] for x in own], [x[3] for x in own])[0, 1]}
        want["mae_early"], want["mae_late"] = (np.mean([abs(v) for v, x in zip(e, own) if part(x[1])]) for part in (lambda p: p <= 16, lambda p: p >= 33))
        want["growth"] = want["mae_late"] / want["mae_early"]
        assert {k: r[k] for k in want} == {k: pytest.approx(v) for k, v in want.items()}


def test_ratios_equal_plain_draws(case):
    share, data, df = case
    first, last = dt.date(2023, 6, 10), dt.date(2023, 6, 30)
    daily = {}
    for r in data:
        name = named(r, first, last)
        if r[2] is not None and r[4] > 0 and name not in (None, "outside"):
            daily.setdefault(name, {}).setdefault(r[0], []).append(abs(r[2] - r[3]) / r[4])
    samples = {n: [statistics.fmean(v) for _, v in sorted(d.items())] for n, d in daily.items()}
    samples["controls"] = samples["control 2022"] + samples["control 2024"]
    reps, block = 300, 7

    def drawn(name, seed):
        days = samples[name]
        n, out = len(days), []
        for rep in range(reps):
            total = 0.0
            for blk in range(-(-n // block)):
                start = ((rep * scoring.A + blk * scoring.B + seed * scoring.C) % scoring.P) % n
                total += sum(days[(start + i) % n] for i in range(min(block, n - blk * block)))
            out.append(total / n)
        return np.array(out)

    x = {n: drawn(n, i + 1) for i, n in enumerate(["block", "controls", "control 2022", "control 2024"])}
    got = {r["pair"]: r for r in suspects.block_ratios(df, COLUMNS, 2023, [2022, 2024], replicates=reps).collect()}
    assert set(got) == {"block / controls", "control 2022 / control 2024"}
    for pair, r in got.items():
        a, b = pair.split(" / ")
        assert r["ratio"] == pytest.approx(statistics.fmean(samples[a]) / statistics.fmean(samples[b]))
        assert (r["lo"], r["hi"]) == tuple(pytest.approx(v) for v in np.quantile(x[a] / x[b], [0.025, 0.975]))
    assert got["block / controls"]["verdict"] == ("REGENERATED" if share < 1 else got["block / controls"]["verdict"])
    assert share < 1 or got["block / controls"]["verdict"] != "REGENERATED"
    assert got["control 2022 / control 2024"]["verdict"] is None


def test_nothing_suspect_has_no_windows(case):
    _, _, df = case
    assert suspects.block_windows(df, COLUMNS, 2024, [2022, 2023]).count() == 0
    assert suspects.block_ratios(df, COLUMNS, 2024, [2022, 2023], replicates=5).count() == 0


def test_shared_days_and_the_first_one(spark):
    day = lambda n: dt.date(2024, 3, n)
    one = spark.createDataFrame([(day(n), float(n)) for n in (1, 2, 3, 4)], "day date, x double")
    other = spark.createDataFrame([(day(n), float(n)) for n in (2, 3, 4, 5)], "day date, y double")
    a, b = suspects.shared_days(one, other, "day")
    assert sorted(r["x"] for r in a.collect()) == sorted(r["y"] for r in b.collect()) == [2.0, 3.0, 4.0]
    assert suspects.only_the_first(one, other, "day").first() == (1, True)
    assert suspects.only_the_first(other, one, "day").first() == (1, False)
    assert suspects.only_the_first(one, one, "day").first() == (0, False)


def test_one_day_is_refused_where_it_cannot_be_solved(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1), 5.0, True), (dt.date(2024, 3, 2), None, True), (dt.date(2024, 3, 3), 1.0, False)], "d date, price double, day_usable boolean")
    assert dispatch.one_day(df, "d", "2024-03-01", "price").first() == (dt.date(2024, 3, 1), 5.0, True)
    for day, message in (("2024-03-02", "not usable"), ("2024-03-03", "not usable"), ("2024-03-04", "missing")):
        with pytest.raises(SparkRuntimeException, match=message):
            dispatch.one_day(df, "d", day, "price").collect()
