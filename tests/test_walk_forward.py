"""Quantile regressions of all folds at once against a plain numpy fit of each fold."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import forecast
from tidemark.operators.contracts import ContractError

LEVELS = {"low": 0.1, "mid": 0.5, "high": 0.9}


def days(n, seed, nulls=0.05):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rnd.gauss(0, 1), rnd.uniform(-3, 3)
        y = 20 + 4 * x - 2 * z + rnd.gauss(0, 1 + abs(z))
        hide = lambda v: None if rnd.random() < nulls else v
        out.append((dt.date(2023, 1, 1) + dt.timedelta(i), hide(y), hide(x), z, hide(15.0 + x), 7.0))
    return out


def loss(y, f, q):
    d = y - f
    return np.maximum(q * d, (q - 1) * d).mean()


def plain(train, test, level, anchor, steps=24, ridge=1e-6):
    """One fold and level in numpy: design, majorised steps, forecast."""
    num = lambda rows, i: np.array([np.nan if r[i] is None else r[i] for r in rows], float)
    back = num(train, 4) if anchor else np.zeros(len(train))
    middle = np.nanmedian(back)
    y = num(train, 1) - np.where(np.isnan(back), middle, back)
    raw = np.stack([num(train, i) for i in (2, 3, 5)], 1)
    mean, std = np.nanmean(raw, 0), np.nanstd(raw, 0)
    std = np.where(std > 1e-12, std, np.inf)
    design = lambda m: np.hstack([np.ones((len(m), 1)), np.where(np.isnan(m), 0, (m - mean) / std), np.isnan(m)])
    x, b = design(raw), np.zeros(7)
    b[0] = y.mean()
    for t in range(steps):
        w = 1 / (max(y.std(), 1e-9) * max(0.5**t, 1e-3) + np.abs(y - x @ b))
        a = (x * w[:, None]).T @ x
        b = b + 1.8 * (np.linalg.solve(a + ridge * np.trace(a) / 7 * np.eye(7), x.T @ (w * y) + (2 * level - 1) * x.sum(0)) - b)
    own = num(test, 4) if anchor else np.zeros(len(test))
    return design(np.stack([num(test, i) for i in (2, 3, 5)], 1)) @ b + np.where(np.isnan(own), middle, own), x, y, b


@pytest.mark.parametrize("anchor", [None, "a"])
def test_all_folds_equal_plain_fits(spark, anchor):
    rows = days(400, 5)
    df = spark.createDataFrame(rows, "d date, y double, x double, z double, a double, c double").repartition(5)
    folds = forecast.monthly_folds(spark, "2023-03-01", "2024-02-01")
    got = forecast.walk_forward_quantiles(df, folds, ["x", "z", "c"], date="d", target="y", levels=LEVELS, anchor=anchor).collect()
    by = {r["d"]: r for r in got}
    assert len(by) == len(got) == sum(r[0] >= dt.date(2023, 3, 1) for r in rows)
    for f in folds.collect():
        train = [r for r in rows if r[0] <= f["train_end"] and r[1] is not None]
        test = [r for r in rows if f["test_start"] <= r[0] <= f["test_end"]]
        want = np.sort(np.stack([plain(train, test, q, anchor)[0] for q in LEVELS.values()], 1), axis=1)
        assert np.allclose([[by[r[0]][k] for k in LEVELS] for r in test], want, rtol=1e-6, atol=1e-6)
        assert {by[r[0]]["fold"] for r in test} == {f["test_start"]}
    known = [r for r in got if r["y"] is not None]
    assert np.mean([r["low"] <= r["y"] <= r["high"] for r in known]) == pytest.approx(0.8, abs=0.07)


def test_the_steps_end_near_the_least_loss():
    """No small move of a coefficient lowers the pinball loss by more than a trifle."""
    train = days(600, 8, 0.0)
    for level in LEVELS.values():
        _, x, y, b = plain(train, train[:1], level, False)
        best = loss(y, x @ b, level)
        for i in range(4):
            for move in (-0.1, -0.01, 0.01, 0.1):
                other = b.copy()
                other[i] += move
                assert loss(y, x @ other, level) > best * (1 - 1e-3)


def test_folds_without_training_rows(spark):
    df = spark.createDataFrame(days(60, 2), "d date, y double, x double, z double, a double, c double")
    early = forecast.monthly_folds(spark, "2023-01-01", "2023-02-01")
    got = forecast.walk_forward_quantiles(df, early, ["x", "z"], date="d", target="y", levels=LEVELS).collect()
    assert {r["d"].month: r["mid"] is None for r in got} == {1: True, 2: False}
    with pytest.raises(ContractError, match="no fold"):
        forecast.walk_forward_quantiles(df, early.limit(1), ["x"], date="d", target="y", levels=LEVELS)
    nothing = forecast.walk_forward_quantiles(df.withColumn("x", F.lit(None).cast("double")), early, ["x"], date="d", target="y", levels={"mid": 0.5}).filter("mid is not null").count()
    assert nothing == 28


def test_rows_after_the_training_end_change_nothing(spark):
    rows = days(120, 4)
    planted = [(d, 1e6 if d > dt.date(2023, 2, 27) and y is not None else y, *rest) for d, y, *rest in rows]
    folds = forecast.monthly_folds(spark, "2023-03-01", "2023-03-01")
    out = []
    for data in (rows, planted):
        df = spark.createDataFrame(data, "d date, y double, x double, z double, a double, c double")
        q = forecast.walk_forward_quantiles(df, folds, ["x", "z"], date="d", target="y", levels=LEVELS, anchor="a")
        out.append(sorted((r["d"], round(r["low"], 9), round(r["mid"], 9), round(r["high"], 9)) for r in q.collect()))
    assert out[0] == out[1] and len(out[0]) == 31
