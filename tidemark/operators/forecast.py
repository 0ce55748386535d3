"""Walk-forward forecasts: quantile regressions of all folds at once, and boosted trees fold by fold.

``walk_forward_quantiles`` trains every fold and quantile level together. A row belongs to all
folds that begin late enough after it; each pass over the stored rows adds up, for every fold and
level, the gradient and the curvature of the loss where its coefficients stand, and these few sums
are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import uncrossed
from ..sources.store import Store
from .contracts import ContractError
from .quantiles import exact_quantiles


def monthly_folds(spark: SparkSession, first: str, last: str, gap_days: int = 2) -> DataFrame:
    """A fold a month: trains on days up to ``gap_days`` before the month, tests on the month."""
    months = F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "MM"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("test_start")
    f = spark.range(1).select(months)
    return f.select("test_start", F.last_day("test_start").alias("test_end"), F.date_sub("test_start", gap_days).alias("train_end"))


def split(frame: DataFrame, fold, date: str, target: str) -> tuple[DataFrame, DataFrame]:
    train = frame.filter((F.col(date) <= F.lit(fold["train_end"])) & F.col(target).isNotNull())
    return train, frame.filter(F.col(date).between(F.lit(fold["test_start"]), F.lit(fold["test_end"])))


def select_features(features: list[str], drop: list[str] | None = None) -> list[str]:
    """Features without the dropped ones; refuses names that are not among them."""
    if unknown := sorted(set(drop or []) - set(features)):
        raise ContractError(f"unknown features {unknown}")
    return [f for f in features if f not in (drop or [])]


def anchored(frame: DataFrame, target: str, anchor: str) -> tuple[Column, Column]:
    """The target less an anchor, and the anchor; a null anchor is the frame's median of it."""
    median = exact_quantiles(frame, {"a": F.col(anchor)}, {"m": ("a", 0.5)}).first()["m"]
    a = F.coalesce(F.col(anchor), F.lit(median if median is not None else 0.0))
    return F.col(target) - a, a


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, *, anchor: str | None = None, trees: int = 40, depth: int = 5, seed: int = 7, name: str = "predicted") -> DataFrame:
    """Fits boosted trees on absolute error and predicts the test rows.

    Nulls become the training median, with an indicator column of each feature; a feature without
    any training value is left out.
    """
    counts = train.agg(*(F.count(f).alias(f) for f in features)).first()
    used = [f for f in features if counts[f]]
    missing = [F.col(f).isNull().cast("double").alias(f"_m_{f}") for f in used]
    shape = lambda d: d.select("*", *missing).withColumns({f: F.col(f).cast("double") for f in used})
    y, back = anchored(train, target, anchor) if anchor else (F.col(target), F.lit(0.0))
    train, test = shape(train).withColumn("_y", y), shape(test)
    imputer = Imputer(strategy="median", inputCols=used, outputCols=[f"_i_{f}" for f in used]).fit(train)
    vector = VectorAssembler(inputCols=[f"_i_{f}" for f in used] + [f"_m_{f}" for f in used], outputCol="_x")
    ready = lambda d: vector.transform(imputer.transform(d))
    cached = ready(train).select("_x", "_y").persist()
    model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", lossType="absolute", maxIter=trees, maxDepth=depth, seed=seed).fit(cached)
    cached.unpersist()
    return model.transform(ready(test)).withColumn(name, F.col("_p") + back).select(*[c for c in test.columns if not c.startswith("_m_")], name)


def walk_forward(frame: DataFrame, folds: DataFrame, features: list[str], *, date: str, target: str, anchor: str | None = None, trees: int = 40, depth: int = 5) -> DataFrame:
    """Predictions of every fold's test rows; the folds are few and run one after the other."""
    out = None
    for fold in folds.orderBy("test_start").collect():
        train, test = split(frame, fold, date, target)
        if train.isEmpty():
            continue
        p = fit_predict(train, test, features, target, anchor=anchor, trees=trees, depth=depth).withColumn("fold", F.lit(fold["test_start"]))
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ContractError("no fold has training rows")
    return out


#: Each step goes so many times as far as its bound says, which halves the steps needed (up to twice is safe).
STRIDE = 1.8


def _design(columns: list[str], mean: np.ndarray, scale: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """One, the scaled features with their mean for a null, and a mark for each null; a feature without spread is 0."""
    x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], axis=1) if columns else np.zeros((batch.num_rows, 0))
    gone = np.isnan(x)
    return np.hstack([np.ones((len(x), 1)), np.where(gone, 0.0, (x - mean) / scale), gone])


def _step(columns: list[str], means: np.ndarray, scales: np.ndarray, beta: np.ndarray, width: np.ndarray):
    """Sums of one step: for each fold and level the curvature X'WX and X'Wy, and X'1, with weights 1 / (width + |residual|)."""
    folds, levels, p = beta.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, levels, p, p + 2))
        for batch in batches:
            first, last, y = (batch.column(c).to_numpy() for c in ("_first", "_last", "_y"))
            for f in range(first.min(), last.max() + 1) if len(y) else ():
                own = (first <= f) & (f <= last)
                if not own.any():
                    continue
                x = _design(columns, means[f], scales[f], batch.filter(pa.array(own)))
                r = y[own, None] - x @ beta[f].T
                w = 1.0 / (width[f] + np.abs(r))
                for q in range(levels):
                    xw = x * w[:, q : q + 1]
                    sums[f, q, :, :p] += xw.T @ x
                    sums[f, q, :, p] += xw.T @ y[own]
                    sums[f, q, :, p + 1] += x.sum(axis=0)
        flat = sums.reshape(folds * levels, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * levels)), pa.array(list(flat), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _predict(columns: list[str], means: np.ndarray, scales: np.ndarray, beta: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("_fold").to_numpy()
            out = np.full((batch.num_rows, len(names)), np.nan)
            for f in np.unique(fold):
                own = fold == f
                out[own] = _design(columns, means[f], scales[f], batch.filter(pa.array(own))) @ beta[f].T
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[:, i], from_pandas=True) for i in range(len(names)))], names=[*batch.schema.names, *names])

    return run


def walk_forward_quantiles(frame: DataFrame, folds: DataFrame, features: list[str], *, date: str, target: str, levels: dict[str, float], anchor: str | None = None, steps: int = 24, ridge: float = 1e-6) -> DataFrame:
    """Quantile forecasts of every fold's test rows by linear regressions on the pinball loss, all folds trained at once.

    Args:
        folds: from ``monthly_folds``; a fold trains on rows up to its ``train_end`` that have a target.
        levels: names of the forecast columns and their levels from 0 to 1.
        anchor: a column that is taken from the target before fitting and added back; a null one is
            the median of the fold's training rows.
        steps: passes over the rows. Each is a step of majorisation: the loss is bounded by squares
            about the present residuals, whose width halves down to a thousandth of the target's spread.

    Features are scaled by the fold's training rows; a null is their mean, with a column of its own
    that says so. A fold without training rows has null forecasts; without any it is refused.
    Forecasts do not cross. Returns the test rows with ``fold`` (its first day) and the levels.
    """
    spark = frame.sparkSession
    store = Store(spark, "walk")
    plan = folds.orderBy("test_start").collect()
    ends = F.array(*(F.lit(f["train_end"]) for f in plan))
    n, names = len(plan), list(levels)
    cast = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    columns = [f"_x{i}" for i in range(len(features))]
    day = F.col(date).cast("date")
    # The first fold that may train on a row; none where it is the number of folds.
    first = F.aggregate(ends, F.lit(0), lambda a, e: a + (e < day).cast("int"))
    back = F.col(anchor).cast("double") if anchor else F.lit(0.0)
    train = frame.filter(F.col(target).isNotNull() & day.isNotNull()).select(first.alias("_first"), F.col(target).cast("double").alias("_t"), back.alias("_a"), *cast).filter(F.col("_first") < n)
    train = store.put(train)

    middle = np.zeros(n)
    if anchor:
        known = train.select(F.explode(F.sequence("_first", F.lit(n - 1))).alias("f"), "_a")
        for r in exact_quantiles(known, {"a": F.col("_a")}, {"m": ("a", 0.5)}, ["f"]).collect():
            middle[r["f"]] = r["m"]
    # A row without an anchor has another target in each fold, so it is one row for each; the others are one row.
    medians = F.array(*(F.lit(float(m)) for m in middle))
    whole = train.filter("_a is not null").withColumn("_y", F.col("_t") - F.col("_a")).withColumn("_last", F.lit(n - 1))
    bare = train.filter("_a is null").withColumn("_first", F.explode(F.sequence("_first", F.lit(n - 1)))).withColumn("_last", F.col("_first")).withColumn("_y", F.col("_t") - medians[F.col("_first")])
    rows = store.put(whole.unionByName(bare).select("_first", "_last", "_y", *columns))

    # Means and spreads of each fold's rows from sums by first fold: later folds hold the rows of earlier ones.
    sums = [F.count("*").cast("double"), F.sum("_y"), F.sum(F.col("_y") * F.col("_y"))]
    for c in columns:
        sums += [F.count(c).cast("double"), F.sum(c), F.sum(F.col(c) * F.col(c))]
    cells = np.zeros((n, n, len(sums)))
    for r in rows.groupBy("_first", "_last").agg(*(F.coalesce(x, F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(sums))).collect():
        cells[r["_first"] : r["_last"] + 1, r["_first"]] += np.array(r[2:])
    total = cells.sum(axis=1).reshape(n, -1, 3)
    count = np.maximum(total[:, :, 0], 1)
    mean = total[:, :, 1] / count
    spread = np.sqrt(np.maximum(total[:, :, 2] / count - mean**2, 0))
    some = total[:, 0, 0] > 0
    if not some.any():
        raise ContractError("no fold has training rows")
    means, scales = mean[:, 1:], np.where(spread[:, 1:] > 1e-12 * np.maximum(np.abs(mean[:, 1:]), 1), spread[:, 1:], np.inf)

    p = 1 + 2 * len(features)
    beta = np.zeros((n, len(names), p))
    beta[:, :, 0] = mean[:, :1]
    for t in range(steps):
        width = np.maximum(spread[:, 0], 1e-9) * max(0.5**t, 1e-3)
        step = _step(columns, means, scales, beta, width)
        got = np.zeros((n * len(names), p * (p + 2)))
        for r in rows.mapInArrow(step, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
            got[r["i"], r["j"]] = r["v"]
        got = got.reshape(n, len(names), p, p + 2)
        for f in np.flatnonzero(some):
            for q, level in enumerate(levels.values()):
                a, b = got[f, q, :, :p], got[f, q, :, p] + (2 * level - 1) * got[f, q, :, p + 1]
                beta[f, q] += STRIDE * (np.linalg.solve(a + ridge * np.trace(a) / p * np.eye(p), b) - beta[f, q])
    beta[~some] = np.nan

    tests = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f["test_start"]).alias("a"), F.lit(f["test_end"]).alias("b")) for i, f in enumerate(plan)))
    own = F.filter(tests, lambda x: day.between(x["a"], x["b"]))
    test = frame.withColumn("_of", own).filter(F.size("_of") > 0).withColumn("_fold", F.col("_of")[0]["i"]).withColumn("fold", F.col("_of")[0]["a"]).drop("_of")
    test = test.withColumn("_back", F.coalesce(back, medians[F.col("_fold")])).select("*", *cast)
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in test.schema) + "".join(f", `{c}` double" for c in names)
    out = test.mapInArrow(_predict(columns, means, scales, beta, names), schema)
    out = out.withColumns({c: F.col(c) + F.col("_back") for c in names})
    rest = [*frame.columns, "fold"]
    return out.select(*rest, *uncrossed(names))


def residual_quantiles(predicted: DataFrame, target: str, hour: Column, levels: dict[str, float], name: str = "predicted") -> DataFrame:
    """Quantile forecasts: the point forecast plus quantiles of the earlier folds' residuals of the hour, not crossing.

    Rows of the first fold, which has none before it, get null quantiles.
    """
    p = predicted.withColumn("_h", hour)
    folds = p.select("fold").distinct()
    old = p.filter(F.col(target).isNotNull()).select(F.col("fold").alias("_f"), "_h", (F.col(target) - F.col(name)).alias("_e"))
    q = folds.join(F.broadcast(folds.select(F.col("fold").alias("_f"))), F.col("_f") < F.col("fold")).join(old, "_f")
    q = q.groupBy("fold", "_h").agg(*(F.percentile("_e", F.lit(v)).alias(k) for k, v in levels.items()))
    out = p.join(q, ["fold", "_h"], "left").drop("_h").withColumns({k: F.col(k) + F.col(name) for k in levels})
    rest = [c for c in out.columns if c not in levels]
    return out.select(*rest, *uncrossed(list(levels)))


def baselines(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Lag features under the names of naive forecasts."""
    return frame.withColumns({name: F.col(c) for c, name in columns.items()})
