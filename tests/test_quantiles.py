"""Distributed selection against numpy, on groups of very different sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles, with_quantiles

LEVELS = {"low": ("x", 0.0), "q1": ("x", 0.025), "mid": ("x", 0.5), "q9": ("x", 0.9), "top": ("x", 1.0), "other": ("y", 0.25)}


def frame(spark):
    rnd = random.Random(6)
    rows = [("hot", rnd.choice([1.5, -2.0, rnd.gauss(0, 50)]), rnd.random()) for _ in range(4000)]
    rows += [(g, rnd.gauss(5, 2), None) for g in ("a", "b", None) for _ in range(rnd.randint(1, 40))]
    rows += [("one", 3.25, 4.5), ("none", None, None), ("half", None, 1.0), ("half", None, 2.0)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(7)


def want(rows):
    out = {}
    for name, (column, level) in LEVELS.items():
        v = [r["xy".index(column)] for r in rows if r["xy".index(column)] is not None]
        out[name] = float(np.quantile(v, level)) if v else None
    return out


@pytest.mark.parametrize("parts", [None, 1, 23])
def test_quantiles_of_groups_and_of_the_table(spark, parts):
    rows, df = frame(spark)
    values = {"x": F.col("x"), "y": F.col("y")}
    got = {r["g"]: r.asDict() for r in exact_quantiles(df, values, LEVELS, ["g"], parts).collect()}
    assert set(got) == {"hot", "a", "b", None, "one", "half"}
    for g, r in got.items():
        assert {k: r[k] for k in LEVELS} == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in want([x[1:] for x in rows if x[0] == g]).items()}
    one = exact_quantiles(df, values, LEVELS, parts=parts).first().asDict()
    assert one == {k: pytest.approx(v, abs=1e-12) for k, v in want([x[1:] for x in rows]).items()}
    sizes = df.groupBy("g").agg(F.count("*").alias("n"))
    joined = with_quantiles(sizes, exact_quantiles(df, values, LEVELS, ["g"], parts), ["g"])
    assert {r["g"]: r["mid"] is None for r in joined.collect()} == {"hot": False, "a": False, "b": False, None: False, "one": False, "none": True, "half": True}


def test_a_large_group_is_many_parts(spark):
    """Values of one group are spread over the parts, and rows outside the asked parts are not read again."""
    df = spark.range(60_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    out = exact_quantiles(df, {"x": F.col("x")}, {"m": ("x", 0.5)}, ["g"], parts=16)
    sizes = [r["count"] for r in spark.read.parquet(out.inputFiles()[0].rsplit("/_part", 1)[0]).groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 60_000 / 16
    assert out.first()["m"] == 29_999.5


def test_an_empty_table_has_one_row_of_nulls_or_none(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert exact_quantiles(df, {"x": F.col("x")}, {"m": ("x", 0.5)}, ["g"]).count() == 0
    assert exact_quantiles(df, {"x": F.col("x")}, {"m": ("x", 0.5)}).collect()[0]["m"] is None
