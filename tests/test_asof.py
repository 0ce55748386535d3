import datetime as dt
import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import asof

RND = random.Random(77)


def instants(n):
    """Random instants of one hour of a random day, at least a second apart."""
    start = dt.datetime(2019, 1, 1) + dt.timedelta(days=RND.randint(0, 2000), hours=RND.randint(0, 22))
    return [start + dt.timedelta(seconds=x) for x in sorted(RND.sample(range(3600), n))]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("options", [{}, {"hot_rows": 1}, {"hot_rows": None}, {"bucket": "hour"}, {"bucket": "day"}])
def test_rows_around_the_instant_itself(spark, strict, options):
    """The left instant is each of the right ones, between two of them, before the first and after the last."""
    right = instants(5)
    asked = [*right, right[0] - dt.timedelta(1), right[2] + (right[3] - right[2]) / 2, right[-1] + dt.timedelta(3)]
    lf = spark.createDataFrame([(i, 1, t) for i, t in enumerate(asked)], "i int, k int, d timestamp")
    rt = spark.createDataFrame([(1, t, float(i)) for i, t in enumerate(right)], "k int, p timestamp, v double")
    want = [max((j for j, u in enumerate(right) if u < t or (u == t and not strict)), default=None) for t in asked]
    out = asof.asof_join(lf, rt, on=["k"], left_time="d", right_time="p", columns={"v": "v"}, strict=strict, **options)
    assert [r["v"] for r in out.orderBy("i").collect()] == want
    assert {r["v"] for r in asof.asof_join(lf, rt.limit(0), on=["k"], left_time="d", right_time="p", columns={"v": "v"}, **options).collect()} == {None}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 200000)), max_size=30), st.lists(st.tuples(st.sampled_from([1, 2, None]), st.integers(0, 200000)), max_size=30, unique=True))
def test_two_routes_and_buckets_agree(spark, left, right):
    lf = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "i int, k int, t int").selectExpr("i", "k", "timestamp_seconds(t) t")
    rt = spark.createDataFrame([(k, t) for k, t in right], "k int, t int").selectExpr("k", "timestamp_seconds(t) t", "t v")
    a = asof.asof_join(lf, rt, on=["k"], left_time="t", right_time="t", columns={"v": "v"})
    b = asof.asof_join(lf, rt, on=["k"], left_time="t", right_time="t", columns={"v": "v"}, bucket="day")
    d = asof.asof_join(lf, rt, on=["k"], left_time="t", right_time="t", columns={"v": "v"}, hot_rows=3)
    c = asof.asof_by_max(lf, rt, key="k", left_id="i", left_time="t", right_time="t", value="v")
    rows = [sorted((r["i"], r["v"]) for r in x.collect()) for x in (a, b, c, d)]
    want = sorted((i, max((u for q, u in right if q == k and k is not None and u < t), default=None)) for i, (k, t) in enumerate(left))
    assert rows[0] == rows[1] == rows[2] == rows[3] == want


def test_keyless_and_late(spark):
    left = spark.sql("select 1 i, timestamp'2024-01-05 00:00:00' t union all select 2, timestamp'2024-01-01 00:00:00'")
    right = spark.sql("select timestamp'2024-01-02 10:00:00' t, 7 v union all select timestamp'2024-01-01 10:00:00', 6")
    out = asof.asof_join(left, right, left_time="t", right_time="t", columns={"v": "v"})
    assert sorted((r["i"], r["v"]) for r in out.collect()) == [(1, 7), (2, None)]


def test_one_key_of_half_the_rows_is_many_tasks(spark):
    """Windows of a key that holds half of all rows are no larger than twice those of the others, and the result is the same."""
    t = F.timestamp_seconds(F.col("id") * 61 + 1_600_000_000)
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 40))
    rows = spark.range(40_000).select(key.alias("k"), t.alias("t"), "id")
    left, right = rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 0")
    keyed = lambda x: x.select(F.col("k").alias("_k0"), F.col("t").alias("_t"))
    a, b = asof._sliced(keyed(left), keyed(right), ["_k0"], 1000)
    sizes = [r["count"] for r in a.unionByName(b).groupBy("_k0", "_b").count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * statistics.median(sizes)
    join = lambda n: asof.asof_join(left, right, on=["k"], left_time="t", right_time="t", columns={"id": "v"}, hot_rows=n)
    cut, plain = join(1000), join(None)
    assert cut.exceptAll(plain).count() == 0 and cut.count() == left.count()
