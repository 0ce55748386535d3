import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators.contracts import ContractError
from tidemark.plans.queries import QUERIES
from tidemark.plans.sql import SQL
from tidemark.sources import months, tables

DATA = "/root/testdata/sf0.001"


def test_views_and_required(spark):
    assert tables.register_views(spark, DATA, ["events", "nothing"]) == ["events"]
    with pytest.raises(ContractError):
        tables.register_views(spark, DATA, ["nothing"], ["nothing"])


def test_a_table_that_cannot_be_read_is_no_absent_one(spark, tmp_path):
    (tmp_path / "broken.parquet").mkdir()
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        tables.register_views(spark, str(tmp_path), ["broken", "nothing"])


def feed(spark, *rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), x) for t, x in rows], "t timestamp, x int")


def values(spark, path, first="2024-01", last="2024-12"):
    return sorted((r["month"], r["x"]) for r in months.read_months(spark, path, first, last).collect())


def test_months_stay_as_first_read_unless_forced(spark, tmp_path):
    path = str(tmp_path / "raw")
    assert months.write_months(feed(spark, ("2024-01-05", 1), ("2024-02-05", 2)), path, "t") == ["2024-01", "2024-02"]
    before = months.manifests(spark, path)
    again = feed(spark, ("2024-02-06", 30), ("2024-03-01", 4), ("2024-03-02", 4))
    assert months.write_months(again, path, "t") == ["2024-03"]
    assert values(spark, path) == [("2024-01", 1), ("2024-02", 2), ("2024-03", 4), ("2024-03", 4)] and values(spark, path, "2024-02", "2024-02") == [("2024-02", 2)]
    now = months.manifests(spark, path)
    assert {k: now[k] for k in before} == before and now["2024-03"]["rows"] == 2
    snapshot = months.read_months(spark, path, "2024-02", "2024-02")
    assert months.write_months(again, path, "t", force=True) == ["2024-02", "2024-03"]
    assert values(spark, path) == [("2024-01", 1), ("2024-02", 30), ("2024-03", 4), ("2024-03", 4)]
    assert [r["x"] for r in snapshot.collect()] == [2]  # a reader that began before the refresh
    assert months.manifests(spark, path)["2024-03"]["checksum"] == now["2024-03"]["checksum"]
    assert months.write_months(again, path, "t") == [] and len(months.remove_old_versions(spark, path)) == 1
    assert values(spark, path)[1] == ("2024-02", 30)
    with pytest.raises(ContractError, match="no month"):
        months.read_months(spark, path, "2025-01", "2025-02")
    with pytest.raises(Exception, match="a row has no t"):
        months.write_months(spark.sql("select cast(null as timestamp) t, 1 x"), path, "t")


def test_frozen_months_are_not_computed_again(spark, tmp_path):
    path = str(tmp_path / "raw")
    months.write_months(feed(spark, ("2024-01-05", 1)), path, "t")
    dear = feed(spark, ("2024-01-05", 1), ("2024-02-05", 2)).withColumn("x", F.when(F.month("t") == 1, F.raise_error(F.lit("fetched")).cast("int")).otherwise(F.col("x")))
    assert months.write_months(dear, path, "t") == ["2024-02"]
    with pytest.raises(Exception, match="fetched"):
        months.write_months(dear, path, "t", force=True)
    assert values(spark, path) == [("2024-01", 1), ("2024-02", 2)]


def test_a_writer_that_dies_before_its_manifest_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    months.write_months(feed(spark, ("2024-01-05", 1)), path, "t")
    with monkeypatch.context() as m:
        m.setattr(months._Folder, "put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            months.write_months(feed(spark, ("2024-01-06", 9), ("2024-02-05", 2)), path, "t", force=True)
    assert values(spark, path) == [("2024-01", 1)]
    assert months.write_months(feed(spark, ("2024-02-05", 2)), path, "t") == ["2024-02"]
    assert len(months.remove_old_versions(spark, path)) == 1 and values(spark, path) == [("2024-01", 1), ("2024-02", 2)]


def test_changed_files_disagree_with_their_manifest(spark, tmp_path):
    path = str(tmp_path / "raw")
    months.write_months(feed(spark, ("2024-01-05", 1), ("2024-02-05", 2)), path, "t")
    assert {r["month"]: r["agrees"] for r in months.verify_months(spark, path).collect()} == {"2024-01": True, "2024-02": True}
    (name,) = months.manifests(spark, path)["2024-02"]["files"]
    spark.sql("select timestamp'2024-02-05' t, 7 x").coalesce(1).write.parquet(str(tmp_path / "other"))
    (part,) = (tmp_path / "other").glob("part-*")
    (tmp_path / "raw" / name).write_bytes(part.read_bytes())
    for crc in (tmp_path / "raw" / name).parent.glob(".*.crc"):
        crc.unlink()
    assert {r["month"]: r["agrees"] for r in months.verify_months(spark, path).collect()} == {"2024-01": True, "2024-02": False}


def scanned_rows(df):
    """Rows that the scan of a plan without a shuffle read from its files."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_clustered_table_is_read_in_part(spark, tmp_path):
    path = str(tmp_path / "clustered")
    df = spark.range(64_000).select(((F.col("id") * 7919) % 64_000).alias("x")).withColumn("t", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("x") * 60))
    tables.write_clustered(df, path, "t", ["x"], files=16, most_rows=3000)
    back = spark.read.parquet(path)
    assert back.exceptAll(df).count() == 0 and back.count() == 64_000
    sizes = back.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("a").collect()
    assert len(sizes) > 16 and max(r["n"] for r in sizes) <= 3000
    assert all(a["b"] < b["a"] for a, b in zip(sizes, sizes[1:]))  # no two files share a time
    part = back.filter(F.col("t").between(sizes[5]["a"], sizes[5]["b"]))
    assert part.count() == sizes[5]["n"] and scanned_rows(part.select("x")) <= 3 * 3000
    shuffled = str(tmp_path / "plain")
    df.repartition(16).write.parquet(shuffled)
    assert scanned_rows(spark.read.parquet(shuffled).filter(F.col("t").between(sizes[5]["a"], sizes[5]["b"])).select("x")) > 30_000


def test_many_files_and_reports(spark, tmp_path):
    for name, x in (("a_2023", 1), ("b_2024", 2), ("c_2024_draft", 3)):
        spark.createDataFrame([(x,)], "x int").coalesce(1).write.parquet(str(tmp_path / name))
        (part,) = (tmp_path / name).glob("part-*")
        part.rename(tmp_path / f"{name}.parquet")
    got = tables.read_many(spark, str(tmp_path / "*.parquet"), exclude=["draft", "2023"]).collect()
    assert [r["x"] for r in got] == [2]
    report = spark.createDataFrame([("rows", 5.0), ("missing", None)], "check string, value double")
    tables.write_report(report, str(tmp_path / "report"))
    tables.write_report(report, str(tmp_path / "report"))
    assert {r["check"]: r["value"] for r in spark.read.schema(report.schema).json(str(tmp_path / "report")).collect()} == {"rows": 5.0, "missing": None}


def test_envelopes_and_sql_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": {"records": [{"_id": 1, "v": 2.5}]}}))
    (tmp_path / "b.json").write_text(json.dumps([{"_id": 2, "v": 3.5}]))
    got = tables.read_envelopes(spark, str(tmp_path / "*.json"), "_id: int, v: double", "result.records")
    assert got.columns == ["v"] and sorted(r["v"] for r in got.collect()) == [2.5, 3.5]
    (tmp_path / "q.sql").write_text("select :n + 1 as m")
    assert tables.query_file(spark, str(tmp_path / "q.sql"), n=4).first()["m"] == 5


@pytest.mark.parametrize("name", ["asof_purchase_view", "clean_pass", "grid_periods_per_day", "block_bootstrap_ci", "score_table", "strategy_table", "outturn_report", "suspect_block_ratios", "suspect_block_windows", "provider_comparison"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("orders", "events"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(SQL[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, DATA).select(*cols).collect()
    plain = lambda rows: sorted(tuple("-" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got) == plain(c.sql(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({SQL[name]})").fetchall())


def test_contract_of_the_driver(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(QUERIES)
    assert F.lit(1) is not None
