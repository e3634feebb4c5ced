"""Readers, writers, templates, samples."""

import json

from pyspark.sql import functions as F

from funnelwright.sources import io

SF = "/root/testdata/sf0.001"


def test_csv_and_parquet_round_trip(spark, tmp_path, rows):
    df = io.read_source(spark, f"{SF}/supplier.parquet")
    io.write_csv(df, str(tmp_path / "s.csv"))
    io.write_parquet(df, str(tmp_path / "s.parquet"), ["s_nationkey"])
    assert rows(io.read_source(spark, str(tmp_path / "s.csv"), df.schema)) == rows(df)
    assert rows(io.read_source(spark, str(tmp_path / "s.parquet")).select(*df.columns)) == rows(df)
    assert dict(io.read_source(spark, str(tmp_path / "s.csv")).dtypes)["s_acctbal"] == "double"


def test_jsonl_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps({"timestamp": "2024-01-01", "query": "q", "miss_type": t, "details": None}) for t in "aab"))
    assert {r["miss_type"]: r["count"] for r in io.read_jsonl_log(spark, str(tmp_path / "log.jsonl")).groupBy("miss_type").count().collect()} == {"a": 2, "b": 1}


def test_sample_is_stable_under_partitioning(spark, rows):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    a, b = io.sample_rows(o, 50, "o_orderkey"), io.sample_rows(o.repartition(7), 50, "o_orderkey")
    assert rows(a, "o_orderkey") == rows(b, "o_orderkey") and a.count() == 50


def test_fallback(spark):
    a, b = spark.range(0).toDF("x"), spark.range(3).toDF("x")
    assert io.coalesce_source(a, b).first()["source_used"] == "fallback"
    assert io.coalesce_source(b, a).first()["source_used"] == "primary"
    assert io.coalesce_source(None, b).count() == 3


def test_views_and_template(spark):
    io.read_tables(spark, SF, ["nation"])
    assert "nation" in [r["table_name"] for r in io.list_tables(spark).collect()]
    assert io.run_template(spark, "select count(*) n from identifier(:t) where n_regionkey = :r", {"t": "nation", "r": 1}).first()["n"] == 5


def test_range_filter_reaches_the_files(spark):
    o = io.range_scan(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderdate", "1997-02-01", "1997-02-28").select("o_orderkey")
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan and "o_totalprice" not in plan
