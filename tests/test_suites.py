"""Suites with every rule configured, edge cases of names, lineage, text forms and metric arithmetic."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from funnelwright.functions import scalars as S
from funnelwright.operators import checks as V, findings as L, growth as G, profile as B, relations as R, stats as D, text as N


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(k, k % 5, ["web", "app", None][k % 3] if k < 8 else "web", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k), 10.0) for k in range(20)]
    return spark.createDataFrame(rows, "id int, user int, channel string, day date, paid double, seen double")


def by(df):
    return {(r["check"], r["subject"]): r for r in df.collect()}


def test_structural_suite(spark, orders):
    users = spark.createDataFrame([(k,) for k in range(4)], "u int")
    got = by(V.run_structural(
        orders, ["id"], schema={"id": "int", "gone": "string"}, dates={"day": ("2024-01-03", None)}, days={"day": ("2024-01-01", "2024-01-20", 1)},
        parents=[("user", users, "u")], domains={"channel": ["web", "app", "shop"]},
    ))
    assert got["schema_missing", "gone"].severity == V.BLOCKER and got["primary_key", "id"].ok
    assert got["date_bounds", "day"].n_bad == 2 and got["date_range", "day"].ok
    assert got["referential", "user->u"].n_bad == 4 and got["domain", "channel"].severity == V.WARNING
    assert got["completeness", "channel"].n_bad == 2 and got["row_count", "rows"].observed == 20


def test_logical_suite(spark, orders):
    summary = orders.groupBy("channel").agg(F.sum("paid").alias("paid"), F.min("id").alias("n")).withColumn("share", F.lit(50.0))
    got = by(V.run_logical(
        orders, summary, ["channel"], "paid", "n", percents={"share": []}, monotonic={"n": True}, spikes={"paid": (1, 3.0)},
        ratios=[("paid", "seen", 0.0, 1.0)], not_after={"day": "2024-01-18"},
    ))
    assert got["ratio_bounds", "paid/seen"].n_bad == 9 and got["future_dates", "day"].n_bad == 2
    assert got["pct_sum", "share"].severity == V.BLOCKER and got["monotonic", "n"].ok and ("spikes", "paid") in got
    assert got["exhaustive", "channel"].severity == V.BLOCKER and got["aggregation", "paid"].ok


def test_business_suite(spark):
    df = spark.createDataFrame([(1, 0.5, 100.0, 10.0, 10.0), (2, 1.5, -50.0, 5.0, 10.0), (3, 0.1, 900.0, 9.0, 90.0)], "t int, churn_rate double, revenue double, orders double, aov double")
    got = by(V.run_business(df, cardinality={"t": (1, 2)}, changes={"orders": ("t", 60.0)}, relations=[("aov * orders", "revenue", 0.01)]))
    assert got["range", "churn_rate"].n_bad == 1 and got["non_negative", "revenue"].n_bad == 1
    assert not got["cardinality", "t"].ok and got["period_change", "orders"].n_bad == 1
    assert got["metric_relation", "aov * orders = revenue"].n_bad == 2


def test_close_names_in_the_first_letters(spark):
    asked = spark.createDataFrame([("rvenue",), ("xevenue",), ("venue",), ("a",), ("",), ("zzzzzzz",)], "q string")
    names = spark.createDataFrame([("revenue",), ("venue",), ("avenue",), ("b",), ("ab",)], "n string")
    got = {}
    for r in R.close_names(asked, "q", names, "n", 2).collect():
        got.setdefault(r.q, []).append((r["rank"], r.suggestion, r.distance))
    assert sorted(got["xevenue"]) == [(1, "revenue", 1), (2, "avenue", 2), (3, "venue", 2)]
    assert sorted(got["rvenue"]) == [(1, "avenue", 1), (2, "revenue", 1), (3, "venue", 1)]
    assert sorted(got["venue"])[0] == (1, "venue", 0) and sorted(got["a"])[0] == (1, "ab", 1)
    assert sorted(got[""]) == [(1, "b", 1), (2, "ab", 2)] and "zzzzzzz" not in got


def test_deep_lineage(spark):
    e = spark.createDataFrame([(str(k), str(k + 1)) for k in range(105)], "child string, parent string")
    got = {r["step"]: r["depth"] for r in L.lineage_ancestors(e, spark.createDataFrame([("0",)], "step string")).collect()}
    assert got == {str(k): k for k in range(106)}


def test_long_contrasts(spark):
    long = "word " * 60
    d = spark.createDataFrame([(1, f"It is not {long}, but good."), (2, f"Not only {long}this but that."), (3, "Not only this. But that.")], "id int, text string")
    got = {r.id: (r.not_x_its_y, r.not_only) for r in N.contrast_patterns(d, "text", ["id"]).collect()}
    assert got[1][0] == 1 and got[2][1] == 1 and got[3] == (0, 0)


def test_small_importance(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.lit(1.0).alias("z"))
    got = D.feature_importance(df, "y", ["x", "z"]).collect()
    assert [r.feature for r in got] == ["x", "z"] and got[0].importance > 0.9 and not got[0].advised


def test_metric_arithmetic(spark):
    df = spark.createDataFrame([(6.0, 3.0, 0.0), (8.0, 2.0, 2.0)], "a double, b double, c double")
    take = lambda e: [r[0] for r in df.select(S.metric_expr(e, ["a", "b", "c"]).alias("x")).collect()]
    assert take("a / b / c") == [None, 2.0] and take("(a + b) / (b - c)") == [3.0, None] and take("-a * 2 + 1.5") == [-10.5, -14.5]
    for bad in ("a + d", "a ** b", "abs(a)", "a if b else c", "'x'"):
        with pytest.raises(ValueError):
            S.metric_expr(bad, ["a", "b", "c"])


def test_parse_and_cells(spark):
    df = spark.createDataFrame([("1.5%",), ("4,500,000",), ("-",), ("",), (None,), ("x",), ("-3",)], "t string")
    assert [r[0] for r in df.select(S.parse_percent("t")).collect()] == [0.015, 4500000.0, None, None, None, None, -3.0]
    cell = df.select(S.fmt_cell(F.lit(None).cast("string"), F.lit(1.0)).alias("a"), S.fmt_cell(F.lit("7"), F.lit(None).cast("double")).alias("b"), S.fmt_cell_dual(F.lit("7"), F.lit(1.0), F.lit(None).cast("double")).alias("c")).first()
    assert tuple(cell) == ("-", "7", "7 (+1.00%｜-)")


def test_churn_has_every_month(spark):
    d = dt.date
    spans = spark.createDataFrame([("p", d(2024, 1, 5), None), ("p", d(2024, 1, 9), d(2024, 4, 2))], "plan string, s date, e date")
    got = [(r.month.month, r.active_at_start, r.ended) for r in G.churn_rate(spans, "plan", "s", "e").orderBy("month").collect()]
    assert got == [(1, 0, 0), (2, 2, 0), (3, 2, 0), (4, 2, 1)]


def test_name_candidates(spark):
    schemas = {"user": ["id", "name"], "orders": ["orders_id", "user_id", "status", "big_order_id"], "statuses": ["id"], "vip_users": ["id"], "status": ["status_id"]}
    got = {tuple(r) for r in B.name_candidates(spark, schemas).collect()}
    assert ("orders", "user_id", "user", "id", 0.8) in got and ("orders", "user_id", "vip_users", "id", 0.5) in got
    assert ("orders", "status", "status", "status_id", 0.4) in got and not any(r[0] == r[2] for r in got)


def test_clean_keeps_the_smallest(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, "a", 3), (2, None, 1), (None, "z", 0)], "k int, v string, n int")
    got = {tuple(r) for r in B.clean(df, ["k"], ["k"], {"v": "?"}, {}).collect()}
    assert got == {(1, "a", 3), (2, "?", 1)}


def test_chinese_forms(spark):
    d = spark.createDataFrame([(1, "这不仅是一次升级，更是跃迁。既快又稳。不是终点，而是起点。高效、便捷、智能。"), (2, "为后续增长奠定了坚实基础。由于网络的原因。发挥了关键作用，推动了业务的发展。"), (3, "The real story is here, no guessing.")], "id int, text string")
    c = {r.id: r for r in N.contrast_patterns(d, "text", ["id"]).collect()}
    assert (c[1].zh_not_only, c[1].zh_not_but, c[1].zh_both, c[1].zh_triple) == (1, 1, 1, 1) and (c[3].the_real_is, c[3].tailing_no) == (1, 1)
    z = {r.id: r for r in N.zh_patterns(d, "text", ["id"]).collect()}
    assert (z[2].foundation, z[2].because_of, z[2].role, z[2].development) == (1, 1, 1, 1) and sum(z[1][1:]) == 0
