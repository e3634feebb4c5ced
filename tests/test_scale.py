"""Operators on one key or value that holds most rows, and on graphs and texts that grow."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from funnelwright.operators import aggregates as A
from funnelwright.operators import findings as L
from funnelwright.operators import ordered as O
from funnelwright.operators import profile as B
from funnelwright.operators import relations as R
from funnelwright.operators import sessions as X
from funnelwright.operators import stats as D


def test_interval_join_of_a_hot_key(spark, rows):
    """Half the facts and 10,000 spans on one key: cut at its own quantiles, every hit once, none lost."""
    rnd = random.Random(3)
    base = 1_704_067_200
    facts = [(i, "hot" if i % 2 else f"k{i % 40}", base + rnd.randrange(100_000)) for i in range(20_000)]
    spans = [(j, "hot" if j % 11 else f"k{j % 40}", base + (s := rnd.randrange(100_000)), None if j % 997 == 0 else base + s + rnd.choice([0, 5, 30])) for j in range(11_000)]
    f = spark.createDataFrame(facts, "id long, k string, s long").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    s = spark.createDataFrame(spans, "sid long, k string, a long, b long").select("sid", "k", F.timestamp_seconds("a").alias("t0"), F.timestamp_seconds("b").alias("t1"))
    want = f.join(s, "k").where("ts >= t0 and (t1 is null or ts <= t1)").groupBy("id").agg(F.count("*").alias("n"), F.sum("sid").alias("t"))
    for size in (1_000, 1_000_000):
        got = R.interval_join(f, s, ["k"], "ts", "t0", "t1", bucket_rows=size)
        assert rows(got.groupBy("id").agg(F.count("*").alias("n"), F.sum("sid").alias("t"))) == rows(want)
        left = R.interval_join(f, s, ["k"], "ts", "t0", "t1", how="left", bucket_rows=size)
        assert left.select("id").distinct().count() == 20_000 and left.where("sid is null").count() == 20_000 - want.count()
    anti = R.interval_join(f, s, ["k"], "ts", "t0", "t1", how="left_anti", bucket_rows=1_000)
    assert anti.count() == 20_000 - want.count() and anti.columns == ["id", "k", "ts"]


def test_ancestors_of_many_readers_and_writers(spark):
    """Thousands of steps write and read one table: pairs of steps would be millions, each link is followed once."""
    n = 4_000
    log = [(f"w{i}", ["raw"], ["shared"]) for i in range(n)] + [(f"r{i}", ["shared"], [f"o{i}"]) for i in range(n)] + [("last", ["o1", "o2"], ["end"]), ("loop", ["end"], ["raw"])]
    df = spark.createDataFrame(log, "step string, inputs array<string>, outputs array<string>")
    got = {r.step: r.depth for r in L.lineage_ancestors(df, spark.createDataFrame([("last",)], "step string")).collect()}
    assert got == {"last": 0, "r1": 1, "r2": 1, **{f"w{i}": 2 for i in range(n)}, "loop": 3}


def test_long_values_are_not_shuffled(spark):
    """Distinct and frequent values of long texts: exact, from digests of a few bytes."""
    text = "x" * 4_000
    df = spark.range(4_000).select(F.when(F.col("id") % 4 == 0, F.lit(text + "a")).otherwise(F.concat(F.lit(text), (F.col("id") % 500).cast("string"))).alias("t"), F.when(F.col("id") < 9, F.lit("few")).alias("u"))
    assert {r.column_name: r.n_unique for r in B.distinct_counts(df, ["t", "u"]).collect()} == {"t": 376, "u": 1}
    top = B.top_values(df, ["t", "u"], 2).collect()
    assert [(r.column_name, r.n, r.value) for r in top if r["rank"] == 1 and r.column_name == "t"] == [("t", 1_000, text + "a")]
    assert [(r.n, r.share, r.dominant, r.value) for r in top if r.column_name == "u"] == [(9, 1.0, True, "few")]
    v = B.value_digests(df, ["t"], B.HEAD)
    assert v.agg(F.max(F.length("head"))).first()[0] == B.HEAD and "t" not in v.columns


def test_overlaps_beyond_the_next_session(spark):
    """A long session on one device overlaps the next one and the one after it."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    data = [(1, "a", 0, 10), (1, "b", 1, 2), (1, "b", 3, 4), (1, "a", 11, 12), (2, "a", 0, 1), (2, "b", 1, 2), (3, "a", 5, 5), (3, "b", 5, 5)]
    s = spark.createDataFrame([(u, d, at(x), at(y)) for u, d, x, y in data], "user_id long, device string, session_start timestamp, session_end timestamp")
    e = s.select("user_id", "device", F.col("session_start").alias("ts"), F.monotonically_increasing_id().alias("event_id"))
    got = {r.check: r.observed for r in X.event_quality(e, s, "event_id", "user_id", "device", "ts", (2,)).collect()}
    assert got["overlapping_sessions"] == 2.0


def unbroadcast(spark, monkeypatch, make):
    """Rows and plan of a query while the planner may not broadcast on its own."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        return sorted(map(repr, df.collect())), df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantiles_do_not_sort_a_key(spark, monkeypatch):
    """No join sorts the rows of a key, whether its brackets are sent or hashed; null keys keep their quantiles."""
    df = spark.range(30_000).select(F.when(F.col("id") % 5 > 0, F.lit("hot")).when(F.col("id") % 10 > 0, F.lit("k")).alias("k"), (F.col("id") * 7919 % 30_011).cast("double").alias("v"))
    make = lambda: O.quantiles(df, ["k"], "v", {"a": 0.25, "m": 0.5}, accuracy=100)
    want = sorted(map(repr, df.groupBy("k").agg(F.percentile("v", F.lit(0.25)).alias("a"), F.percentile("v", F.lit(0.5)).alias("m")).collect()))
    for most in (10_000, 0):
        monkeypatch.setattr(O, "FEW_KEYS", most)
        got, plan = unbroadcast(spark, monkeypatch, make)
        assert got == want and len(got) == 3 and "SortMergeJoin" not in plan


def test_rank_test_does_not_sort_a_group(spark, monkeypatch):
    """Two groups of many rows: medians without a join that sorts a group's rows."""
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"), (F.col("id") * 31 % 997).cast("double").alias("v"))
    got, plan = unbroadcast(spark, monkeypatch, lambda: D.mann_whitney(df, "g", "v", "a", "b").select("median_a", "median_b"))
    want = df.groupBy().agg(F.percentile(F.when(F.col("g") == "a", F.col("v")), F.lit(0.5)).alias("median_a"), F.percentile(F.when(F.col("g") == "b", F.col("v")), F.lit(0.5)).alias("median_b"))
    assert got == sorted(map(repr, want.collect())) and "SortMergeJoin" not in plan


def test_rank_test_with_p_does_not_sort_a_group(spark, monkeypatch):
    df = spark.range(5_000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"), (F.col("id") * 31 % 997).cast("double").alias("v"))
    got, plan = unbroadcast(spark, monkeypatch, lambda: D.with_normal_p(D.mann_whitney(df, "g", "v", "a", "b")))
    assert len(got) == 1 and "SortMergeJoin [coalesce(g#" not in plan


def test_running_gives_each_range_its_task(spark, monkeypatch):
    """More rows than a range should hold: as many ranges as they ask for, and no two of them in one task."""
    df = spark.range(6_000).select("id", (F.col("id") * 7919 % 6_007).alias("x"))
    monkeypatch.setattr(O, "TARGET_ROWS", 100)
    got = O.running(df, [], ["x"], sums={"cum": "id"}, previous={"prev": "x"}, row_number="rn")
    most = got.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 300 and got.agg(F.max("rn"), F.max("cum")).first() == (6_000, sum(range(6_000)))
    assert got.where("prev is null").count() == 1 and got.where("prev >= x").count() == 0


@pytest.mark.parametrize("make", [D.mann_whitney, lambda *a: D.with_normal_p(D.mann_whitney(*a))], ids=["d06_mann_whitney", "d06_mann_whitney_p"])
def test_rank_test_of_many_values(spark, monkeypatch, make):
    """Nearly every row a value of its own: ranked in as many tasks as they ask for, with the same result."""
    df = spark.range(4_000).select(F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 9 > 0, "b").alias("g"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 3_989 / 7).alias("v"))
    want, _ = unbroadcast(spark, monkeypatch, lambda: make(df, "g", "v", "a", "b"))
    monkeypatch.setattr(O, "TARGET_ROWS", 100)
    got, plan = unbroadcast(spark, monkeypatch, lambda: make(df, "g", "v", "a", "b"))
    values = df.where("g is not null and v is not null").select("v").distinct().count()
    assert got == want and len(got) == 1 and f", {-(-values // 100)})" in "".join(x for x in plan.splitlines() if "shufflepartitionid" in x)


def test_overall_is_dealt_by_rows(spark, rows, monkeypatch):
    """More rows than the partitions should hold: dealt into more, with the same counts, for null members and entities too."""
    df = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, "f").alias("f"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("m"), F.col("id") % 4)).alias("m"), F.when(F.col("id") % 11 > 0, F.col("id") % 300).alias("e"), F.col("id").cast("double").alias("q"))
    make = lambda: A.with_overall(df, ["f"], "m", "name", "e", {"q": "q"})
    want = rows(make())
    monkeypatch.setattr(A, "ROWS_EACH", 100)
    got = make()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got) == want and "RepartitionByExpression" in plan and ", 20" in plan
