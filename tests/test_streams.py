"""Streams drained from several files against the batch operators on the same rows."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from funnelwright.operators import sessions as X
from funnelwright.streaming import streams as R


@pytest.fixture(scope="module")
def folder(spark):
    """Three files with copies across files and one event arriving seven hours late."""
    ts = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    kinds = ["view", "click", "signup", "purchase", "error"]
    rows = [(i, ts(i * 0.7), i % 4, kinds[i % 5], float(i % 50), "{}") for i in range(200)]
    out = tempfile.mkdtemp(prefix="funnelwright-test-")
    parts = [rows[:70], rows[70:140] + rows[60:70], rows[140:] + [(500, ts(140 * 0.7 - 7), 1, "view", 1.0, "{}")]]
    for i, p in enumerate(parts):
        spark.createDataFrame(p, R.EVENT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{out}/part{i}.parquet")
    return out


def stream(spark, folder):
    return R.read_events(spark, f"{folder}/*.parquet", "part-*", files_per_trigger=1)


def batch(spark, folder):
    return spark.read.parquet(f"{folder}/*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(spark, folder, **late):
    """What the watermark has passed when all files are read."""
    return batch(spark, folder).agg(F.max("ts")).first()[0] - dt.timedelta(**late)


def test_panel_counts(spark, folder, rows):
    got = R.run_available(R.stream_funnel_panel(stream(spark, folder)))
    want = batch(spark, folder).groupBy(F.to_date("ts").alias("dt")).agg(F.count_distinct("user_id").alias("uv_all"), F.count(F.when(F.col("event_type") == "view", 1)).alias("exp_pv"))
    done = want.where(F.col("dt") < F.lit(closed(spark, folder, days=1).date()))
    assert rows(got, "dt", "uv_all", "exp_pv") == rows(done) and 2 <= done.count() < want.count()


def test_days_are_given_out_once_and_forgotten(spark, tmp_path):
    """Ten days in ten files: state holds the open days only, and each day comes with the batch that closes it."""
    day = lambda d: [(1000 * d + i, dt.datetime(2024, 1, 1 + d) + dt.timedelta(minutes=i), i, "view", 1.0, "{}") for i in range(300)]
    for d in range(10):
        spark.createDataFrame(day(d), R.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part{d}.parquet")
    seen = []
    got = R.run_available(R.stream_funnel_panel(R.read_events(spark, f"{tmp_path}/*.parquet", "part-*", files_per_trigger=1)), progress=seen)
    assert sorted((r.dt.day, r.uv_all) for r in got.collect()) == [(d, 300) for d in range(1, 9)]
    assert got.groupBy("batch_id").count().agg(F.max("count")).first()[0] <= 2
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in seen]
    assert max(held) <= 3 * 300 + 10 and held[-1] <= 2 * 300 + 5


def test_sessions(spark, folder, rows):
    got = R.run_available(R.stream_sessions(stream(spark, folder), "150 minutes", "2 days"))
    ends = batch(spark, folder).groupBy("user_id", F.session_window("ts", "150 minutes").alias("w")).agg(F.count("*").alias("events"))
    done = ends.where(F.col("w.end") <= F.lit(closed(spark, folder, days=2))).select("user_id", "w.start", "events")
    every = X.session_windows(batch(spark, folder), "user_id", "ts", "150 minutes")
    assert rows(got, "user_id", "session_start", "events") == rows(done) and 0 < done.count() < every.count()
    assert set(rows(done)) <= set(rows(every))


def test_visits_from_keyed_state(spark, folder, rows):
    """Files in order with a late event: visits as the batch sessions, with the furthest stage, and none left open behind."""
    seen = []
    own = R.with_keyed_state(spark)
    got = R.run_available(R.stream_visits(stream(own, folder), 9_000, "2 days"), progress=seen)
    stage = F.when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "view", 1).otherwise(0)
    g = batch(spark, folder).groupBy("user_id", F.session_window("ts", "9000 seconds").alias("w")).agg(F.min("ts").alias("s"), F.max("ts").alias("e"), F.count("*").alias("events"), F.max(stage).alias("furthest"))
    done = g.where(F.col("w.end") <= F.lit(closed(spark, folder, days=2))).drop("w")
    assert rows(got, "user_id", "visit_start", "visit_end", "events", "furthest") == rows(done) and done.count() > 5


def test_dedup(spark, folder):
    got = R.run_available(R.stream_dedup(stream(spark, folder), "3 days"))
    assert got.count() == batch(spark, folder).select("event_id").distinct().count() == 201


def test_checks_per_batch(spark, folder):
    from funnelwright.operators import checks as V

    got = R.run_available(stream(spark, folder), lambda b: V.scan_checks(b, [V.row_count(1), V.value_range("value", 0, 40)]))
    assert got.select("batch_id").distinct().count() == 3
    assert got.where("check = 'row_count'").agg(F.sum("observed")).first()[0] == 211
    assert got.where("check = 'range'").agg(F.sum("n_bad")).first()[0] == batch(spark, folder).where("value > 40").count()


def test_sliding_rate(spark, folder):
    log = stream(spark, folder).where("event_type = 'error'")
    got = {r["week_start"]: r["n"] for r in R.run_available(R.stream_rate(log, "event_type")).collect()}
    errors = batch(spark, folder).where("event_type = 'error'")
    days = [r["d"] for r in errors.select(F.to_date("ts").alias("d")).collect()]
    last = errors.agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    starts = [min(days) + dt.timedelta(k) for k in range(-6, 10)]
    assert got == {s: n for s in starts if s + dt.timedelta(7) <= last.date() and (n := sum(s <= d < s + dt.timedelta(7) for d in days))}


def test_panel_to_the_end(spark, folder, rows):
    """The last days too, each day once, whatever file closes it."""
    got = R.run_to_end(stream(spark, folder), R.stream_funnel_panel)
    want = batch(spark, folder).groupBy(F.to_date("ts").alias("dt")).agg(F.count_distinct("user_id").alias("uv_all"), F.count(F.when(F.col("event_type") == "view", 1)).alias("exp_pv"))
    assert rows(got, "dt", "uv_all", "exp_pv") == rows(want)


def test_stage_counts_cover_every_event(spark, tmp_path):
    import __spark_entry__ as entry

    table = [(i, dt.datetime(2024, 1, 1 + i // 2, 23), i, "view", 1.0, "{}") for i in range(8)]
    spark.createDataFrame(table, R.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "events.parquet")
    got = entry.queries()["r01_stream_stage_counts"](spark, str(tmp_path)).collect()
    assert sorted((r.dt.day, r.exp_pv) for r in got) == [(1, 2), (2, 2), (3, 2), (4, 2)]


def test_sessions_to_the_end(spark, folder, rows):
    """Sessions still open after the last event are given out as well; the closing row makes none."""
    got = R.run_to_end(stream(spark, folder), lambda e: R.stream_sessions(e, "150 minutes", "2 days"))
    every = X.session_windows(batch(spark, folder), "user_id", "ts", "150 minutes")
    assert rows(got, "user_id", "session_start", "events") == rows(every.select("user_id", "session_start", "events"))


def test_session_query_covers_every_event(spark, tmp_path):
    import __spark_entry__ as entry

    table = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i), i % 2, "view", 1.0, "{}") for i in range(9)]
    spark.createDataFrame(table, R.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "events.parquet")
    got = entry.queries()["r02_stream_sessions"](spark, str(tmp_path)).collect()
    assert sorted((r.user_id, r.events) for r in got) == [(0, 5), (1, 4)]


def test_sliding_rate_to_the_end(spark, folder):
    """Every window with an entry, those still open after the last entry too."""
    log = stream(spark, folder).where("event_type = 'error'")
    got = {r["week_start"]: r["n"] for r in R.run_to_end(log, lambda e: R.stream_rate(e, "event_type")).collect()}
    days = [r["d"] for r in batch(spark, folder).where("event_type = 'error'").select(F.to_date("ts").alias("d")).collect()]
    starts = [min(days) + dt.timedelta(k) for k in range(-6, 12)]
    assert got == {s: n for s in starts if (n := sum(s <= d < s + dt.timedelta(7) for d in days))}


def test_rate_query_covers_every_error(spark, tmp_path):
    import __spark_entry__ as entry

    table = [(i, dt.datetime(2024, 1, 1 + i), 4, "error", 1.0, "{}") for i in range(3)]
    spark.createDataFrame(table, R.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "events.parquet")
    got = entry.queries()["r05_stream_rate"](spark, str(tmp_path)).collect()
    assert len(got) == 9 and sum(r.n for r in got) == 21


def test_visits_read_state_once_a_user(spark, tmp_path):
    """A user with 200 visits in one batch holds one timer, not one a visit, and gives out the same visits."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * (i // 2), minutes=i % 2), 7, "view" if i % 2 else "signup", 1.0, "{}") for i in range(400)]
    spark.createDataFrame(rows[::-1] + [(400, None, 7, "view", 1.0, "{}")], R.EVENT_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/part0.parquet")
    seen = []
    got = R.run_available(R.stream_visits(R.read_events(R.with_keyed_state(spark), f"{tmp_path}/*.parquet", "part-*"), 3600), progress=seen)
    assert sorted((r.visit_start, r.visit_end, r.events, r.furthest) for r in got.collect()) == [(rows[i][1], rows[i + 1][1], 2, 3) for i in range(0, 398, 2)]
    assert 1 <= sum(o["customMetrics"]["numRegisteredTimers"] for p in seen for o in p["stateOperators"]) <= 4
