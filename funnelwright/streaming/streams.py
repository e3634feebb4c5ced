"""Structured Streaming forms of the panel, sessions, dedup, checks and rates.

Every function maps a streaming DataFrame to a streaming DataFrame; :func:`run_available` drains a source
into files that a batch query can read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from funnelwright.session import scratch_folder

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_events(spark: SparkSession, folder: str, file_glob: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """File stream of events with a zoned timestamp, which watermarks require."""
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_funnel_panel(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Stage counts and exact distinct users of each day, given out when the watermark closes the day.

    State is one row per open day and user, then one per open day; both go when the day is given out.
    """
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    day = F.window("ts", "1 day")
    user = events.withWatermark("ts", late).groupBy(day.alias("window"), "user_id").agg(n("view").alias("v"), n("click").alias("c"), n("signup").alias("s"), n("purchase").alias("p"))
    g = user.groupBy(F.window(F.window_time("window"), "1 day").alias("day")).agg(
        F.count("user_id").alias("uv_all"), F.sum("v").alias("exp_pv"), F.sum("c").alias("detail_pv"), F.sum("s").alias("order_pv"), F.sum("p").alias("pay_pv")
    )
    return g.select(F.to_date("day.start").alias("dt"), "uv_all", "exp_pv", "detail_pv", "order_pv", "pay_pv")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by a pause, each given out once, when the watermark has passed its end; its state goes with it."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


VISITS = "user_id long, visit_start timestamp, visit_end timestamp, events long, furthest int"
STAGES = ("view", "click", "signup", "purchase")


def stream_visits(events: DataFrame, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Visits with the furthest funnel stage reached, from keyed state with event-time timers.

    A user's open visits are one list in state; a batch's events, in order, join or merge the visits within the pause.
    One timer a user, at the end of the visit that ends first, gives out and removes all that have ended, so state holds
    open visits only and is read and written once a user and batch, not once a visit. Events without a time are left out. Needs the RocksDB state store
    (:func:`with_keyed_state`).
    """
    stage = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in STAGES]), F.col("event_type")), F.lit(0)).cast("int")
    x = events.withWatermark("ts", late).where("ts is not null").select("user_id", "ts", stage.alias("stage"))
    return x.groupBy("user_id").transformWithState(statefulProcessor=_visits(gap_seconds), outputStructType=VISITS, outputMode="append", timeMode="eventTime")


def _visits(gap_seconds: int):
    import datetime as dt

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    gap = gap_seconds * 1_000_000
    epoch = dt.datetime(1970, 1, 1)
    micros = lambda t: (t.replace(tzinfo=None) - epoch) // dt.timedelta(microseconds=1)
    moment = lambda us: epoch + dt.timedelta(microseconds=us)

    class Visits(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "visits array<struct<first: long, last: long, events: long, furthest: int>>")

        def held(self) -> list[tuple[int, int, int, int]]:
            return [tuple(v) for v in self.open.get()[0]] if self.open.exists() else []

        def hold(self, visits: list[tuple[int, int, int, int]]) -> None:
            self.open.update((visits,))
            self.handle.registerTimer(min((last + gap) // 1000 for _, last, _, _ in visits))

        def handleInputRows(self, key, rows, timerValues):
            # Visits and events by their first moment: one sweep joins whatever begins within the pause of what ended last.
            moments = [(at, at, 1, r.stage) for r in rows for at in (micros(r.ts),)]
            kept = []
            for first, last, n, furthest in sorted(self.held() + moments):
                if kept and first < kept[-1][1] + gap:
                    a, b, m, f = kept[-1]
                    kept[-1] = (a, max(b, last), m + n, max(f, furthest))
                else:
                    kept.append((first, last, n, furthest))
            self.hold(kept)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # The timer of a visit that went on may come early; the first one of a batch gives out all that has ended.
            passed = timerValues.getCurrentWatermarkInMs()
            visits = self.held()
            ended = [v for v in visits if (v[1] + gap) // 1000 <= passed]
            if left := [v for v in visits if (v[1] + gap) // 1000 > passed]:
                self.hold(left)
            elif visits:
                self.open.clear()
            for first, last, n, furthest in ended:
                yield Row(user_id=key[0], visit_start=moment(first), visit_end=moment(last), events=n, furthest=furthest)

        def close(self) -> None:
            pass

    return Visits()


def with_keyed_state(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, which keyed state needs."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def stream_dedup(events: DataFrame, late: str = "1 day") -> DataFrame:
    """First copy of each event id among those within the watermark of each other."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def stream_rate(log: DataFrame, kind: str, late: str = "1 day") -> DataFrame:
    """Entries per day by type over a sliding week."""
    g = log.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), kind).agg(F.count("*").alias("n"))
    return g.select(F.to_date("window.start").alias("week_start"), kind, "n", (F.col("n") / 7.0).alias("per_day"))


def work_folder(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach."""
    return scratch_folder(spark, "stream")


def run_available(stream: DataFrame, each: Callable[[DataFrame], DataFrame] | None = None, progress: list | None = None) -> DataFrame:
    """Process what the source holds and return what was given out, with the batch's number as ``batch_id``.

    Every batch lands in a folder of its own, so a batch that is replayed after a failure overwrites itself and a
    reader never meets a folder that is being replaced. ``progress`` receives the query's progress reports.
    """
    folder = work_folder(stream.sparkSession)
    _drain(stream, folder, each, progress)
    return stream.sparkSession.read.parquet(f"{folder}/out")


# Later than any event, with room for the windows after it.
END = "timestamp_seconds(1000000000000)"


def run_to_end(events: DataFrame, plan: Callable[[DataFrame], DataFrame], ts: str = "ts", progress: list | None = None) -> DataFrame:
    """What ``plan(events)`` gives out for all that the source holds, with the windows still open after the last event.

    When the source is drained, the query goes on from its checkpoint with one row more that has nothing but a time
    after all others. It moves the watermark past every window, so each is given out once and its state goes; its own
    window stays open. An event without a time is in no window.
    """
    spark = events.sparkSession
    folder = work_folder(spark)
    row = lambda n: spark.range(n).select(*[(F.expr(END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    row(0).write.parquet(f"{folder}/end")
    stream = plan(events.unionByName(spark.readStream.schema(row(0).schema).parquet(f"{folder}/end")))
    _drain(stream, folder, None, progress)
    row(1).coalesce(1).write.mode("append").parquet(f"{folder}/end")
    _drain(stream, folder, None, progress)
    return spark.read.parquet(f"{folder}/out")


def _drain(stream: DataFrame, folder: str, each: Callable[[DataFrame], DataFrame] | None, progress: list | None) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{folder}/out/batch_id={batch_id}")

    q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if progress is not None:
        progress.extend(q.recentProgress)
