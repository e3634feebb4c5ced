"""Sessions, page trajectories and event quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import bucket_index, bucketise, ratio
from funnelwright.operators.aggregates import gaps
from funnelwright.operators.ordered import TARGET_ROWS, bucketed, extremes, range_cuts

STAY_EDGES = (5, 10, 30, 60, 120, 300, 600, 1800, 3600)
STAY_LABELS = ("0-5s", "5-10s", "10-30s", "30-60s", "1-2m", "2-5m", "5-10m", "10-30m", "30-60m", "60m+")


def sessionise(events: DataFrame, user: str | Sequence[str], ts: str, tie: str, gap_seconds: int, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Events with ``session_no`` per user (or user and device): a pause longer than the gap starts a new one.

    A gap of exactly ``gap_seconds`` stays in the session. Long histories are cut at quantiles of time: sessions
    are numbered inside each (user, time range) piece, and one small row per piece says how many sessions came
    before and whether its first event continues the last one.
    """
    user = [user] if isinstance(user, str) else list(user)
    limit = gap_seconds * 1_000_000
    pause = lambda later, earlier: F.unix_micros(later) - F.unix_micros(earlier)
    cuts = range_cuts(events, ts, target_rows)
    if not cuts:
        w = W.partitionBy(*user).orderBy(ts, tie)
        new = F.when(pause(F.col(ts), F.lag(ts).over(w)) <= limit, 0).otherwise(1)
        return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")

    b = bucketed(events, ts, cuts)
    w = W.partitionBy(*user, "_b").orderBy(ts, tie)
    inner = F.when(pause(F.col(ts), F.lag(ts).over(w)) > limit, 1).otherwise(0)

    # The piece table needs two columns of the events only; it stays partitioned by (user, piece).
    narrow = b.select(*user, "_b", ts, tie).withColumn("_in", inner)
    piece = narrow.groupBy(*user, "_b").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_in").alias("_in"))
    k = W.partitionBy(*user).orderBy("_b")
    piece = piece.withColumn("_cont", F.when(pause(F.col("_first"), F.lag("_last").over(k)) <= limit, 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("_in") + F.col("_cont")).over(k.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    piece = piece.select(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(user)], F.col("_b").alias("_bb"), (before + F.col("_cont")).alias("_base"))

    numbered = b.withColumn("_in", inner).withColumn("_no", F.sum("_in").over(w.rowsBetween(W.unboundedPreceding, 0)))
    same = F.col("_b") == F.col("_bb")
    for i, u in enumerate(user):
        same = same & F.col(u).eqNullSafe(F.col(f"_u{i}"))
    j = numbered.join(piece, same)
    return j.select(*events.columns, (F.col("_base") + F.col("_no")).alias("session_no"))


def session_table(sessions: DataFrame, user: str | Sequence[str], ts: str, tie: str, page: str, is_view: Column, is_purchase: Column, device: str | None = None) -> DataFrame:
    """One row per session: start, end, events, page views, landing page, purchase flag and, if named, the first event's
    ``device``."""
    user = [user] if isinstance(user, str) else list(user)
    pos = F.struct(ts, tie)
    first_device = [F.min_by(device, pos).alias("device")] if device and device not in user else []
    return sessions.groupBy(*user, "session_no").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("events"), F.count(F.when(is_view, 1)).alias("page_views"),
        F.min_by(page, pos).alias("landing_page"), F.bool_or(is_purchase).alias("had_purchase"), *first_device,
    )


def session_windows(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """The built-in form; here a gap of exactly the limit starts a new session."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(user, F.col("w.start").alias("session_start"), "events")


def stay_distribution(events: DataFrame, user: str, stay: str, cap: float = 7200.0) -> DataFrame:
    """Longest stay per user, capped, in ten ranges with share and cumulative share."""
    u = events.groupBy(user).agg(F.max(stay).alias("_s"))
    u = u.withColumns({"_c": F.least("_s", F.lit(cap)), "_over": (F.col("_s") > cap).cast("int")})
    g = u.groupBy(bucketise("_c", STAY_EDGES, STAY_LABELS).alias("bucket"), bucket_index("_c", STAY_EDGES).alias("pos")).agg(F.count("*").alias("users"), F.sum("_over").alias("capped"))
    w = W.partitionBy()  # ten rows
    return g.withColumns({
        "share": ratio("users", F.sum("users").over(w)),
        "cum_share": ratio(F.sum("users").over(w.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)), F.sum("users").over(w)),
    })


def page_exposure(events: DataFrame, user: str, page: str, shown: Column, clicked: Column, min_share: float) -> DataFrame:
    """Users shown each page, share of all users, clicks per show; pages below the share are left out."""
    u = events.groupBy(page, user).agg(F.count(F.when(shown, 1)).alias("shows"), F.count(F.when(clicked, 1)).alias("clicks"))
    g = u.groupBy(page).agg(F.count(F.when(F.col("shows") > 0, 1)).alias("uv"), F.sum("shows").alias("shows"), F.sum("clicks").alias("clicks"))
    total = events.groupBy(user).agg(F.lit(1).alias("one")).agg(F.count("one").alias("n"))
    g = g.withColumn("share", ratio("uv", total.scalar())).withColumn("clicks_per_show", ratio("clicks", "shows"))
    return g.where(F.col("share") >= min_share)


def click_heat(events: DataFrame, user: str, page: str, module: str, clicked: Column, min_users: int) -> DataFrame:
    u = events.where(clicked).groupBy(page, module, user).agg(F.count("*").alias("n"))
    return u.groupBy(page, module).agg(F.count(user).alias("uv"), F.sum("n").alias("clicks")).where(F.col("uv") >= min_users)


def short_stay_contrast(events: DataFrame, user: str, stay: str, place: str | Sequence[str], seconds: float) -> DataFrame:
    """Share of users reaching each place (a page, or a page and module) among short-stay users and among all."""
    place = [place] if isinstance(place, str) else list(place)
    u = events.groupBy(user).agg(F.max(stay).alias("_s")).select(user, (F.col("_s") < seconds).alias("short"))
    pu = events.groupBy(*place, user).agg(F.lit(1).alias("one")).join(u, user)
    g = pu.groupBy(*place).agg(F.count("one").alias("uv_all"), F.count(F.when(F.col("short"), 1)).alias("uv_short"))
    n = u.agg(F.struct(F.count("*").alias("all"), F.count(F.when(F.col("short"), 1)).alias("short")).alias("n"))
    g = g.withColumn("_n", n.scalar())
    return g.select(*place, "uv_all", "uv_short", ratio("uv_all", "_n.all").alias("share_all"), ratio("uv_short", "_n.short").alias("share_short"))


def event_quality(events: DataFrame, sessions: DataFrame, event_id: str, user: str, device: str, ts: str, odd_hours: Sequence[int]) -> DataFrame:
    """Surplus copies of ids, missing days per device, share at odd hours, overlapping sessions.

    A session overlaps if it begins before the latest end of the user's sessions that began before it, which need not
    be the one just before; sessions of one user overlap where they are made per device.
    """
    dup = events.groupBy(event_id).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("observed")).withColumn("check", F.lit("duplicate_events"))
    days = events.groupBy(device, F.to_date(ts).alias("dt")).agg(F.lit(1).alias("one")).select(device, "dt")
    gap = gaps(days, [device], "dt").agg(F.coalesce(F.sum("missing_days"), F.lit(0)).cast("double").alias("observed")).withColumn("check", F.lit("missing_device_days"))
    odd = events.agg(F.avg(F.when(F.hour(ts).isin(list(odd_hours)), 1.0).otherwise(0.0)).alias("observed")).withColumn("check", F.lit("odd_hour_share"))
    spans = sessions.select(user, "session_start", "session_end", F.xxhash64("session_start", "session_end", *[c for c in sessions.columns if c not in ("session_start", "session_end")]).alias("_tie"))
    ends = extremes(spans, [user], ["session_start", "session_end", "_tie"], highest={"_open": "session_end"}, before=True)
    over = ends.agg(F.count(F.when(F.col("session_start") < F.col("_open"), 1)).cast("double").alias("observed")).withColumn("check", F.lit("overlapping_sessions"))
    return dup.unionByName(gap).unionByName(odd).unionByName(over).select("check", "observed")
