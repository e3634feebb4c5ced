"""Retention, payment, cohorts, segments and customer value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import bucket_index, bucketise, change, members, month_index, ratio, stack_groups
from funnelwright.operators.ordered import quantiles, running


# --- retention and payment curves ----------------------------------------------

def retention_curve(events: DataFrame, user: str, dt: str, by: str) -> DataFrame:
    """(by, offset, active, cohort, rate): users seen k days after their first day over all users.

    Events collapse to user-days before anything travels, so a window over a user holds at most one row per day.
    """
    days = events.groupBy(by, user, dt).agg(F.lit(1).alias("one"))
    k = days.withColumn("offset", F.datediff(dt, F.min(dt).over(W.partitionBy(user))))
    g = k.groupBy(by, "offset").agg(F.count("one").alias("active"))
    size = F.max(F.when(F.col("offset") == 0, F.col("active"))).over(W.partitionBy(by))
    return g.withColumn("cohort", size).withColumn("rate", ratio("active", "cohort"))


def retention_milestones(curve: DataFrame, by: str, marks: Sequence[int] = (1, 3, 7, 14, 30), stable: float = 0.03) -> DataFrame:
    """Rates at fixed days, decay from the first to the third mark, stickiness and first stable day."""
    w = W.partitionBy(by).orderBy("offset")
    c = curve.withColumn("_chg", F.when(F.col("offset") >= 2, F.abs(change("rate", F.lag("rate").over(w)))))
    at = {m: F.max(F.when(F.col("offset") == m, F.col("rate"))) for m in marks}
    first, third, last = marks[0], marks[2], marks[-1]
    return c.groupBy(by).agg(
        *[v.alias(f"d{m}") for m, v in at.items()],
        F.try_divide(at[first] - at[third], at[first]).alias("decay"), F.try_divide(at[last], at[third]).alias("stickiness"),
        F.min(F.when(F.col("_chg") < stable, F.col("offset"))).alias("stable_day"),
    )


def retention_gap(curve: DataFrame, by: str, a: str, b: str, marks: Sequence[int]) -> DataFrame:
    """Rate of group a less rate of group b at each mark, from one aggregation."""
    c = curve.where(F.col("offset").isin(list(marks)) & F.col(by).isin(a, b))
    g = c.groupBy("offset").agg(F.max(F.when(F.col(by) == a, F.col("rate"))).alias("rate_a"), F.max(F.when(F.col(by) == b, F.col("rate"))).alias("rate_b"))
    return g.withColumn("gap", F.col("rate_a") - F.col("rate_b"))


def pay_rate_by_offset(events: DataFrame, user: str, dt: str, orders: str, by: str) -> DataFrame:
    """Orders k days after the first active day over users active on day 0."""
    days = events.groupBy(by, user, dt).agg(F.sum(orders).alias("n"))
    k = days.withColumn("offset", F.datediff(dt, F.min(dt).over(W.partitionBy(user))))
    g = k.groupBy(by, "offset").agg(F.sum("n").alias("orders"), F.count("*").alias("_active"))
    base = F.max(F.when(F.col("offset") == 0, F.col("_active"))).over(W.partitionBy(by))
    return g.withColumn("cohort", base).withColumn("rate", ratio("orders", "cohort")).drop("_active")


def cumulative_conversion(rates: DataFrame, by: str, horizons: Sequence[int] = (7, 30, 90, 180)) -> DataFrame:
    """Day-0 rate, cumulative rates, D7/D0, orders per user and the days holding 50% and 80% of orders."""
    w = W.partitionBy(by).orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    c = rates.withColumn("_share", ratio(F.sum("orders").over(w), F.sum("orders").over(W.partitionBy(by))))
    d0 = F.max(F.when(F.col("offset") == 0, F.col("rate")))
    return c.groupBy(by).agg(
        d0.alias("d0"), *[F.sum(F.when(F.col("offset") <= h, F.col("rate"))).alias(f"d0_{h}") for h in horizons],
        F.try_divide(F.max(F.when(F.col("offset") == 7, F.col("rate"))), d0).alias("d7_over_d0"),
        ratio(F.sum("orders"), F.max("cohort")).alias("orders_per_user"),
        F.min(F.when(F.col("_share") >= 0.5, F.col("offset"))).alias("day_50"), F.min(F.when(F.col("_share") >= 0.8, F.col("offset"))).alias("day_80"),
    )


def smoothed_curve(rates: DataFrame, by: str, window: int = 7, skip_first: bool = False) -> DataFrame:
    """Trailing mean of the daily rate; ``skip_first`` leaves out day 0 for the repeat curve."""
    r0 = rates.where("offset > 0") if skip_first else rates
    w = W.partitionBy(by).orderBy("offset").rowsBetween(-(window - 1), 0)
    return r0.select(by, "offset", F.avg("rate").over(w).alias("smoothed"))


CONTRIBUTION_EDGES = (1, 8, 31, 91, 181)
CONTRIBUTION_LABELS = ("D0", "D1-7", "D8-30", "D31-90", "D91-180", "D181+")


def order_contribution(rates: DataFrame, by: str) -> DataFrame:
    g = rates.groupBy(by, bucketise("offset", CONTRIBUTION_EDGES, CONTRIBUTION_LABELS).alias("period")).agg(F.sum("orders").alias("orders"))
    return g.withColumn("share", ratio("orders", F.sum("orders").over(W.partitionBy(by))))


def weekday_vs_cycle(detail: DataFrame, by: str, dt: str, offset: str, users: str, orders: str) -> DataFrame:
    """Mean conversion by calendar weekday of payment and by offset mod 7, with peak over trough of each."""
    d = detail.withColumn("_rate", ratio(orders, users))
    structs = F.array(
        F.struct(F.lit("weekday").alias("view"), F.weekday(F.date_add(dt, F.col(offset).cast("int"))).alias("slot")),
        F.struct(F.lit("mod7").alias("view"), F.pmod(F.col(offset), F.lit(7)).cast("int").alias("slot")),
    )
    g = d.select(by, "_rate", F.explode(structs).alias("s")).groupBy(by, "s.view", "s.slot").agg(F.avg("_rate").alias("rate"))
    w = W.partitionBy(by, "view")
    return g.withColumn("peak_trough", F.try_divide(F.max("rate").over(w), F.min("rate").over(w)))


# --- behaviour of payers -----------------------------------------------------------

def payer_contrast(df: DataFrame, paid: Column, metrics: Sequence[str]) -> DataFrame:
    """Mean, ratio and non-zero share of each behaviour for payers and others."""
    long = df.withColumn("_paid", paid).unpivot(["_paid"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    nz = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    g = long.groupBy("metric").agg(
        F.avg(F.when(F.col("_paid"), F.col("value"))).alias("mean_paid"), F.avg(F.when(~F.col("_paid"), F.col("value"))).alias("mean_other"),
        F.avg(F.when(F.col("_paid"), nz)).alias("nonzero_paid"), F.avg(F.when(~F.col("_paid"), nz)).alias("nonzero_other"),
    )
    return g.withColumn("ratio", F.try_divide("mean_paid", "mean_other"))


DEPTH_EDGES = (1, 2, 4, 8, 16, 31)
DEPTH_LABELS = ("0", "1", "2-3", "4-7", "8-15", "16-30", "30+")


def depth_gradient(df: DataFrame, depth: str, paid: Column, by: str) -> DataFrame:
    """Pay rate per view-depth bucket, overall and per group, in one scan."""
    d = df.select(bucketise(depth, DEPTH_EDGES, DEPTH_LABELS).alias("bucket"), bucket_index(depth, DEPTH_EDGES).alias("pos"), paid.cast("int").alias("_p"), F.col(by))
    g = members(d, [by], ["bucket", "pos", "_p"]).groupBy("member", "bucket", "pos").agg(F.count("*").alias("users"), F.sum("_p").alias("paid"))
    return g.withColumn("rate", ratio("paid", "users"))


def aha_threshold(gradient: DataFrame, threshold: float = 0.05) -> DataFrame:
    """First bucket whose rate exceeds the threshold."""
    over = gradient.where(F.col("rate") > threshold)
    return over.groupBy("member").agg(F.min_by("bucket", "pos").alias("bucket"), F.min_by("rate", "pos").alias("rate"))


def multi_signal(df: DataFrame, signals: Sequence[str], paid: Column) -> DataFrame:
    """Users by number of positive signals with the distribution among payers and others."""
    n = sum((F.when(F.col(s) > 0, 1).otherwise(0) for s in signals), F.lit(0))
    g = df.groupBy(n.alias("signals")).agg(F.count("*").alias("users"), F.count(F.when(paid, 1)).alias("paid"))
    w = W.partitionBy()
    other = F.col("users") - F.col("paid")
    # One row per signal count (a handful), so the unpartitioned total is tiny.
    return g.withColumns({"share_paid": ratio("paid", F.sum("paid").over(w)), "share_other": ratio(other, F.sum(other).over(w)), "rate": ratio("paid", "users")})


def condition_ladder(df: DataFrame, conditions: Mapping[str, Column], paid: Column) -> DataFrame:
    """Users and pay rate for every condition from one pass."""
    rows = [F.struct(F.lit(n).alias("condition"), F.count(F.when(c, 1)).alias("users"), F.count(F.when(c & paid, 1)).alias("paid")) for n, c in conditions.items()]
    g = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return g.withColumn("rate", ratio("paid", "users"))


def repeat_intensity(df: DataFrame, orders: str, by: str) -> DataFrame:
    one, more = F.count(F.when(F.col(orders) == 1, 1)), F.count(F.when(F.col(orders) >= 2, 1))
    return df.groupBy(by).agg(one.alias("one"), more.alias("two_plus"), ratio(more, one + more).alias("share_two_plus"))


def threshold_curve(df: DataFrame, behaviour: str, paid: Column, cuts: Sequence[int], scale: float) -> DataFrame:
    """Users with at least N actions (0 means exactly none): size, share, scaled size and rate."""
    rows = []
    for c in cuts:
        inside = F.col(behaviour) == 0 if c == 0 else F.col(behaviour) >= c
        rows.append(F.struct(F.lit(c).alias("cut"), F.count(F.when(inside, 1)).alias("users"), F.count(F.when(inside & paid, 1)).alias("paid")))
    g = df.agg(F.count("*").alias("n"), F.array(*rows).alias("a")).select("n", F.explode("a").alias("x")).select("n", "x.*")
    return g.select("cut", "users", (ratio("users", "n") * 100).alias("pct"), (F.col("users") * F.lit(scale)).alias("scaled"), (ratio("paid", "users") * 100).alias("rate"))


def stratified_rates(df: DataFrame, group: Column, name: str, lines: Mapping[str, str], scale: float) -> DataFrame:
    """Size, share and conversion of every business line per stratum."""
    g = df.groupBy(group.alias(name)).agg(F.count("*").alias("users"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"_p_{k}") for k, c in lines.items()])
    g = g.withColumn("pct", ratio("users", F.sum("users").over(W.partitionBy())) * 100)
    long = stack_groups(g, [name, "users", "pct"], {k: {"paid": F.col(f"_p_{k}")} for k in lines}, "line")
    return long.withColumns({"scaled": F.col("users") * F.lit(scale), "rate": ratio("paid", "users") * 100})


def rate_heatmap(df: DataFrame, g1: Column, g2: Column, names: tuple[str, str], columns: Sequence[str], paid: Column) -> DataFrame:
    """Conversion matrix of two groupings; the column labels are given, so the pivot needs no extra job."""
    d = df.select(g1.alias(names[0]), g2.alias(names[1]), paid.cast("double").alias("_p"))
    return d.groupBy(names[0]).pivot(names[1], list(columns)).agg(F.avg("_p") * 100)


def penetration(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share with any action; mean over everyone and over the active."""
    rows = [F.struct(F.lit(c).alias("metric"), (F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)) * 100).alias("pct"), F.avg(c).alias("mean_all"), F.avg(F.when(F.col(c) > 0, F.col(c))).alias("mean_active")) for c in cols]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def report_recheck(df: DataFrame, measures: Mapping[str, Column], claims: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Recompute every claimed number of ``claims`` (claim, reported) in one aggregation and flag differences; a claim
    without a measure, or without a number, is not confirmed."""
    rows = [F.struct(F.lit(n).alias("claim"), a.cast("double").alias("actual")) for n, a in measures.items()]
    g = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return claims.join(g, "claim", "left").withColumn("ok", F.coalesce(F.abs(F.col("actual") - F.col("reported")) < tolerance, F.lit(False)))


def threshold_consistency(curve: DataFrame) -> DataFrame:
    """Along rising cuts the rate must not fall and the size must not rise; baseline and first cut sum to 100%."""
    w = W.partitionBy().orderBy("cut")  # one row per cut
    c = curve.where("cut > 0").select("cut", (F.col("rate") < F.lag("rate").over(w)).alias("_r"), (F.col("users") > F.lag("users").over(w)).alias("_n"))
    s = curve.where(F.col("cut").isin(0, 1)).agg(F.sum("pct").alias("pct"))
    return c.agg(F.count(F.when(F.col("_r"), 1)).alias("rate_drops"), F.count(F.when(F.col("_n"), 1)).alias("size_rises")).withColumn("base_pct", s.scalar())


# --- cohorts --------------------------------------------------------------------------

def cohort_assign(events: DataFrame, user: str, dt: str) -> DataFrame:
    """(user, cohort): month of the first event, combined map-side."""
    return events.groupBy(user).agg(F.trunc(F.min(dt), "month").alias("cohort"))


def cohort_sizes(assigned: DataFrame, small: int = 50) -> DataFrame:
    return assigned.groupBy("cohort").agg(F.count("*").alias("users")).withColumn("too_small", F.col("users") < small)


def retention_matrix(events: DataFrame, user: str, dt: str) -> DataFrame:
    """(cohort, offset, retained, users, pct) over user-months."""
    months = events.groupBy(user, F.trunc(dt, "month").alias("m")).agg(F.lit(1).alias("one"))
    c = months.withColumn("cohort", F.min("m").over(W.partitionBy(user)))
    g = c.groupBy("cohort", (month_index("m") - month_index("cohort")).alias("offset")).agg(F.count("one").alias("retained"))
    users = F.max(F.when(F.col("offset") == 0, F.col("retained"))).over(W.partitionBy("cohort"))
    return g.withColumn("users", users).withColumn("pct", ratio("retained", "users") * 100)


def right_censor(matrix: DataFrame, max_month: str | Column, periods: int) -> DataFrame:
    """Full cohort × offset grid: unobservable cells are null, observable empty ones 0."""
    last = F.trunc(F.lit(max_month).cast("date") if isinstance(max_month, str) else max_month, "month")
    spine = matrix.groupBy("cohort").agg(F.max("users").alias("users")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(periods))))
    j = spine.join(matrix.select("cohort", "offset", "retained"), ["cohort", "offset"], "left")
    seen = F.add_months("cohort", F.col("offset")) <= last
    ret = F.when(seen, F.coalesce("retained", F.lit(0)))
    return j.select("cohort", "offset", "users", ret.alias("retained"), (ratio(ret, "users") * 100).alias("pct"))


def mean_curve(grid: DataFrame) -> DataFrame:
    """Mean across cohorts that have reached the offset, with deviation, count and standard error."""
    g = grid.where(F.col("pct").isNotNull()).groupBy("offset").agg(F.count("*").alias("n"), F.avg("pct").alias("mean"), F.stddev_samp("pct").alias("sd"))
    return g.withColumn("se", F.col("sd") / F.sqrt("n"))


def cohort_outliers(grid: DataFrame, limit: float = 2.0) -> DataFrame:
    w = W.partitionBy("offset")
    z = F.try_divide(F.col("pct") - F.avg("pct").over(w), F.stddev_samp("pct").over(w))
    return grid.where(F.col("pct").isNotNull()).withColumn("z", z).where(F.abs("z") > limit)


def cohort_slope(grid: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Change of offset-k retention per cohort, oldest to newest."""
    d = grid.where(F.col("offset").isin(list(offsets)) & F.col("pct").isNotNull())
    x = month_index("cohort")
    return d.groupBy("offset").agg(F.regr_slope("pct", x).alias("slope"), F.count("*").alias("n"))


def cohort_ltv(orders: DataFrame, user: str, dt: str, revenue: str) -> DataFrame:
    """(cohort, offset, users, cum_revenue, ltv, share_of_final)."""
    m = orders.groupBy(user, F.trunc(dt, "month").alias("m")).agg(F.sum(revenue).alias("v"))
    m = m.withColumn("cohort", F.min("m").over(W.partitionBy(user)))
    g = m.groupBy("cohort", (month_index("m") - month_index("cohort")).alias("offset")).agg(F.sum("v").alias("v"), F.count("*").alias("_n"))
    k = W.partitionBy("cohort")
    g = g.withColumn("users", F.max(F.when(F.col("offset") == 0, F.col("_n"))).over(k))
    g = g.withColumn("cum_revenue", F.sum("v").over(k.orderBy("offset").rowsBetween(W.unboundedPreceding, 0)))
    return g.withColumns({"ltv": ratio("cum_revenue", "users"), "share_of_final": ratio("cum_revenue", F.sum("v").over(k))}).drop("v", "_n")


def ltv_maturity(ltv: DataFrame, share: float = 0.8) -> DataFrame:
    """Final value per user, first offset holding ``share`` of it and the rank of the cohort."""
    g = ltv.groupBy("cohort").agg(F.max("users").alias("users"), F.max_by("ltv", "offset").alias("final_ltv"), F.min(F.when(F.col("share_of_final") >= share, F.col("offset"))).alias("mature_at"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("final_ltv"), "cohort")))  # one row per cohort


def mature_benchmark(grid: DataFrame, k: int = 3, limit: float = 5.0) -> DataFrame:
    """Mean of the k oldest complete cohorts and how far the others are from it."""
    full = grid.groupBy("cohort").agg(F.count(F.when(F.col("pct").isNull(), 1)).alias("_missing")).where("_missing = 0")
    oldest = full.orderBy("cohort").limit(k).select("cohort")
    bench = grid.join(oldest, "cohort", "left_semi").groupBy("offset").agg(F.avg("pct").alias("benchmark"))
    d = grid.where(F.col("pct").isNotNull()).join(oldest, "cohort", "left_anti").join(bench, "offset")
    d = d.withColumn("deviation", F.col("pct") - F.col("benchmark"))
    return d.withColumn("flag", F.abs("deviation") > limit).select("cohort", "offset", "pct", "benchmark", "deviation", "flag")


# --- funnels and value --------------------------------------------------------------

def funnel_times(events: DataFrame, user: str, ts: str, step: Column, steps: Sequence[str], within_seconds: int) -> DataFrame:
    """(user, t1, t2, ...): first time of each step at or after the previous one and within the limit of the first.

    Each step is one scan, joined to the one row per user found so far and reduced to the minimum again, so the plan
    grows with the number of steps and stays partitioned by user throughout.
    """
    e = events.select(F.col(user), F.col(ts).alias("_ts"), step.alias("_step")).where(F.col("_step").isin(list(steps)))
    t = e.where(F.col("_step") == steps[0]).groupBy(user).agg(F.min("_ts").alias("t1"))
    for i, s in enumerate(steps[1:], 2):
        nxt = e.where(F.col("_step") == s).select(F.col(user).alias("_u"), "_ts")
        ok = (F.col(user) == F.col("_u")) & (F.col("_ts") >= F.col(f"t{i - 1}")) & (F.col("_ts").cast("double") - F.col("t1").cast("double") <= within_seconds)
        t = t.join(nxt, ok, "left").groupBy(user, *[f"t{k}" for k in range(1, i)]).agg(F.min("_ts").alias(f"t{i}"))
    return t


def event_funnel(times: DataFrame, steps: Sequence[str]) -> DataFrame:
    """Users, step and overall conversion, median seconds from the previous step, largest drops flagged."""
    n = len(steps)
    counts = times.agg(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.count(f"t{i}").alias("users")) for i, s in enumerate(steps, 1)]).alias("a"))
    g = counts.select(F.explode("a").alias("x")).select("x.*")
    rows = [F.struct(F.lit(i).alias("step_no"), (F.col(f"t{i}").cast("double") - F.col(f"t{i - 1}").cast("double")).alias("secs")) for i in range(2, n + 1)]
    secs = times.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("secs is not null")
    med = quantiles(secs, ["step_no"], "secs", {"median_seconds": 0.5})
    w = W.partitionBy().orderBy("step_no")  # one row per step
    g = g.withColumns({"_prev": F.lag("users").over(w), "_first": F.first("users").over(w)})
    g = g.withColumns({"step_rate": ratio("users", "_prev"), "overall_rate": ratio("users", "_first"), "lost": F.col("_prev") - F.col("users")})
    whole = W.partitionBy()
    g = g.withColumns({"largest_loss": F.coalesce(F.col("lost") == F.max("lost").over(whole), F.lit(False)), "lowest_rate": F.coalesce(F.col("step_rate") == F.min("step_rate").over(whole), F.lit(False))})
    return g.join(med, "step_no", "left").drop("_prev", "_first")


RFM_PROBS = {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q33": 1 / 3, "q67": 2 / 3, "q0": 0.0, "q100": 1.0}
_RFM_CUTS = {5: ("q20", "q40", "q60", "q80"), 4: ("q25", "q50", "q75"), 3: ("q33", "q67"), 2: ("q50",)}


def quantile_score(x: str, edges: Column, labels: Sequence[int]) -> Column:
    """Right-closed quantile bin; when edges repeat, fewer bins with the first labels, and 3 when none fit."""
    out = None
    for q, names in _RFM_CUTS.items():
        chain = ["q0", *names, "q100"]
        distinct = F.lit(True)
        for a, b in zip(chain, chain[1:]):
            distinct = distinct & (edges[a] < edges[b])
        score = F.lit(labels[q - 1])
        for name, lab in reversed(list(zip(names, labels))):
            score = F.when(F.col(x) <= edges[name], lab).otherwise(score)
        out = F.when(distinct, score) if out is None else out.when(distinct, score)
    return out.otherwise(F.lit(3))


def rfm(df: DataFrame, customer: str, dt: str, revenue: str, reference: str | None = None) -> DataFrame:
    """Recency, frequency, monetary value, their quintile scores and a named segment per customer."""
    ref = df.agg(F.date_add(F.max(dt), 1).alias("ref")).scalar() if reference is None else F.lit(reference).cast("date")
    c = df.groupBy(F.col(customer).alias("customer")).agg(F.max(dt).alias("_last"), F.count(dt).alias("frequency"), F.sum(revenue).alias("monetary"))
    c = c.withColumn("_ref", ref).select("customer", F.datediff("_ref", "_last").alias("recency"), "frequency", "monetary")
    # One pass over the three measures; the edges come back as a single row.
    measures = ("recency", "frequency", "monetary")
    long = c.unpivot([], [F.col(m).cast("double").alias(m) for m in measures], "measure", "x")
    edges = quantiles(long, ["measure"], "x", RFM_PROBS)
    pick = [F.max(F.when(F.col("measure") == m, F.struct(*RFM_PROBS))).alias(m) for m in measures]
    c = c.withColumn("_e", edges.agg(F.struct(*pick).alias("e")).scalar())
    c = c.withColumns({
        "R": quantile_score("recency", F.col("_e.recency"), [5, 4, 3, 2, 1]), "F": quantile_score("frequency", F.col("_e.frequency"), [1, 2, 3, 4, 5]),
        "M": quantile_score("monetary", F.col("_e.monetary"), [1, 2, 3, 4, 5]),
    })
    seg = (
        F.when((F.col("R") >= 4) & (F.col("F") >= 4) & (F.col("M") >= 4), "Champions").when((F.col("F") >= 3) & (F.col("M") >= 3), "Loyal")
        .when((F.col("R") <= 2) & (F.col("F") >= 3), "At Risk").when((F.col("R") <= 2) & (F.col("F") <= 2) & (F.col("M") <= 2), "Lost").otherwise("Other")
    )
    return c.select("customer", "recency", "frequency", "monetary", "R", "F", "M", F.concat("R", "F", "M").alias("score"), seg.alias("segment"))


def rfm_summary(scored: DataFrame) -> DataFrame:
    g = scored.groupBy("segment").agg(F.count("*").alias("customers"), F.avg("monetary").alias("avg_monetary"), F.avg("frequency").alias("avg_frequency"))
    return g.withColumn("pct", ratio("customers", F.sum("customers").over(W.partitionBy())) * 100)  # at most five rows


def lorenz(values: DataFrame, key: str, value: str) -> DataFrame:
    """Entities in ascending order of value with running totals."""
    run = running(values, [], [value, key], sums={"cum": value}, row_number="i")
    tot = values.agg(F.struct(F.count("*").alias("n"), F.sum(value).alias("total")).alias("t"))
    return run.withColumn("_t", tot.scalar()).select("*", F.col("_t.n").alias("n"), F.col("_t.total").alias("total")).drop("_t")


def concentration(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Gini, share of the top 10/20/50% and the share of entities producing 80% of the value."""
    v = df.groupBy(entity).agg(F.sum(value).alias("v"))
    x = lorenz(v, entity, "v")
    top = lambda p: F.sum(F.when(F.col("i") > F.col("n") - F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(p))), F.col("v")))
    from_top = F.col("total") - F.col("cum") + F.col("v")
    g = x.agg(
        F.max("n").alias("n"), F.max("total").alias("total"), (2.0 * F.sum(F.col("i") * F.col("v"))).alias("_w"),
        *[top(p).alias(f"_t{int(p * 100)}") for p in (0.1, 0.2, 0.5)], F.min(F.when(from_top >= F.col("total") * 0.8, F.col("n") - F.col("i") + 1)).alias("_k80"),
    )
    gini = F.try_divide(F.col("_w"), F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")
    return g.select("n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini)).alias("gini"), *[ratio(f"_t{p}", "total").alias(f"top_{p}_share") for p in (10, 20, 50)], (ratio("_k80", "n") * 100).alias("pareto_ratio"))


def lorenz_points(df: DataFrame, value: str, entity: str, points: int = 10) -> DataFrame:
    """Cumulative share of value at evenly spaced shares of entities."""
    x = lorenz(df.groupBy(entity).agg(F.sum(value).alias("v")), entity, "v")
    at = F.ceil(F.col("i") * F.lit(points) / F.col("n"))
    return x.groupBy(at.cast("int").alias("point")).agg(F.max_by("cum", "i").alias("cum"), F.max("i").alias("i"), F.max("n").alias("n"), F.max("total").alias("total")).select(
        "point", ratio("i", "n").alias("x"), ratio("cum", "total").alias("y"))


def nps(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    s = F.col(score)
    return df.groupBy(*by).agg(F.count("*").alias("n"), (ratio(F.count(F.when(s >= 9, 1)) - F.count(F.when(s <= 6, 1)), F.count(s)) * 100).alias("nps"))


def activation_rate(users: DataFrame, actions: DataFrame, user: str, start: str, ts: str, days: int, by: Sequence[str]) -> DataFrame:
    """Share of users whose first action follows the start within ``days``."""
    first = actions.join(users.select(user, start), user).where(F.col(ts) >= F.col(start)).groupBy(user).agg(F.min(ts).alias("_first"))
    j = users.join(first, user, "left")
    hit = (F.col("_first").cast("double") - F.col(start).cast("double")) <= days * 86400
    g = j.groupBy(*by).agg(F.count("*").alias("users"), F.count(F.when(hit, 1)).alias("activated"))
    return g.withColumn("rate", ratio("activated", "users"))


def spike_ratio(df: DataFrame, dt: str, lo: str, hi: str, year_days: int, cond: Column) -> DataFrame:
    """Daily rate inside a window over the daily rate outside."""
    inside = F.col(dt).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    span = F.datediff(F.lit(hi).cast("date"), F.lit(lo).cast("date")) + 1
    g = df.where(cond).agg(F.count(F.when(inside, 1)).alias("n_in"), F.count(F.when(~inside, 1)).alias("n_out"))
    g = g.withColumns({"daily_in": F.col("n_in") / span, "daily_out": F.col("n_out") / F.greatest(F.lit(1), F.lit(year_days) - span)})
    return g.withColumn("ratio", F.col("daily_in") / F.greatest(F.lit(1.0), F.col("daily_out")))


def conversion_gap(events: DataFrame, platform: Column, started: Column, completed: Column, a: str, b: str) -> DataFrame:
    """Completions over starts per platform and the gap in percentage points."""
    g = events.groupBy(platform.alias("platform")).agg(F.count(F.when(started, 1)).alias("started"), F.count(F.when(completed, 1)).alias("completed"))
    g = g.withColumn("rate", ratio("completed", "started"))
    return g.agg(
        F.max(F.when(F.col("platform") == a, F.col("rate"))).alias("rate_a"), F.max(F.when(F.col("platform") == b, F.col("rate"))).alias("rate_b")
    ).withColumn("gap_pp", (F.col("rate_b") - F.col("rate_a")) * 100)


def active_users(events: DataFrame, user: str, ts: str, grain: str) -> DataFrame:
    u = events.groupBy(F.date_trunc(grain, ts).cast("date").alias("period"), user).agg(F.lit(1).alias("one"))
    return u.groupBy("period").agg(F.count("one").alias("active_users"))


def revenue_tree(orders: DataFrame, user: str, dt: str, revenue: str) -> DataFrame:
    """Revenue = buyers × orders per buyer × order value, by month; buyers are combined before counting."""
    u = orders.groupBy(F.trunc(dt, "month").alias("month"), user).agg(F.count("*").alias("n"), F.sum(revenue).alias("v"))
    g = u.groupBy("month").agg(F.count(user).alias("buyers"), F.sum("n").alias("orders"), F.sum("v").alias("revenue"))
    return g.withColumns({"orders_per_buyer": ratio("orders", "buyers"), "order_value": ratio("revenue", "orders")})


def state_transitions(states: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Counts of consecutive state pairs; the previous state is carried across pieces of a long history."""
    p = running(states, [key], order, previous={"prev_state": state})
    return p.where("prev_state is not null").groupBy("prev_state", state).agg(F.count("*").alias("n"))


def state_funnel(states: DataFrame, key: str, ts: str, state: str, trial: str, paid: str) -> DataFrame:
    """Share of users who enter the trial state and share of those who later pay."""
    t = states.groupBy(key).agg(F.min(F.when(F.col(state) == trial, F.col(ts))).alias("t_trial"), F.max(F.when(F.col(state) == paid, F.col(ts))).alias("t_paid"))
    g = t.agg(F.count("*").alias("users"), F.count("t_trial").alias("trial"), F.count(F.when(F.col("t_paid") >= F.col("t_trial"), 1)).alias("paid"))
    return g.withColumns({"trial_rate": ratio("trial", "users"), "paid_rate": ratio("paid", "trial")})


def churn_rate(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Ended in the month over active at its start, per plan, for every month from a plan's first move to its last.

    Starts and ends are counted per month and accumulated, so a span is never repeated for each month it covers.
    """
    moves = spans.select(by, F.explode(F.array(
        F.struct(F.trunc(start, "month").alias("month"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.trunc(end, "month").alias("month"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )).alias("m")).select(by, "m.*").where("month is not null")
    g = moves.groupBy(by, "month").agg(F.sum("s").alias("started"), F.sum("e").alias("ended"))
    # Months without a move have their row too; a plan has as many rows as months.
    spine = g.groupBy(by).agg(F.min("month").alias("lo"), F.max("month").alias("hi")).select(by, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    g = spine.join(g, [by, "month"], "left").fillna(0, ["started", "ended"])
    w = W.partitionBy(by).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("active_at_start", F.coalesce(F.sum(F.col("started") - F.col("ended")).over(w), F.lit(0)))
    return g.withColumn("churn", ratio("ended", "active_at_start"))


def revenue_by_category(items: DataFrame, products: DataFrame, on: Column, category: str, dt: str, revenue: Column) -> DataFrame:
    return items.join(products, on).groupBy(category, F.trunc(dt, "month").alias("month")).agg(F.sum(revenue).alias("revenue"))


def ltv_by(orders: DataFrame, users: DataFrame, okey: str, ukey: str, revenue: str, dim: str) -> DataFrame:
    """Lifetime revenue per user of a dimension; users without orders count as zero."""
    o = orders.groupBy(F.col(okey).alias("_k")).agg(F.sum(revenue).alias("_v"))
    j = users.join(o, F.col(ukey) == F.col("_k"), "left")
    return j.groupBy(dim).agg(F.count("*").alias("users"), F.coalesce(F.sum("_v"), F.lit(0)).alias("revenue")).withColumn("ltv", ratio("revenue", "users"))
