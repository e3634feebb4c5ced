"""Daily funnel panel and the weekly, monthly and year-over-year reports read from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import change, in_period, members, month_key, pct_change, r, ratio, shift, week_end, week_start

STAGES = ("exp", "detail", "order", "pay")
COUNTS = ("uv_all", "exp_uv", "exp_pv", "detail_uv", "detail_pv", "order_uv", "order_pv", "pay_uv", "pay_pv")
VOLUMES = ("uv_all", "exp_uv", "detail_uv", "order_uv", "pay_pv")
# Ratio name: (numerator count, denominator count).
RATES = {
    "pay_dau": ("pay_pv", "uv_all"),
    "pay_detail": ("pay_pv", "detail_uv"),
    "detail_dau": ("detail_uv", "uv_all"),
    "exp_dau": ("exp_uv", "uv_all"),
    "detail_exp": ("detail_uv", "exp_uv"),
    "order_detail": ("order_uv", "detail_uv"),
    "pay_order": ("pay_pv", "order_uv"),
    "pay_exp": ("pay_pv", "exp_uv"),
}


def stage_of(event_type: Column, stages: Mapping[str, str]) -> Column:
    out = None
    for name, stage in stages.items():
        out = F.when(event_type == name, stage) if out is None else out.when(event_type == name, stage)
    return out


def funnel_panel(events: DataFrame, dims: Sequence[str], overall: bool = True) -> DataFrame:
    """One row per (tag, member, dt) with distinct users and counts per stage.

    Events first shrink to one row per (day, user, dimensions), then to one per (tag, member, day, user);
    distinct users are then plain sums, so no row is expanded once per distinct count and a busy
    user or member is combined before every shuffle.
    """
    daily = events.groupBy("dt", "user_id", *dims).agg(*[F.count(F.when(F.col("stage") == s, 1)).alias(s) for s in STAGES])
    per_user = (
        members(daily, dims, ["dt", "user_id", *STAGES], overall)
        .groupBy("tag", "member", "dt", "user_id")
        .agg(*[F.sum(s).alias(s) for s in STAGES])
    )
    aggs = [F.count("user_id").alias("uv_all")]
    for s in STAGES:
        aggs += [F.count(F.when(F.col(s) > 0, F.col("user_id"))).alias(f"{s}_uv"), F.sum(s).alias(f"{s}_pv")]
    return per_user.groupBy("tag", "member", "dt").agg(*aggs).select("tag", "member", "dt", *COUNTS)


def rate(name: str, suffix: str = "", rates: Mapping[str, tuple[str, str]] = RATES) -> Column:
    n, d = rates[name]
    return ratio(n + suffix, d + suffix)


def add_funnel_rates(df: DataFrame, suffix: str = "") -> DataFrame:
    """The eight stage ratios and exposures per exposed user, null where a divisor is zero."""
    new = {k + suffix: rate(k, suffix) for k in RATES}
    new["pv_per_user" + suffix] = ratio("exp_pv" + suffix, "exp_uv" + suffix)
    return df.withColumns(new)


def rollup_members(panel: DataFrame, tag: str, names: Sequence[str], label: str) -> DataFrame:
    """Counts of chosen members added per day under one label."""
    return (
        panel.where((F.col("tag") == tag) & F.col("member").isin(list(names)))
        .groupBy("dt").agg(*[F.sum(c).alias(c) for c in COUNTS])
        .select(F.lit(tag).alias("tag"), F.lit(label).alias("member"), "dt", *COUNTS)
    )


def period_means(panel: DataFrame, keys: Sequence[str], columns: Sequence[str], dt: str | Column = "dt") -> DataFrame:
    return panel.groupBy(*keys).agg(F.count_distinct("dt").alias("days"), *[F.avg(c).alias(c) for c in columns])


def weekly_trend(panel: DataFrame, end: str, weeks: int = 8) -> DataFrame:
    """Average counts per Monday week and ratios of those averages."""
    p = panel.where(in_period("dt", shift(end, -7 * weeks + 1), end))
    g = p.groupBy("tag", "member", week_start("dt").alias("week_start")).agg(
        F.count_distinct("dt").alias("days"), *[F.avg(c).alias(c) for c in COUNTS]
    )
    return add_funnel_rates(g).withColumn("week_end", F.date_add("week_start", 6))


def monthly_trend(panel: DataFrame, start: str, end: str, align: bool = True) -> DataFrame:
    """Monthly means; with ``align`` last year's month of ``end`` keeps only the elapsed days."""
    p = panel.where(in_period("dt", start, end))
    if align:
        last_year = f"{int(end[:4]) - 1}{end[4:7]}"
        p = p.where(~((month_key("dt") == last_year) & (F.dayofmonth("dt") > int(end[8:10]))))
    g = p.groupBy("tag", "member", month_key("dt").alias("month")).agg(
        F.count_distinct("dt").alias("days"), *[F.avg(c).alias(c) for c in COUNTS]
    )
    return add_funnel_rates(g)


def daily_metrics(panel: DataFrame, lo: str, hi: str) -> DataFrame:
    return add_funnel_rates(panel.where(in_period("dt", lo, hi)))


def window_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str], periods: Mapping[str, tuple[str, str]], dt: str = "dt") -> DataFrame:
    """Sums per named closed period plus observed days, in one scan of a (keys, dt) table."""
    lo, hi = min(p[0] for p in periods.values()), max(p[1] for p in periods.values())
    aggs = []
    for name, (a, b) in periods.items():
        inside = in_period(dt, a, b)
        aggs.append(F.count_distinct(F.when(inside, F.col(dt))).alias(f"days_{name}"))
        aggs += [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{c}_{name}") for c in columns]
    return df.where(in_period(dt, lo, hi)).groupBy(*keys).agg(*aggs)


def kpi_periods(end: str) -> dict[str, tuple[str, str]]:
    """Month to date, last seven days and the seven before."""
    return {"month": (end[:8] + "01", end), "week": (shift(end, -6), end), "prior": (shift(end, -13), shift(end, -7))}


def kpi_achievement(panel: DataFrame, targets: Mapping[str, float], end: str) -> DataFrame:
    """Month mean against target, week mean and week-over-week change of three headline numbers."""
    s = window_sums(panel.where(F.col("tag") == "overall"), [], ["pay_pv", "uv_all"], kpi_periods(end))

    def value(kpi: str, p: str) -> Column:
        if kpi == "pay_dau":
            return ratio(f"pay_pv_{p}", f"uv_all_{p}")
        return ratio(f"{kpi}_{p}", f"days_{p}")

    rows = []
    for kpi, target in targets.items():
        # Rates are rounded to six places before they are compared; volumes are compared as whole numbers.
        fix = (lambda c: F.round(c, 6)) if kpi == "pay_dau" else (lambda c: F.floor(c).cast("double"))
        rows.append(F.struct(
            F.lit(kpi).alias("kpi"), F.lit(float(target)).alias("target"),
            value(kpi, "month").alias("month_mean"), (value(kpi, "month") / F.lit(float(target))).alias("achieved"),
            value(kpi, "week").alias("week_mean"), value(kpi, "prior").alias("prior_mean"),
            change(fix(value(kpi, "week")), fix(value(kpi, "prior"))).alias("wow"),
        ))
    return s.select(F.explode(F.array(*rows)).alias("k")).select("k.*")


def funnel_wow(panel: DataFrame, end: str, tags: Sequence[str] | None = None, exclude: Sequence[str] = (), dau_tags: Sequence[str] | None = None) -> DataFrame:
    """Thirteen funnel metrics per member: week mean and week-over-week change, from one scan.

    DAU is shown only for dimensions that split users (``dau_tags``).
    """
    p = panel if tags is None else panel.where(F.col("tag").isin(list(tags)))
    if exclude:
        p = p.where(~F.col("member").isin(list(exclude)))
    s = window_sums(p, ["tag", "member"], list(VOLUMES), kpi_periods(end))
    out = [F.col("tag"), F.col("member"), r(rate("pay_dau", "_month"), 6).alias("pay_dau_month")]
    for v in VOLUMES:
        cur, pre = F.floor(ratio(f"{v}_week", "days_week")), F.floor(ratio(f"{v}_prior", "days_prior"))
        if v == "uv_all" and dau_tags is not None:
            shown = F.col("tag").isin(list(dau_tags))
            cur, pre = F.when(shown, cur), F.when(shown, pre)
        out += [cur.cast("long").alias(f"{v}_week"), r(change(cur, pre)).alias(f"{v}_wow")]
    for k in RATES:
        cur, pre = F.round(rate(k, "_week"), 6), F.round(rate(k, "_prior"), 6)
        out += [r(cur).alias(f"{k}_week"), r(change(cur, pre)).alias(f"{k}_wow")]
    return s.select(*out)


def brand_funnel(stage_events: DataFrame, dau: DataFrame, end: str, days: float = 7.0) -> DataFrame:
    """Daily means per category and over all categories, with changes and shares of overall DAU.

    ``stage_events(dt, stage, category, entity)``; the total counts each entity once across categories.
    """
    lo = shift(end, -13)
    e = stage_events.where(in_period("dt", lo, end) & F.col("category").isNotNull())
    distinct = e.groupBy("dt", "stage", "category", "entity").agg(F.lit(1).alias("one"))
    both = distinct.select("dt", "stage", "entity", F.explode(F.array(F.col("category"), F.lit("all"))).alias("category"))
    daily = both.groupBy("dt", "stage", "category", "entity").agg(F.lit(1).alias("one")).groupBy("dt", "stage", "category").agg(F.count("one").alias("uv"))
    week, prior = in_period("dt", shift(end, -6), end), in_period("dt", lo, shift(end, -7))
    aggs = []
    for s in STAGES:
        aggs += [
            (F.coalesce(F.sum(F.when(week & (F.col("stage") == s), F.col("uv"))), F.lit(0)) / F.lit(days)).alias(f"{s}_cur"),
            (F.coalesce(F.sum(F.when(prior & (F.col("stage") == s), F.col("uv"))), F.lit(0)) / F.lit(days)).alias(f"{s}_pre"),
        ]
    g = daily.groupBy("category").agg(*aggs)
    d = dau.where(in_period("dt", lo, end))
    g = g.withColumn("dau_cur", d.where(week).agg(F.sum("uv_all") / F.lit(days)).scalar())
    g = g.withColumn("dau_pre", d.where(prior).agg(F.sum("uv_all") / F.lit(days)).scalar())
    out = [F.col("category"), r("dau_cur", 4).alias("dau")]
    for s in STAGES:
        out += [r(f"{s}_cur", 4).alias(f"{s}"), r(change(f"{s}_cur", f"{s}_pre")).alias(f"{s}_wow")]
    pairs = {
        "exp_dau": ("exp", "dau"), "detail_dau": ("detail", "dau"), "detail_exp": ("detail", "exp"), "pay_detail": ("pay", "detail"),
        "order_detail": ("order", "detail"), "pay_order": ("pay", "order"), "pay_exp": ("pay", "exp"), "pay_dau": ("pay", "dau"), "order_dau": ("order", "dau"),
    }
    for k, (n, m) in pairs.items():
        cur, pre = ratio(f"{n}_cur", f"{m}_cur"), ratio(f"{n}_pre", f"{m}_pre")
        out += [r(cur).alias(k), r(change(cur, pre)).alias(f"{k}_wow")]
    return g.select(*out)


def brand_trend_yoy(stage_events: DataFrame, dau: DataFrame, end: str, weeks: int = 8, fixed_days: float | None = None) -> DataFrame:
    """Weekly means of this year and of the same weeks 364 days earlier, on an aligned week end."""
    span = 7 * weeks - 1
    this_year = in_period("dt", shift(end, -span), end)
    last_year = in_period("dt", shift(end, -span - 364), shift(end, -364))
    e = stage_events.where((this_year | last_year) & F.col("category").isNotNull())
    distinct = e.groupBy("dt", "stage", "category", "entity").agg(F.lit(1).alias("one"))
    both = distinct.select("dt", "stage", "entity", F.explode(F.array(F.col("category"), F.lit("all"))).alias("category"))
    daily = both.groupBy("dt", "stage", "category", "entity").agg(F.lit(1).alias("one")).groupBy("dt", "stage", "category").agg(F.count("one").alias("uv"))
    per_stage = daily.groupBy(week_start("dt").alias("week_start"), "category", "stage").agg(
        (F.sum("uv") / (F.lit(fixed_days) if fixed_days else F.count_distinct("dt"))).alias("v")
    )
    wk = per_stage.groupBy("week_start", "category").agg(
        *[F.coalesce(F.max(F.when(F.col("stage") == s, F.col("v"))), F.lit(0.0)).alias(s) for s in STAGES]
    )
    dw = dau.where(this_year | last_year).groupBy(week_start("dt").alias("week_start")).agg(F.avg("uv_all").alias("dau"))
    out = wk.join(dw, "week_start", "left")
    cur = F.col("week_start") >= F.lit(shift(end, -span)).cast("date")
    old = F.col("week_start").between(F.lit(shift(end, -span - 364)).cast("date"), F.lit(shift(end, -364)).cast("date"))
    return out.where(cur | old).select(
        "category", F.when(cur, "this").otherwise("last").alias("year_label"), "week_start",
        F.date_add("week_start", 6).alias("week_end"),
        F.when(cur, F.date_add("week_start", 6)).otherwise(F.date_add("week_start", 370)).alias("aligned_end"),
        r("dau", 4).alias("dau"), *[r(s, 4).alias(s) for s in STAGES],
        r(ratio("pay", "dau")).alias("pay_dau"), r(ratio("pay", "exp")).alias("pay_exp"), r(ratio("exp", "dau")).alias("exp_dau"),
        r(ratio("detail", "dau")).alias("detail_dau"), r(ratio("detail", "exp")).alias("detail_exp"),
        r(ratio("pay", "detail")).alias("pay_detail"), r(ratio("order", "detail")).alias("order_detail"), r(ratio("pay", "order")).alias("pay_order"),
    )


def structure_share(panel: DataFrame, end: str, measures: Sequence[str] = ("pay_pv", "uv_all", "exp_uv", "exp_pv")) -> DataFrame:
    """Share of each member in its dimension this week and the relative change of that share."""
    s = window_sums(panel.where(F.col("tag") != "overall"), ["tag", "member"], list(measures), kpi_periods(end))
    w = W.partitionBy("tag")
    out = [F.col("tag"), F.col("member")]
    for m in measures:
        cur, pre = F.floor(ratio(f"{m}_week", "days_week")), F.floor(ratio(f"{m}_prior", "days_prior"))
        share, before = ratio(cur, F.sum(cur).over(w)), ratio(pre, F.sum(pre).over(w))
        out += [cur.cast("long").alias(f"{m}_week"), r(share).alias(f"{m}_share"), r(change(share, before)).alias(f"{m}_share_wow")]
    return s.select(*out)


def page_penetration(log: DataFrame, home: str) -> DataFrame:
    """Weekly mean of daily page users over daily home-page users; ``log(dt, user_id, page)``."""
    users = log.groupBy("dt", "page", "user_id").agg(F.lit(1).alias("one"))
    daily = users.groupBy("dt", "page").agg(F.count("one").alias("uv"))
    base = daily.where(F.col("page") == home).select("dt", F.col("uv").alias("home_uv"))
    j = daily.where(F.col("page") != home).join(base, "dt", "left")
    g = j.groupBy(week_end("dt").alias("week_end"), "page").agg(F.avg("home_uv").alias("home_uv"), F.avg("uv").alias("page_uv"))
    return g.withColumn("penetration", ratio("page_uv", "home_uv"))


def mom_yoy(panel: DataFrame, month: str, metrics: Mapping[str, Column] | None = None, keys: Sequence[str] = ("tag", "member")) -> DataFrame:
    """Month mean, change on the previous month and on the same month last year, one row per metric.

    Volumes change relatively; ratios are computed from the month's means first.
    """
    y, m = int(month[:4]), int(month[5:7])
    prev = f"{y - (m == 1):04d}-{(m - 2) % 12 + 1:02d}"
    last = f"{y - 1:04d}-{m:02d}"
    mk = month_key("dt")
    cols = sorted(set(VOLUMES) | {"exp_pv"})
    lo, hi = f"{y - 1:04d}-{m:02d}-01", F.last_day(F.lit(f"{month}-01").cast("date"))
    aggs = [F.avg(F.when(mk == label, F.col(c))).alias(f"{c}_{p}") for c in cols for p, label in (("cur", month), ("prev", prev), ("last", last))]
    g = panel.where(F.col("dt").between(F.lit(lo).cast("date"), hi)).groupBy(*keys).agg(*aggs)
    names = {**{v: lambda p, v=v: F.col(f"{v}_{p}") for v in VOLUMES}, **{k: lambda p, k=k: rate(k, f"_{p}") for k in RATES}}
    rows = [
        F.struct(F.lit(k).alias("metric"), f("cur").cast("double").alias("value"), pct_change(f("cur"), f("prev")).alias("mom"), pct_change(f("cur"), f("last")).alias("yoy"))
        for k, f in names.items()
    ]
    return g.select(*keys, F.explode(F.array(*rows)).alias("m")).select(*keys, "m.*").where(F.col("value").isNotNull())


def structure_table(panel: DataFrame, tag: str, month: str, use_exposure: bool = False) -> DataFrame:
    """Member traffic and order volume with shares of the overall row and month-over-month changes."""
    m = mom_yoy(panel.where(F.col("tag").isin("overall", tag)), month).where(F.col("metric").isin("uv_all", "exp_uv", "pay_pv"))
    wide = m.groupBy("tag", "member").pivot("metric", ["uv_all", "exp_uv", "pay_pv"]).agg(F.first("value").alias("value"), F.first("mom").alias("mom"))
    o = wide.where(F.col("tag") == "overall")
    flow = "exp_uv" if use_exposure else "uv_all"
    rows = wide.where(F.col("tag") == tag)
    rows = rows.withColumn("_dau", o.select("uv_all_value").scalar()).withColumn("_pay", o.select("pay_pv_value").scalar())
    return rows.select(
        "member", F.col(f"{flow}_value").alias("flow"), (ratio(f"{flow}_value", "_dau") * 100).alias("flow_share"), F.col(f"{flow}_mom").alias("flow_mom"),
        F.col("pay_pv_value").alias("orders"), (ratio("pay_pv_value", "_pay") * 100).alias("orders_share"), F.col("pay_pv_mom").alias("orders_mom"),
    )


def driver_stage(wow: DataFrame, flat: float = 0.01, exposure_alert: float = -0.03) -> DataFrame:
    """Direction of the headline rate and the stage that moved most; input is :func:`funnel_wow`."""
    stages = ["exp_dau", "detail_exp", "order_detail", "pay_order"]
    top = F.reduce(
        F.array(*[F.struct(F.abs(F.coalesce(F.col(f"{s}_wow"), F.lit(0.0))).alias("a"), F.lit(-i).alias("i"), F.lit(s).alias("s"), F.col(f"{s}_wow").alias("w")) for i, s in enumerate(stages)]),
        F.struct(F.lit(-1.0).alias("a"), F.lit(-99).alias("i"), F.lit("").alias("s"), F.lit(0.0).alias("w")),
        lambda acc, x: F.greatest(acc, x),
    )
    return wow.select(
        "tag", "member",
        F.when(F.col("pay_dau_wow") > flat, "up").when(F.col("pay_dau_wow") < -flat, "down").when(F.col("pay_dau_wow").isNotNull(), "flat").alias("direction"),
        (F.col("exp_dau_wow") < exposure_alert).alias("exposure_alert"),
        top["s"].alias("stage"), top["w"].alias("stage_wow"),
    )


def dimension_movers(wow: DataFrame, metric: str) -> DataFrame:
    """One row per member: its direction, whether it is the extreme one of its dimension, and the dimension's shape
    (rising, falling or mixed) with the members on either side counted."""
    x = F.col(metric)
    d = wow.where((F.col("tag") != "overall") & x.isNotNull()).select("tag", "member", x.alias("change"))
    key = F.struct("change", "member")
    g = d.groupBy(F.col("tag").alias("_tag")).agg(
        F.count(F.when(F.col("change") > 0, 1)).alias("n_up"), F.count(F.when(F.col("change") < 0, 1)).alias("n_down"),
        F.max(F.when(F.col("change") > 0, key)).alias("_up"), F.min(F.when(F.col("change") < 0, key)).alias("_down"),
    )
    at = lambda c: F.coalesce(F.col("member") == F.col(f"{c}.member"), F.lit(False))
    return d.join(g, F.col("tag") == F.col("_tag")).select(
        "tag", "member", "change", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("flat").alias("direction"),
        F.when(F.col("n_down") == 0, "rising").when(F.col("n_up") == 0, "falling").otherwise("mixed").alias("shape"),
        "n_up", "n_down", at("_up").alias("is_top_up"), at("_down").alias("is_top_down"),
    )


def wow_row(trend: DataFrame, keys: Sequence[str], period: str, metrics: Sequence[str]) -> DataFrame:
    """Last period over the one before, only where two periods exist."""
    w = W.partitionBy(*keys).orderBy(period)
    last = F.lead(period).over(w).isNull()
    t = trend.withColumns({f"_p_{m}": F.lag(m).over(w) for m in metrics} | {"_last": last, "_has": F.lag(period).over(w).isNotNull()})
    return t.where("_last and _has").select(*keys, period, *[r(change(m, f"_p_{m}")).alias(f"{m}_wow") for m in metrics])


def panel_qc(panel: DataFrame, end: str, weeks: int, expected_weeks: int, month: str) -> DataFrame:
    """Sanity rows before a report is published: stage order, bounds, weeks present and spaced, no leak."""
    w = weekly_trend(panel, end, weeks)
    k = W.partitionBy("tag", "member").orderBy("week_start")
    w = w.withColumn("_gap", F.datediff("week_start", F.lag("week_start").over(k)))
    bad = lambda cond: F.count(F.when(cond, 1))
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    rows = w.agg(
        bad(~((F.col("exp_uv") >= F.col("detail_uv")) & (F.col("detail_uv") >= F.col("pay_pv")))).alias("stage_order"),
        bad(outside("detail_dau") | outside("exp_dau")).alias("rate_bounds"), bad(F.col("_gap") != 7).alias("week_spacing"), F.count("*").alias("n"),
    )
    per = w.groupBy("tag", "member").agg(F.count("*").alias("c"), F.max("week_start").alias("mx")).withColumn("_latest", w.agg(F.max("week_start").alias("x")).scalar())
    rows2 = per.agg(bad(F.col("c") != expected_weeks).alias("week_count"), bad(F.col("mx") != F.col("_latest")).alias("same_latest_week"), F.count("*").alias("n"))
    rows3 = panel.agg(bad(month_key("dt") > month).alias("month_leak"), F.count("*").alias("n"))

    def long(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.unpivot(["n"], list(names), "check", "n_bad").select("check", "n_bad", F.col("n").alias("n_rows"))

    return long(rows, ["stage_order", "rate_bounds", "week_spacing"]).unionByName(long(rows2, ["week_count", "same_latest_week"])).unionByName(long(rows3, ["month_leak"]))
