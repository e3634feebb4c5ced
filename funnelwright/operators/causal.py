"""Experiments, difference-in-differences and impact sizing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions import dist
from funnelwright.functions.scalars import change, in_period, ratio
from funnelwright.operators.panel import COUNTS, RATES, rate, window_sums
from funnelwright.operators.ordered import running
from funnelwright.operators.relations import interval_join
from funnelwright.operators.stats import Z975, chi2_independence, prop_ztest, welch_ttest

DID_VOLUMES = ("uv_all", "pay_pv", "detail_uv")
DID_RATES = ("pay_dau", "detail_dau", "pay_detail", "exp_dau")


def _metric_rows(periods: Sequence[str]) -> Column:
    """Daily means of volumes and ratios of sums for every period, one struct per metric."""
    rows = []
    for v in DID_VOLUMES:
        rows.append(F.struct(F.lit(v).alias("metric"), *[ratio(f"{v}_{p}", f"days_{p}").alias(p) for p in periods]))
    for k in DID_RATES:
        rows.append(F.struct(F.lit(k).alias("metric"), *[rate(k, f"_{p}").alias(p) for p in periods]))
    rows.append(F.struct(F.lit("pv_per_user").alias("metric"), *[ratio(f"exp_pv_{p}", f"exp_uv_{p}").alias(p) for p in periods]))
    return F.array(*rows)


def period_metrics(panel: DataFrame, periods: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, metric, one column per named window) from one scan."""
    s = window_sums(panel, keys, list(COUNTS), periods)
    return s.select(*keys, F.explode(_metric_rows(list(periods))).alias("m")).select(*keys, "m.*")


def did_relative(panel: DataFrame, windows: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """Relative change of the treated year less that of the reference year; windows are
    ``pre``, ``post``, ``ref_pre``, ``ref_post``."""
    m = period_metrics(panel, windows, keys)
    m = m.withColumns({"change_treated": change("post", "pre"), "change_ref": change("ref_post", "ref_pre")})
    return m.withColumn("did", F.col("change_treated") - F.col("change_ref"))


def counterfactual_gap(did: DataFrame) -> DataFrame:
    """What the treated period would have been at the reference's pace, and the gap to it."""
    d = did.withColumn("expected", F.col("pre") * (1 + F.col("change_ref")))
    return d.withColumns({"gap": F.col("post") - F.col("expected"), "rel_gap": change("post", "expected")})


def gap_progress(panel: DataFrame, windows: Mapping[str, tuple[str, str]], long_post: tuple[str, str]) -> DataFrame:
    """Is the gap of the longer window smaller than that of the shorter one? Both come from one scan."""
    m = period_metrics(panel, {**windows, "post_long": long_post})
    expected = F.col("pre") * (1 + change("ref_post", "ref_pre"))
    m = m.withColumns({"gap_short": change("post", expected), "gap_long": change("post_long", expected)})
    return m.withColumn("narrowing", F.abs("gap_long") < F.abs("gap_short"))


def day_compare(panel: DataFrame, day: str, baselines: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One day beside reference days or window means, with changes."""
    m = period_metrics(panel, {"day": (day, day), **baselines})
    return m.select("metric", F.col("day").alias("value"), *[F.col(b) for b in baselines], *[change("day", b).alias(f"vs_{b}") for b in baselines])


def daily_yoy(panel: DataFrame, year: int, metrics: Sequence[str]) -> DataFrame:
    """Each day beside the same month-day a year earlier."""
    p = panel.where(in_period("dt", f"{year - 1}-01-01", f"{year}-12-31")).withColumn("_md", F.date_format("dt", "MM-dd"))
    cur = p.where(F.year("dt") == year)
    old = p.where(F.year("dt") == year - 1).select("tag", "member", "_md", *[F.col(m).alias(f"{m}_last") for m in metrics])
    j = cur.join(old, ["tag", "member", "_md"], "left")
    return j.select("tag", "member", "dt", *metrics, *[f"{m}_last" for m in metrics], *[change(m, f"{m}_last").alias(f"{m}_yoy") for m in metrics])


def did(df: DataFrame, treated: Column, post: Column, y: str, t: Column) -> DataFrame:
    """Difference-in-differences of means with both groups' trends before the change."""
    d = df.select(treated.alias("_t"), post.alias("_p"), F.col(y).cast("double").alias("_y"), t.cast("double").alias("_x"))
    cell = lambda a, b: F.avg(F.when((F.col("_t") == a) & (F.col("_p") == b), F.col("_y")))
    slope = lambda a: F.regr_slope(F.when((F.col("_t") == a) & ~F.col("_p"), F.col("_y")), F.when((F.col("_t") == a) & ~F.col("_p"), F.col("_x")))
    g = d.agg(cell(True, False).alias("t_pre"), cell(True, True).alias("t_post"), cell(False, False).alias("c_pre"), cell(False, True).alias("c_post"), slope(True).alias("t_slope"), slope(False).alias("c_slope"))
    return g.withColumns({"did": (F.col("t_post") - F.col("t_pre")) - (F.col("c_post") - F.col("c_pre")), "trend_gap": F.col("t_slope") - F.col("c_slope")})


def pre_post(df: DataFrame, dt: str, y: str, day: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean before and after a day, normal interval, prior trend and the same comparison a year earlier."""
    x, d = F.col(y).cast("double"), F.datediff(dt, F.lit(day).cast("date"))
    pre, post = d.between(-days, -1), d.between(0, days - 1)
    lpre, lpost = d.between(-days - 364, -365), d.between(-364, days - 365)
    g = df.where(d.between(-days - 364, days - 1)).groupBy(*keys).agg(
        *[f(F.when(c, x)).alias(f"{n}_{s}") for s, c in (("pre", pre), ("post", post)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))],
        F.regr_slope(F.when(pre, x), F.when(pre, d.cast("double"))).alias("prior_trend"),
        F.avg(F.when(lpre, x)).alias("last_pre"), F.avg(F.when(lpost, x)).alias("last_post"),
    )
    se = F.sqrt(F.col("var_pre") / F.col("n_pre") + F.col("var_post") / F.col("n_post"))
    diff = F.col("mean_post") - F.col("mean_pre")
    return g.withColumns({"diff": diff, "ci_lower": diff - Z975 * se, "ci_upper": diff + Z975 * se, "last_year_diff": F.col("last_post") - F.col("last_pre")})


def interrupted_series(df: DataFrame, dt: str, y: str, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Line fitted before the day, projected after it; the excess is actual less projected."""
    x, d = F.col(y).cast("double"), F.datediff(dt, F.lit(day).cast("date")).cast("double")
    pre, post = d < 0, d >= 0
    g = df.groupBy(*keys).agg(
        F.regr_slope(F.when(pre, x), F.when(pre, d)).alias("slope"), F.regr_intercept(F.when(pre, x), F.when(pre, d)).alias("intercept"),
        F.count(F.when(post, 1)).alias("n_post"), F.sum(F.when(post, x)).alias("actual"), F.sum(F.when(post, d)).alias("_d"),
    )
    g = g.withColumn("projected", F.col("intercept") * F.col("n_post") + F.col("slope") * F.col("_d"))
    return g.withColumns({"excess": F.col("actual") - F.col("projected"), "excess_rate": ratio(F.col("actual") - F.col("projected"), "projected")}).drop("_d")


def match_outcomes(df: DataFrame, treated: Column, strata: Sequence[str], outcome: str) -> DataFrame:
    """Exact matching on coarse strata: controls weighted to the treated mix, naive difference beside it."""
    y = F.col(outcome).cast("double")
    s = df.withColumn("_t", treated).groupBy(*strata).agg(
        F.count(F.when(F.col("_t"), 1)).alias("n_t"), F.count(F.when(~F.col("_t"), 1)).alias("n_c"), F.sum(F.when(F.col("_t"), y)).alias("s_t"), F.sum(F.when(~F.col("_t"), y)).alias("s_c")
    )
    both = (F.col("n_t") > 0) & (F.col("n_c") > 0)
    g = s.agg(
        F.sum(F.when(both, F.col("n_t"))).alias("matched_treated"), F.sum("n_t").alias("treated"),
        F.try_divide(F.sum(F.when(both, F.col("s_t"))), F.sum(F.when(both, F.col("n_t")))).alias("mean_treated"),
        F.try_divide(F.sum(F.when(both, F.col("n_t") * F.col("s_c") / F.col("n_c"))), F.sum(F.when(both, F.col("n_t")))).alias("mean_matched"),
        (F.try_divide(F.sum("s_t"), F.sum("n_t")) - F.try_divide(F.sum("s_c"), F.sum("n_c"))).alias("naive_diff"),
    )
    return g.withColumn("effect", F.col("mean_treated") - F.col("mean_matched"))


def match_balance(df: DataFrame, treated: Column, strata: Sequence[str], covariates: Sequence[str]) -> DataFrame:
    """Standardised mean difference of covariates before and after stratum weighting."""
    d = df.withColumn("_t", treated)
    n = d.groupBy(*strata).agg(F.count(F.when(F.col("_t"), 1)).alias("_nt"), F.count(F.when(~F.col("_t"), 1)).alias("_nc"))
    long = d.unpivot([*strata, "_t"], [F.col(c).cast("double").alias(c) for c in covariates], "covariate", "x")
    s = long.groupBy(*strata, "covariate").agg(*[f(F.when(F.col("_t") == v, F.col("x"))).alias(f"_{k}{side}") for side, v in (("t", True), ("c", False)) for k, f in (("m", F.avg), ("n", F.count))])
    g = s.where("_nt > 0 and _nc > 0").groupBy("covariate").agg(*[F.try_divide(F.sum(F.col("_nt") * F.col(f"_m{side}")), F.sum("_nt")).alias(f"w_{side}") for side in "tc"])
    raw = long.groupBy("covariate").agg(*[f(F.when(F.col("_t") == v, F.col("x"))).alias(f"{k}_{side}") for side, v in (("t", True), ("c", False)) for k, f in (("m", F.avg), ("v", F.var_samp))])
    j = raw.join(g, "covariate", "left")
    sd = F.sqrt((F.col("v_t") + F.col("v_c")) / 2)
    return j.select("covariate", F.try_divide(F.col("m_t") - F.col("m_c"), sd).alias("smd_before"), F.try_divide(F.col("w_t") - F.col("w_c"), sd).alias("smd_after"))


def assigned_outcomes(assign: DataFrame, outcomes: DataFrame, user: str, start: str, ts: str, days: int, value: str) -> DataFrame:
    """One row per assigned user: converted within the window, orders and value."""
    spans = assign.select(user, start, (F.col(start) + F.expr(f"interval {days} days")).alias("_end"))
    o = interval_join(outcomes.select(user, ts, value), spans, [user], ts, start, "_end").groupBy(user).agg(F.count("*").alias("orders"), F.sum(value).alias("revenue"))
    return assign.join(o, user, "left").fillna({"orders": 0, "revenue": 0.0}).withColumn("converted", F.col("orders") > 0)


def ab_test(assigned: DataFrame, variant: str, control, treatment) -> DataFrame:
    return prop_ztest(assigned, F.col(variant), F.col("converted"), control, treatment)


def observational_lift(events: DataFrame, user: str, did_it: Column, bought: Column) -> DataFrame:
    """Purchase rate of users with and without an event, in one pass over users."""
    u = events.groupBy(user).agg(F.coalesce(F.bool_or(did_it), F.lit(False)).alias("_e"), F.coalesce(F.bool_or(bought), F.lit(False)).alias("_b"))
    rt = lambda v: F.avg(F.when(F.col("_e") == v, F.col("_b").cast("double")))
    g = u.agg(F.count(F.when(F.col("_e"), 1)).alias("n_with"), F.count(F.when(~F.col("_e"), 1)).alias("n_without"), rt(True).alias("rate_with"), rt(False).alias("rate_without"))
    return g.withColumn("lift", change("rate_with", "rate_without"))


def decision_rule(results: DataFrame, effect: str, significant: str, guardrail_change: str, small: float = 0.05, large: float = 0.15) -> DataFrame:
    """SHIP, INVESTIGATE or DON'T SHIP; ``guardrail_change`` below zero is a loss."""
    win = F.col(significant) & (F.col(effect) > 0)
    loss = F.greatest(-F.col(guardrail_change), F.lit(0.0))
    d = F.when(~win, "DON'T SHIP").when(loss > large, "DON'T SHIP").when(loss >= small, "INVESTIGATE").otherwise("SHIP")
    primary = F.when(win, "positive").when(F.col(significant) & (F.col(effect) < 0), "negative").otherwise("null")
    return results.withColumns({"primary": primary, "guardrail": F.when(loss >= small, "degraded").otherwise("ok"), "decision": d})


def power_table(segments: DataFrame, rate_col: str, mean_col: str, sd_col: str, n_col: str, mde: float, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Users needed per arm for a relative lift of a rate and of a mean, and the lift detectable with half the segment."""
    k = (dist.norm_ppf(1 - alpha / 2) + dist.norm_ppf(power)) ** 2
    p1 = F.col(rate_col)
    p2 = p1 * (1 + mde)
    n_prop = F.ceil(k * F.try_divide(p1 * (1 - p1) + p2 * (1 - p2), (p2 - p1) * (p2 - p1)))
    delta = F.col(mean_col) * mde
    n_mean = F.ceil(F.try_divide(k * 2 * F.col(sd_col) * F.col(sd_col), delta * delta))
    half = F.floor(F.col(n_col) / 2)
    mde_abs = math.sqrt(k) * F.sqrt(F.try_divide(2 * p1 * (1 - p1), half))
    mde_mean = math.sqrt(k) * F.col(sd_col) * F.sqrt(F.try_divide(F.lit(2.0), half))
    return segments.withColumns({"n_prop": n_prop, "n_mean": n_mean, "mde_rate": mde_abs, "mde_rate_rel": F.try_divide(mde_abs, p1), "mde_mean": mde_mean})


SENSITIVITY = (0.5, 0.75, 1.0, 1.25, 1.5)


def impact_model(segments: DataFrame, key: str, users: str, improvement: str, value: str, confidence: Column, effort: Column, cost: Column, periods_per_year: float) -> DataFrame:
    """Annual impact, three scenarios, break-even improvement and priority rank per segment."""
    base = F.col(users) * F.col(improvement) * F.col(value) * F.lit(periods_per_year)
    d = segments.withColumns({
        "impact": base, "pessimistic": base * 0.5, "optimistic": base * 1.5, "break_even": F.try_divide(cost, F.col(users) * F.col(value) * F.lit(periods_per_year)),
        "priority": F.try_divide(base * confidence, effort),
    })
    # Null priorities come last; ranked piece by piece, so segments of any number do not meet in one task.
    r = running(d.withColumns({"_none": F.col("priority").isNull(), "_neg": -F.col("priority")}), [], ["_none", "_neg", key], row_number="rank")
    return r.withColumn("rank", F.col("rank").cast("int")).drop("_none", "_neg")


def sensitivity(model: DataFrame, key: str) -> DataFrame:
    """Impact when one assumption moves by ±25% and ±50%."""
    f = F.explode(F.array(*[F.lit(x) for x in SENSITIVITY])).alias("factor")
    return model.select(key, "impact", f).select(key, "factor", (F.col("impact") * F.col("factor")).alias("scenario_impact"), ((F.col("factor") - 1) * 100).alias("vs_base_pct"))


def balance_check(assign: DataFrame, variant: str, control, treatment, attrs: Sequence[str]) -> DataFrame:
    """Counts and share difference of every attribute value between arms, from one scan."""
    long = assign.unpivot([variant], [F.col(a).cast("string").alias(a) for a in attrs], "attribute", "member")
    n = lambda v: F.count(F.when(F.col(variant) == v, 1))
    g = long.groupBy("attribute", "member").agg(n(control).alias("n_control"), n(treatment).alias("n_treatment"))
    w = W.partitionBy("attribute")
    g = g.withColumns({"share_control": ratio("n_control", F.sum("n_control").over(w)), "share_treatment": ratio("n_treatment", F.sum("n_treatment").over(w))})
    return g.withColumn("share_diff", F.col("share_treatment") - F.col("share_control"))


def guardrail_check(assigned: DataFrame, variant: str, control, treatment, metrics: Sequence[str]) -> DataFrame:
    """Mean of every secondary metric per arm, relative change and Welch's t."""
    long = assigned.unpivot([variant], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "x")
    g = welch_ttest(long, F.col(variant), "x", control, treatment, keys=["metric"])
    return g.withColumn("rel_change", change("mean_b", "mean_a"))


def net_effect(assigned: DataFrame, variant: str) -> DataFrame:
    """Conversion × order value = revenue per assigned user, per arm."""
    g = assigned.groupBy(variant).agg(F.count("*").alias("users"), F.count(F.when(F.col("converted"), 1)).alias("buyers"), F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
    return g.withColumns({"conversion": ratio("buyers", "users"), "order_value": ratio("revenue", "orders"), "orders_per_buyer": ratio("orders", "buyers"), "revenue_per_user": ratio("revenue", "users")})


def abandonment(events: DataFrame, started: Column, completed: Column, value: Column, recovery: float, keys: Sequence[str] = ()) -> DataFrame:
    """Starts without completion × mean order value × recoverable share."""
    g = events.groupBy(*keys).agg(F.count(F.when(started, 1)).alias("started"), F.count(F.when(completed, 1)).alias("completed"), F.avg(F.when(completed, value)).alias("mean_value"))
    return g.withColumn("abandoned", F.greatest(F.col("started") - F.col("completed"), F.lit(0))).withColumn("recoverable", F.col("abandoned") * F.col("mean_value") * F.lit(recovery))
