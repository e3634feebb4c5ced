"""Time series: resampling, change, control charts, seasonality and simple forecasts.

Inputs are already aggregated to one row per (key, period), so a key is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import change, ratio


def resample(df: DataFrame, dt: str, keys: Sequence[str], sums: Sequence[str], rates: Mapping[str, tuple[str, str]], grain: str | None = None) -> DataFrame:
    """Sum counts per period and recompute rates; the grain follows from the date range when not given."""
    if grain is None:
        span = df.agg((F.datediff(F.max(dt), F.min(dt)) + 1).alias("d")).scalar()
        g = F.when(span < 90, "DAY").when(span <= 365, "WEEK").when(span <= 3 * 365, "MONTH").otherwise("QUARTER")
    else:
        g = F.lit(grain.upper())
    # The scalar subquery is evaluated once and folded into the grouping expression.
    period = F.call_function("date_trunc", g, F.col(dt).cast("timestamp")).cast("date")
    out = df.groupBy(*keys, period.alias("period")).agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumns({k: ratio(n, d) for k, (n, d) in rates.items()})


ROLLING = {"day": 7, "week": 4, "month": 3}


def pop_changes(df: DataFrame, keys: Sequence[str], period: str, c: str, rolling: int, year_lag: int) -> DataFrame:
    """Change on the previous period (or 'new'), on the same period a year ago, rolling mean and cumulative total."""
    w = W.partitionBy(*keys).orderBy(period)
    prev, last = F.lag(c).over(w), F.lag(c, year_lag).over(w)
    d = df.withColumns({"_p": prev, "_y": last})
    return d.withColumns({
        "abs_change": F.col(c) - F.col("_p"), "pct_change": change(c, "_p", 100.0), "is_new": F.coalesce((F.col("_p") == 0) & (F.col(c) != 0), F.lit(False)), "yoy_pct": change(c, "_y", 100.0),
        "rolling_mean": F.avg(c).over(w.rowsBetween(-(rolling - 1), 0)), "cumulative": F.sum(c).over(w.rowsBetween(W.unboundedPreceding, 0)),
    }).drop("_p", "_y")


def control_chart(df: DataFrame, keys: Sequence[str], order: str, c: str, sigma: float = 3.0, window: int | None = None) -> DataFrame:
    """Centre, limits and the four run rules per point.

    Rule 1 uses ``sigma``; rules 2 and 3 use two and one deviations; rule 4 counts eight points on one side.
    """
    base = W.partitionBy(*keys)
    o = base.orderBy(order)
    x = F.col(c).cast("double")
    d = df.where(F.col(c).isNotNull())
    if window and window >= 2:
        r = o.rowsBetween(-(window - 1), 0)
        enough = F.count(c).over(r) >= 2
        centre, sd = F.when(enough, F.avg(x).over(r)), F.when(enough, F.stddev_samp(x).over(r))
    else:
        centre, sd = F.avg(x).over(base), F.stddev_samp(x).over(base)
    d = d.withColumns({"center": centre, "sd": sd})
    d = d.withColumn("z", F.when(F.col("sd").isNull(), F.lit(None).cast("double")).when(F.col("sd") > 0, (x - F.col("center")) / F.col("sd")).otherwise(0.0))
    z = F.col("z")

    def k_of(n: int, k: int, cond: Column) -> Column:
        f = o.rowsBetween(-(n - 1), 0)
        return (F.count(z).over(f) == n) & (F.count(F.when(cond, 1)).over(f) >= k)

    above, below = x > F.col("center"), x < F.col("center")
    rules = {
        "rule1": F.abs(z) > sigma, "rule2": k_of(3, 2, z > 2) | k_of(3, 2, z < -2), "rule3": k_of(5, 4, z > 1) | k_of(5, 4, z < -1), "rule4": k_of(8, 8, above) | k_of(8, 8, below),
    }
    return d.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()} | {"ucl": F.col("center") + sigma * F.col("sd"), "lcl": F.col("center") - sigma * F.col("sd")})


def rate_of_change_anomaly(df: DataFrame, keys: Sequence[str], order: str, c: str, factor: float = 2.0) -> DataFrame:
    """Points whose change exceeds ``factor`` times the mean absolute change."""
    d = df.withColumn("change", F.col(c) - F.lag(c).over(W.partitionBy(*keys).orderBy(order)))
    d = d.withColumn("mean_abs_change", F.avg(F.abs("change")).over(W.partitionBy(*keys)))
    return d.where(F.abs("change") > factor * F.col("mean_abs_change"))


def structural_break(df: DataFrame, keys: Sequence[str], order: str, c: str) -> DataFrame:
    """Mean, variance and slope of the first against the second half of every series."""
    w = W.partitionBy(*keys)
    i = F.row_number().over(w.orderBy(order)) - 1
    d = df.withColumns({"_i": i.cast("double"), "_n": F.count("*").over(w)}).withColumn("_h", F.when(F.col("_i") < F.floor(F.col("_n") / 2), 1).otherwise(2))
    x = F.col(c).cast("double")
    half = lambda h, col: F.when(F.col("_h") == h, col)
    aggs = []
    for h in (1, 2):
        aggs += [F.avg(half(h, x)).alias(f"mean_{h}"), F.var_samp(half(h, x)).alias(f"var_{h}"), F.regr_slope(half(h, x), half(h, F.col("_i"))).alias(f"slope_{h}"), F.count(half(h, x)).alias(f"n_{h}")]
    g = d.groupBy(*keys).agg(*aggs)
    se = F.sqrt(F.col("var_1") / F.col("n_1") + F.col("var_2") / F.col("n_2"))
    g = g.withColumn("t", F.try_divide(F.col("mean_2") - F.col("mean_1"), se))
    broke = (F.abs("t") > 2) | (F.greatest("var_1", "var_2") > 4 * F.least("var_1", "var_2")) | (F.signum("slope_1") * F.signum("slope_2") < 0)
    return g.withColumn("structural_break", F.coalesce(broke, F.lit(False)))


def indexed(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.withColumn("_i", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("double"))


def linear_trend(df: DataFrame, keys: Sequence[str], order: str, c: str) -> DataFrame:
    """Slope per step and direction; residual spread over half the mean is 'volatile', under five points 'unknown'."""
    d = indexed(df.where(F.col(c).isNotNull()), keys, order)
    x = F.col(c).cast("double")
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.regr_slope(x, F.col("_i")).alias("slope"), F.regr_intercept(x, F.col("_i")).alias("intercept"), F.regr_syy(x, F.col("_i")).alias("_yy"), F.regr_sxy(x, F.col("_i")).alias("_xy"))
    resid = F.sqrt(F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0)) / F.col("n"))
    g = g.withColumns({"cv_resid": F.try_divide(resid, F.abs("mean")), "rel_slope": F.try_divide("slope", F.abs("mean"))})
    trend = (
        F.when(F.col("n") < 5, "unknown").when(F.col("mean") == 0, "stable").when(F.col("cv_resid") > 0.5, "volatile").when(F.col("rel_slope") > 0.01, "increasing")
        .when(F.col("rel_slope") < -0.01, "decreasing").otherwise("stable")
    )
    return g.withColumn("trend", trend).drop("_yy", "_xy")


def autocorrelation(df: DataFrame, keys: Sequence[str], order: str, c: str, max_lag: int) -> DataFrame:
    """(keys, lag, acf, n): every point meets only the ``max_lag`` points after it, as an equi-join on position."""
    w = W.partitionBy(*keys)
    x = F.col(c).cast("double")
    d = indexed(df.where(F.col(c).isNotNull()), keys, order).withColumns({"_n": F.count("*").over(w), "_m": F.avg(x).over(w), "_v": F.var_pop(x).over(w)})
    d = d.where("_v > 0 and _n >= 4").select(*keys, F.col("_i").cast("long").alias("_i"), (x - F.col("_m")).alias("_x"), "_n", "_v")
    lags = F.sequence(F.lit(1), F.least(F.lit(max_lag), F.floor(F.col("_n") / 2)).cast("int"))
    a = d.withColumn("lag", F.explode(lags)).withColumn("_j", F.col("_i") + F.col("lag"))
    b = d.select(*keys, F.col("_i").alias("_j"), F.col("_x").alias("_y"))
    j = a.join(b, [*keys, "_j"])
    g = j.groupBy(*keys, "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("_c"), F.max("_v").alias("_v"), F.max("_n").alias("n"))
    return g.select(*keys, "lag", (F.col("_c") / F.col("_v")).alias("acf"), "n")


def acf_peaks(acf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Local maxima above 2/√n."""
    w = W.partitionBy(*keys).orderBy("lag")
    p = acf.withColumns({"_l": F.lag("acf").over(w), "_r": F.lead("acf").over(w)})
    return p.where((F.col("acf") > F.col("_l")) & (F.col("acf") > F.col("_r")) & (F.col("acf") > 2.0 / F.sqrt("n"))).drop("_l", "_r")


def seasonality(df: DataFrame, keys: Sequence[str], order: str, c: str, max_lag: int = 365) -> DataFrame:
    """Dominant period, strength and number of significant peaks per series."""
    acf = autocorrelation(df, keys, order, c, max_lag)
    best = acf_peaks(acf, keys).groupBy(*keys).agg(F.count("*").alias("n_peaks"), F.max(F.struct(F.col("acf"), -F.col("lag"))).alias("_b"))
    series = acf.groupBy(*keys).agg(F.max("n").alias("n"))
    j = series.join(best, list(keys), "left")
    s = F.coalesce(F.col("_b.acf"), F.lit(0.0))
    return j.select(*keys, "n", F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), (-F.col("_b.col2")).alias("dominant_period"), s.alias("strength"),
                    F.when(F.col("_b").isNull(), "none").when(s > 0.5, "strong").when(s > 0.3, "moderate").otherwise("weak").alias("label"))


def prepare_series(df: DataFrame, keys: Sequence[str], order: str, c: str) -> DataFrame:
    """Carry the last value forward and drop the empty start."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(c, F.last(c, ignorenulls=True).over(w)).where(F.col(c).isNotNull())


def naive_forecast(df: DataFrame, keys: Sequence[str], order: str, c: str, periods: int, window: int = 7, cycle: int = 7) -> DataFrame:
    """Four baselines per series: last value, mean of the last ``window``, drift, and last cycle repeated."""
    w = W.partitionBy(*keys)
    d = df.where(F.col(c).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(F.desc(order))), "_n": F.count("*").over(w)})
    x = F.col(c).cast("double")
    g = d.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.max(F.when(F.col("_r") == 1, x)).alias("_last"), F.max(F.when(F.col("_r") == F.col("_n"), x)).alias("_first"), F.avg(F.when(F.col("_r") <= window, x)).alias("_mean"),
        # At most one cycle of values.
        F.sort_array(F.collect_list(F.when(F.col("_r") <= cycle, F.struct((-F.col("_r")).alias("k"), x.alias("v"))))).alias("_cycle"),
    )
    g = g.withColumn("_step", F.coalesce(F.try_divide(F.col("_last") - F.col("_first"), F.col("n") - 1), F.lit(0.0)))
    f = g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    at = F.get("_cycle", F.pmod(F.col("h") - 1, F.size("_cycle")))["v"]
    return f.select(*keys, "h", F.col("_last").alias("last"), F.col("_mean").alias("mean"), (F.col("_last") + F.col("_step") * F.col("h")).alias("drift"), at.alias("seasonal_naive"))


# --- exponential smoothing: one small series at a time ----------------------------

def _smooth(x: np.ndarray, alpha: float, beta: float | None, period: int | None, gamma: float = 0.1):
    """Filtered values and one-step-ahead forecasts of simple, Holt or additive Holt-Winters smoothing."""
    n = len(x)
    filtered, ahead = np.empty(n), np.empty(n)
    if period:
        level = x[:period].mean()
        trend = (x[period:2 * period].mean() - level) / period
        season = list(x[:period] - level)
    else:
        level, trend = x[0], (x[1] - x[0] if beta is not None and n > 1 else 0.0)
        season = [0.0]
    m = len(season)
    b = beta if beta is not None else 0.0
    filtered[0] = ahead[0] = level + season[0]
    for i in range(1, n):
        s = season[i % m]
        ahead[i] = level + trend + s
        new = alpha * (x[i] - s) + (1 - alpha) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend if beta is not None else 0.0
        level = new
        if period:
            season[i % m] = gamma * (x[i] - level) + (1 - gamma) * s
            filtered[i] = level + s
        else:
            filtered[i] = level
    return filtered, ahead


def _best_alpha(loss, lo: float = 0.01, hi: float = 0.99, tol: float = 1e-5) -> float:
    """Golden-section search of a bounded minimum."""
    g = (5 ** 0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = loss(a), loss(b)
    while hi - lo > tol:
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = loss(b)
    return (lo + hi) / 2


def exp_smoothing(df: DataFrame, keys: Sequence[str], order: str, c: str, alpha: float | None = None, beta: float | None = None, period: int | None = None, fit_on: str = "filtered") -> DataFrame:
    """Smoothed values per series; ``fit_on`` says whether alpha minimises the filtered or the one-step error.

    Series shorter than two cycles have no seasonal start: their smoothed values come from the model without a
    season, and ``model`` says so.
    """
    b = 0.1 if period and beta is None else beta

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[c].to_numpy(dtype=float)
        p = period if period and len(x) >= 2 * period else None
        pick = 0 if fit_on == "filtered" else 1
        loss = lambda a: float(np.mean((x - _smooth(x, a, b, p)[pick]) ** 2))
        a = alpha if alpha is not None else _best_alpha(loss)
        filtered, ahead = _smooth(x, a, b, p)
        return pdf[[*keys, order, c]].assign(filtered=filtered, one_step=ahead, alpha=a, model="seasonal" if p else "trend" if b is not None else "level")

    s = df.select(*keys, order, F.col(c).cast("double").alias(c)).where(F.col(c).isNotNull())
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields] + ["filtered double", "one_step double", "alpha double", "model string"])
    return s.groupBy(*keys).applyInPandas(run, schema)


def calendar_patterns(df: DataFrame, dt: str, c: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean by weekday and by month in one scan."""
    slots = F.array(F.struct(F.lit("weekday").alias("pattern"), F.date_format(dt, "EEEE").alias("slot")), F.struct(F.lit("month").alias("pattern"), F.date_format(dt, "MMM").alias("slot")))
    d = df.select(*keys, F.col(c).cast("double").alias("_x"), F.explode(slots).alias("s"))
    return d.groupBy(*keys, "s.pattern", "s.slot").agg(F.avg("_x").alias("mean"))


def monthly_seasonality(patterns: DataFrame, keys: Sequence[str] = (), limit: float = 0.2) -> DataFrame:
    """Population variation of the month means over ``limit`` means seasonal; fewer than three months never is."""
    g = patterns.where("pattern = 'month'").groupBy(*keys).agg(F.count("*").alias("months"), F.try_divide(F.stddev_pop("mean"), F.abs(F.avg("mean"))).alias("cv"))
    return g.withColumn("seasonal", (F.col("months") >= 3) & F.coalesce(F.col("cv") > limit, F.lit(False)))


def series_anomalies(df: DataFrame, keys: Sequence[str], order: str, metrics: Sequence[str], window: int, threshold: float) -> DataFrame:
    """Spikes above and drops below the rolling band of each metric, with the distance from the mean in percent."""
    long = df.unpivot([*keys, order], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    w = W.partitionBy(*keys, "metric").orderBy(order).rowsBetween(-(window - 1), 0)
    enough = F.count("value").over(w) >= 3
    d = long.withColumns({"mean": F.when(enough, F.avg("value").over(w)), "sd": F.when(enough, F.stddev_samp("value").over(w))})
    kind = F.when(F.col("value") > F.col("mean") + threshold * F.col("sd"), "spike").when(F.col("value") < F.col("mean") - threshold * F.col("sd"), "drop")
    d = d.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.col("mean") != 0))
    return d.withColumn("pct_distance", F.abs(F.col("value") - F.col("mean")) / F.abs("mean") * 100)


def seasonal_residual(df: DataFrame, keys: Sequence[str], order: str, c: str, period: int) -> DataFrame:
    """Residual after the linear trend and the mean of each position in the cycle."""
    d = indexed(df, keys, order)
    x, w = F.col(c).cast("double"), W.partitionBy(*keys)
    d = d.withColumn("detrended", x - (F.regr_intercept(x, F.col("_i")).over(w) + F.regr_slope(x, F.col("_i")).over(w) * F.col("_i")))
    d = d.withColumn("season", F.avg("detrended").over(W.partitionBy(*keys, F.pmod(F.col("_i").cast("int"), F.lit(period)))))
    return d.withColumn("residual", F.col("detrended") - F.col("season")).drop("_i")


def segment_divergence(df: DataFrame, segment: str, order: str, c: str) -> DataFrame:
    """Slope per segment and whether its sign differs from the total's."""
    g = df.groupBy(segment, order).agg(F.sum(c).alias("_y"))
    seg = indexed(g, [segment], order).groupBy(segment).agg(F.regr_slope("_y", "_i").alias("slope"))
    total = indexed(df.groupBy(order).agg(F.sum(c).alias("_y")), [], order).agg(F.regr_slope("_y", "_i").alias("s"))
    return seg.withColumn("total_slope", total.scalar()).withColumn("diverges", F.signum("slope") * F.signum("total_slope") < 0)
