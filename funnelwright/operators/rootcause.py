"""Simpson's paradox, mix effects and root-cause contribution."""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import change, ratio


def _cells(df: DataFrame, metric: str, dims: Sequence[str], comparison: str) -> DataFrame:
    """(dimension, segment, cmp, n, s) for all dimensions from one scan."""
    d = df.where(F.col(metric).isNotNull() & F.col(comparison).isNotNull())
    long = d.unpivot([F.col(comparison).cast("string").alias("cmp"), F.col(metric).cast("double").alias("y")], [F.col(x).cast("string").alias(x) for x in dims], "dimension", "segment")
    return long.where("segment is not null").groupBy("dimension", "segment", "cmp").agg(F.count("*").alias("n"), F.sum("y").alias("s"))


def _sign(a: Column, b: Column) -> Column:
    return F.when(a > b, "positive").when(a < b, "negative").when(a == b, "neutral")


def simpson_segments(df: DataFrame, metric: str, dims: Sequence[str], comparison: str, groups: tuple[str, str] | None = None) -> DataFrame:
    """Mean of both groups and the direction overall and in every segment of every dimension."""
    c = _cells(df, metric, dims, comparison)
    if groups is None:
        two = c.groupBy("dimension", "cmp").agg(F.sum("n").alias("n")).withColumn("_r", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("n"), "cmp"))).where("_r <= 2")
        c = c.join(two.select("dimension", "cmp", "_r"), ["dimension", "cmp"])
    else:
        c = c.where(F.col("cmp").isin(list(groups))).withColumn("_r", F.when(F.col("cmp") == groups[0], 1).otherwise(2))
    side = lambda r, x: F.sum(F.when(F.col("_r") == r, F.col(x)))
    g = c.groupBy("dimension", "segment").agg(*[side(r, x).alias(f"{x}_{k}") for r, k in ((1, "a"), (2, "b")) for x in ("n", "s")])
    w = W.partitionBy("dimension")
    tot = lambda k: F.sum(f"s_{k}").over(w) / F.sum(f"n_{k}").over(w)
    g = g.withColumns({"mean_a": ratio("s_a", "n_a"), "mean_b": ratio("s_b", "n_b"), "overall_a": tot("a"), "overall_b": tot("b")})
    return g.where("n_a is not null and n_b is not null").withColumns({"direction": _sign(F.col("mean_a"), F.col("mean_b")), "overall_direction": _sign(F.col("overall_a"), F.col("overall_b"))})


def simpson(df: DataFrame, metric: str, dims: Sequence[str], comparison: str, groups: tuple[str, str] | None = None) -> DataFrame:
    """Paradox when more segments reverse the overall direction than keep it."""
    s = simpson_segments(df, metric, dims, comparison, groups)
    clear = F.col("direction") != "neutral"
    rev = clear & (F.col("direction") != F.col("overall_direction"))
    g = s.groupBy("dimension").agg(F.first("overall_direction").alias("overall_direction"), F.count(F.when(clear, 1)).alias("segments"), F.count(F.when(rev, 1)).alias("reversals"))
    n = F.when(F.col("overall_direction") == "neutral", 0).otherwise(F.col("reversals"))
    share = ratio(n, "segments")
    return g.withColumns({
        "paradox": n > F.col("segments") - n, "severity": F.when((n == 0) | (F.col("segments") == 0), "none").when(share <= 0.25, "low").when(share <= 0.5, "medium").otherwise("high"),
    })


def weighted_vs_unweighted(df: DataFrame, metric: str, weight: str, segment: str) -> DataFrame:
    """Weighted overall mean against the plain mean of segment means; over 1% apart is flagged."""
    d = df.where((F.col(weight) > 0) & F.col(metric).isNotNull() & F.col(segment).isNotNull())
    g = d.groupBy(segment).agg(F.avg(metric).alias("m"), F.sum(F.col(metric) * F.col(weight)).alias("sw"), F.sum(weight).alias("w"))
    a = g.agg((F.sum("sw") / F.sum("w")).alias("weighted"), F.avg("m").alias("unweighted"), F.count("*").alias("segments"))
    a = a.withColumn("difference", F.col("weighted") - F.col("unweighted"))
    return a.withColumn("flag", F.abs("difference") > 0.01 * F.greatest(F.abs("weighted"), F.abs("unweighted"), F.lit(1e-9)))


def suggest_segments(df: DataFrame, dims: Sequence[str], k: int = 5) -> DataFrame:
    """Every dimension with the unevenness of its group sizes, penalised beyond ten values; ``suggested`` marks the
    first ``k`` of those with 2–50 values."""
    long = df.unpivot([], [F.col(d).cast("string").alias(d) for d in dims], "dimension", "member").where("member is not null")
    g = long.groupBy("dimension", "member").agg(F.count("*").alias("n")).groupBy("dimension").agg(F.count("*").alias("n_values"), (F.stddev_pop("n") / F.avg("n")).alias("cv"))
    g = g.withColumn("score", F.col("cv") / (1.0 + F.greatest(F.col("n_values") - 10, F.lit(0)) * 0.1))
    fit = F.col("n_values").between(2, 50)
    rank = F.row_number().over(W.orderBy(F.when(fit, 0).otherwise(1), F.desc("score"), "dimension"))  # one row per dimension
    return g.withColumn("suggested", fit & (rank <= k))


def contribution(df: DataFrame, dims: Sequence[str], metric: str, baseline: Column, period: Column, base_days: float, period_days: float) -> DataFrame:
    """Change of every member's daily mean, its share of the excess, and how concentrated the dimension is."""
    y = F.col(metric).cast("double")
    d = df.where(baseline | period).withColumns({"_b": F.when(baseline, y).otherwise(0.0), "_p": F.when(period, y).otherwise(0.0)})
    long = d.unpivot(["_b", "_p"], [F.col(x).cast("string").alias(x) for x in dims], "dimension", "member")
    g = long.groupBy("dimension", "member").agg((F.sum("_b") / base_days).alias("baseline"), (F.sum("_p") / period_days).alias("actual"))
    w = W.partitionBy("dimension")
    g = g.withColumn("change", F.col("actual") - F.col("baseline"))
    g = g.withColumns({"rel_change": change("actual", "baseline"), "share": F.try_divide(F.col("change"), F.sum("change").over(w))})
    g = g.withColumn("rank", F.row_number().over(w.orderBy(F.desc("share"), "member")))
    top = F.max(F.when(F.col("rank") == 1, F.col("share"))).over(w)
    top2 = F.sum(F.when(F.col("rank") <= 2, F.col("share"))).over(w)
    return g.withColumn("power", F.when(top > 0.5, "HIGH").when(top2 > 0.7, "MEDIUM").otherwise("LOW"))


def drill_down(df: DataFrame, dims: Sequence[str], metric: str, baseline: Column, period: Column, base_days: float, period_days: float, max_depth: int = 7, min_depth: int = 3, rest: float = 0.1) -> DataFrame:
    """Follow the member that explains most of the excess, level by level.

    Each level is one scan of the rows left, grouped by every dimension left on its own (the members found so far are
    filters that reach the files), and gives one row; combinations of dimensions are never formed but as pairs, when no
    dimension explains the excess alone.
    """
    y = F.col(metric).cast("double")
    source = df.where(baseline | period).select(*[F.col(d).cast("string").alias(d) for d in dims], F.when(baseline, y).otherwise(0.0).alias("_b"), F.when(period, y).otherwise(0.0).alias("_p"))

    def best(scope: DataFrame, names: Sequence[str]):
        long = scope.unpivot(["_b", "_p"], list(names), "dimension", "member").groupBy("dimension", "member").agg((F.sum("_p") / period_days - F.sum("_b") / base_days).alias("change"))
        w = W.partitionBy("dimension")
        r = long.withColumn("share", F.try_divide(F.col("change"), F.sum("change").over(w))).withColumn("rank", F.row_number().over(w.orderBy(F.desc("share"), "member")))
        g = r.groupBy("dimension").agg(F.max(F.when(F.col("rank") == 1, F.col("member"))).alias("member"), F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top"), F.sum(F.when(F.col("rank") <= 2, F.col("share"))).alias("top2"), F.sum("change").alias("excess"), F.max(F.when(F.col("rank") == 1, F.col("change"))).alias("change"))
        return g.orderBy(F.desc("top"), "dimension").first()

    schema = "level int, dimension string, member string, share double, change double, excess double, power string"
    rows, left, scope, first = [], list(dims), source, None
    for level in range(1, max_depth + 1):
        if not left:
            break
        hit = best(scope, left)
        if hit is None or hit["top"] is None:
            break
        power = "HIGH" if hit["top"] > 0.5 else "MEDIUM" if hit["top2"] > 0.7 else "LOW"
        if power == "LOW" and len(left) > 1:
            combos = {f"{a}*{b}": F.to_json(F.array(a, b)) for i, a in enumerate(left) for b in left[i + 1:]}
            pair = best(scope.withColumns(combos), list(combos))
            if pair is not None and pair["top"] is not None and pair["top"] > 0.5:
                hit, power = pair, "HIGH"
        shown = "|".join(v or "" for v in json.loads(hit["member"])) if "*" in hit["dimension"] else hit["member"]
        rows.append((level, hit["dimension"], shown, float(hit["top"]), float(hit["change"]), float(hit["excess"]), power))
        first = first if first is not None else hit["excess"]
        if power == "LOW" or (level >= min_depth and first and abs(hit["excess"] - hit["change"]) < rest * abs(first)):
            break
        used = hit["dimension"].split("*")
        values = json.loads(hit["member"]) if len(used) > 1 else [hit["member"]]
        for d, v in zip(used, values):
            scope = scope.where(F.col(d).eqNullSafe(F.lit(v)))
        left = [d for d in left if d not in used]
    return df.sparkSession.createDataFrame(rows, schema)


def isolate_check(df: DataFrame, member: Column, metric: str, baseline: Column, period: Column, base_days: float, period_days: float, limit: float = 0.1) -> DataFrame:
    """The change with and without a member: is the rest still anomalous?"""
    y = F.col(metric).cast("double")
    keep = ~F.coalesce(member, F.lit(False))
    daily = lambda cond, days: F.coalesce(F.sum(F.when(cond, y)), F.lit(0.0)) / days
    g = df.agg(daily(baseline, base_days).alias("base_all"), daily(period, period_days).alias("actual_all"), daily(baseline & keep, base_days).alias("base_rest"), daily(period & keep, period_days).alias("actual_rest"))
    g = g.withColumns({"change_all": change("actual_all", "base_all"), "change_rest": change("actual_rest", "base_rest")})
    return g.withColumn("still_anomalous", F.abs("change_rest") > limit)


def excess(df: DataFrame, dt: str, metric: str, baseline: Column, period: Column) -> DataFrame:
    """Expected from the baseline's daily mean, actual, excess, duration and ratio."""
    d = df.groupBy(dt).agg(F.sum(metric).alias("y"))
    g = d.agg(F.avg(F.when(baseline, F.col("y"))).alias("daily"), F.sum(F.when(period, F.col("y"))).alias("actual"), F.count(F.when(period, 1)).alias("days"), F.stddev_samp(F.when(baseline, F.col("y"))).alias("sd"))
    g = g.withColumn("expected", F.col("daily") * F.col("days"))
    return g.withColumns({"excess": F.col("actual") - F.col("expected"), "ratio": ratio("actual", "expected"), "excess_pct": change("actual", "expected", 100.0)})


def mix_rate(df: DataFrame, dim: str, num: Column, den: Column, pre: Column, post: Column) -> DataFrame:
    """Change in an overall rate split into mix and within-member effects; the two add up to the change."""
    g = df.groupBy(F.col(dim).alias("member")).agg(
        *[F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("double").alias(f"{k}_{p}") for p, c in (("pre", pre), ("post", post)) for k, x in (("n", num), ("d", den))]
    )
    # Totals from their own aggregation, so members of any number stay apart.
    totals = df.agg(F.struct(*[F.coalesce(F.sum(F.when(c, den)), F.lit(0)).cast("double").alias(p) for p, c in (("pre", pre), ("post", post))]).alias("t")).scalar()
    g = g.withColumn("_t", totals)
    share = lambda p: ratio(f"d_{p}", f"_t.{p}")
    g = g.withColumns({"share_pre": share("pre"), "share_post": share("post"), "rate_pre": F.coalesce(ratio("n_pre", "d_pre"), F.lit(0.0)), "rate_post": F.coalesce(ratio("n_post", "d_post"), F.lit(0.0))})
    return g.select("member", "share_pre", "share_post", "rate_pre", "rate_post", ((F.col("share_post") - F.col("share_pre")) * F.col("rate_pre")).alias("mix_effect"), (F.col("share_post") * (F.col("rate_post") - F.col("rate_pre"))).alias("rate_effect"))
