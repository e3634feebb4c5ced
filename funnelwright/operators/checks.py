"""Validation rules as rows of one schema.

check, subject, ok, severity (PASS | WARNING | BLOCKER), observed, expected, n_bad, detail.

Scan rules are aggregate columns, so any number of them runs in one pass (:func:`scan_checks`); rules that
need grouping are DataFrames, and a suite is their union.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import metric_expr, ratio
from funnelwright.operators.aggregates import gaps, prior_z
from funnelwright.operators.ordered import running
from funnelwright.operators.profile import distinct_counts, is_numeric
from funnelwright.operators.relations import orphans

FIELDS = ("check", "subject", "ok", "severity", "observed", "expected", "n_bad", "detail")
PASS, WARNING, BLOCKER = "PASS", "WARNING", "BLOCKER"


def row(check: str, subject: str, severity: Column, observed: Column | None = None, expected=None, n_bad: Column | None = None, detail: Column | None = None) -> Column:
    d = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(
        F.lit(check).alias("check"), F.lit(subject).alias("subject"), (severity == PASS).alias("ok"), severity.alias("severity"), d(observed).alias("observed"), d(expected).alias("expected"),
        (F.lit(0) if n_bad is None else n_bad).cast("long").alias("n_bad"), (F.lit("") if detail is None else detail).cast("string").alias("detail"),
    )


def scan_checks(df: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """Every rule from a single scan."""
    return df.agg(F.array(*rules).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def one(df: DataFrame, rule: Column) -> DataFrame:
    """A rule evaluated on a one-row DataFrame of already aggregated values."""
    return df.select(rule.alias("r")).select("r.*")


def levels(bad: Column, warn: Column, block: Column) -> Column:
    return F.when(block, BLOCKER).when(warn, WARNING).otherwise(PASS)


def bad_if(cond: Column, severity: str = BLOCKER) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), severity).otherwise(PASS)


def suite(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# --- scan rules ----------------------------------------------------------------

def completeness(c: str, warn: float = 0.05, block: float = 0.20) -> Column:
    rate = F.coalesce(ratio(F.count("*") - F.count(c), F.count("*")), F.lit(0.0))
    return row("completeness", c, levels(rate, rate >= warn, rate > block), rate, warn, F.count("*") - F.count(c))


def null_concentration(c: str, warn: float = 0.5, fail: float = 0.95) -> Column:
    rate = F.coalesce(ratio(F.count("*") - F.count(c), F.count("*")), F.lit(0.0))
    return row("null_concentration", c, levels(rate, rate >= warn, rate >= fail), rate, warn, F.count("*") - F.count(c))


def row_count(lo: int | None = None, hi: int | None = None) -> Column:
    n = F.count("*")
    bad = F.lit(False) if lo is None else n < lo
    bad = bad if hi is None else bad | (n > hi)
    return row("row_count", "rows", bad_if(bad), n, lo, F.when(bad, 1).otherwise(0))


def _outside(x: Column, lo, hi) -> Column:
    out = F.lit(False)
    if lo is not None:
        out = out | (x < lo)
    if hi is not None:
        out = out | (x > hi)
    return out


def value_range(c: str, lo=None, hi=None, name: str = "range") -> Column:
    """Out-of-range share over 5% blocks, any warns; observed is the share, detail the extremes."""
    bad = F.count(F.when(_outside(F.col(c), lo, hi), 1))
    rate = F.coalesce(ratio(bad, F.count(c)), F.lit(0.0))
    detail = F.format_string("min=%.4f max=%.4f", F.min(F.col(c).cast("double")), F.max(F.col(c).cast("double")))
    return row(name, c, levels(rate, bad > 0, rate > 0.05), rate, 0.05, bad, detail)


def non_negative(c: str) -> Column:
    bad = F.count(F.when(F.col(c) < 0, 1))
    return row("non_negative", c, bad_if(bad > 0), F.min(F.col(c).cast("double")), 0.0, bad)


def ratio_bounds(num: str, den: str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Rows whose ratio leaves [lo, hi]; zero and missing divisors are ignored."""
    q = F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
    bad = F.count(F.when((q < lo) | (q > hi), 1))
    return row("ratio_bounds", f"{num}/{den}", bad_if(bad > 0), F.max(q), hi, bad)


def future_dates(c: str, ref: str) -> Column:
    bad = F.count(F.when(F.col(c) > F.lit(ref).cast("timestamp"), 1))
    return row("future_dates", c, bad_if(bad > 0), bad, 0, bad, F.max(c).cast("date").cast("string"))


def date_bounds(c: str, lo: str | None, hi: str | None) -> Column:
    bad = F.count(F.when(_outside(F.col(c), None if lo is None else F.lit(lo).cast("timestamp"), None if hi is None else F.lit(hi).cast("timestamp")), 1))
    pct = F.round(F.try_divide(bad * 100.0, F.count("*")), 2)
    return row("date_bounds", c, F.when(F.count(c) == 0, WARNING).when(bad > 0, WARNING).otherwise(PASS), pct, 0.0, bad)


def rates(num: str, den: str, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Rates outside the range and zero divisors; both bad blocks, either warns."""
    zero = F.count(F.when(F.col(den).isNull() | (F.col(den) == 0), 1))
    q = F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))
    out = F.count(F.when((q < lo) | (q > hi), 1))
    share = F.coalesce(ratio(out, F.count(q)), F.lit(0.0))
    sev = levels(share, (out > 0) | (zero > 0), (F.count(q) == 0) | ((zero > 0) & (share > 0.05)))
    return row("rates", f"{num}/{den}", sev, F.avg(q), hi, out + zero, F.format_string("min=%.6f max=%.6f", F.min(q), F.max(q)))


def exhaustive(segment: str, metric: str) -> Column:
    """Sums of labelled segments against the total; rows without a segment block."""
    x = F.col(metric).cast("double")
    total, seg = F.sum(x), F.sum(F.when(F.col(segment).isNotNull(), x))
    missing = F.count("*") - F.count(segment)
    base = F.when(total != 0, F.abs(total)).otherwise(F.abs(seg))
    diff = F.coalesce(F.try_divide(F.abs(seg - total), base), F.lit(0.0))
    return row("exhaustive", segment, levels(diff, diff > 0.001, (diff > 0.01) | (missing > 0)), diff, 0.01, missing)


# --- structure -------------------------------------------------------------------

_FAMILY = {"numeric": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "datetime": ("date", "timestamp", "timestamp_ntz"), "string": ("string", "varchar", "char")}


def type_family(t: str) -> str:
    base = t.split("(")[0]
    return next((k for k, v in _FAMILY.items() if base in v), base)


def check_schema(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Missing columns block, a different type family warns, extras are listed."""
    have = dict(df.dtypes)
    rows = [("schema_missing", c, False, BLOCKER, None, None, 1, "column missing") for c in expected if c not in have]
    rows += [("schema_type", c, False, WARNING, None, None, 1, f"{have[c]} is not {t}") for c, t in expected.items() if c in have and type_family(have[c]) != type_family(t)]
    rows += [("schema_extra", c, True, PASS, None, None, 0, have[c]) for c in have if c not in expected]
    rows += [("schema", "columns", not any(r[3] == BLOCKER for r in rows), max((r[3] for r in rows), key=[PASS, WARNING, BLOCKER].index, default=PASS), float(len(have)), float(len(expected)), sum(r[6] for r in rows), "")]
    return df.sparkSession.createDataFrame(rows, "check string, subject string, ok boolean, severity string, observed double, expected double, n_bad long, detail string")


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null keys or duplicated keys block; duplicated keys are counted once each."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    g = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count(F.when((F.col("_n") > 1) & ~null, 1)).alias("dups"), F.coalesce(F.sum(F.when(null, F.col("_n"))), F.lit(0)).alias("nulls"))
    bad = F.col("dups") + F.col("nulls")
    return one(g, row("primary_key", ",".join(keys), bad_if(bad > 0), F.col("dups"), 0, bad, F.format_string("%d null, %d duplicated", F.col("nulls"), F.col("dups"))))


def check_duplicates(df: DataFrame, keys: Sequence[str], samples: int = 5) -> DataFrame:
    """All rows of duplicated keys, with the smallest such keys as samples."""
    d = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_k", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    top = d.orderBy(*keys).limit(samples).agg(F.array_join(F.array_sort(F.collect_list("_k")), ";").alias("s"))
    g = d.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).withColumn("s", top.scalar())
    return one(g, row("duplicates", ",".join(keys), bad_if(F.col("rows") > 0), F.col("keys"), 0, F.col("rows"), F.col("s")))


def check_date_range(df: DataFrame, dt: str, start: str | None, end: str | None, max_gap: int) -> DataFrame:
    """First and last day against expectation, and gaps longer than ``max_gap`` days."""
    days = df.where(F.col(dt).isNotNull()).groupBy(F.col(dt).cast("date").alias("dt")).agg(F.lit(1).alias("one"))
    lag = F.datediff("dt", F.lag("dt").over(W.orderBy("dt")))  # one row per calendar day
    g = days.withColumn("_g", lag).agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.count(F.when(F.col("_g") > max_gap, 1)).alias("gaps"), F.max("_g").alias("widest"))
    off = F.lit(0)
    if start:
        off = off + F.when(F.col("lo") != F.lit(start).cast("date"), 1).otherwise(0)
    if end:
        off = off + F.when(F.col("hi") != F.lit(end).cast("date"), 1).otherwise(0)
    bad = off + F.col("gaps")
    return one(g, row("date_range", dt, levels(bad, bad > 0, F.lit(False)), F.col("widest"), max_gap, bad, F.format_string("%s..%s", F.col("lo").cast("string"), F.col("hi").cast("string"))))


def check_referential(child: DataFrame, parent: DataFrame, ck: str, pk: str, block: float = 0.05) -> DataFrame:
    """Orphan rows over all child rows."""
    o = orphans(child.where(F.col(ck).isNotNull()).groupBy(ck).agg(F.count("*").alias("_n")), parent, ck, pk).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("bad"), F.count("*").alias("keys"))
    g = o.withColumn("n", child.agg(F.count("*").alias("n")).scalar())
    rate = F.coalesce(ratio("bad", "n"), F.lit(0.0))
    return one(g, row("referential", f"{ck}->{pk}", levels(rate, rate > 0, rate > block), rate, block, F.col("bad"), F.format_string("%d orphan keys", F.col("keys"))))


def check_domain(df: DataFrame, c: str, values: Sequence[str]) -> DataFrame:
    """Unexpected values block; expected values that never occur warn."""
    v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
    known = F.col("v").isin([str(x) for x in values])
    g = v.agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("bad"), F.count(F.when(~known, 1)).alias("odd"), F.count(F.when(known, 1)).alias("seen"))
    missing = F.lit(len(values)) - F.col("seen")
    return one(g, row("domain", c, levels(missing, missing > 0, F.col("odd") > 0), F.col("odd"), 0, F.col("bad"), F.format_string("%d expected values absent", missing)))


def check_segments(df: DataFrame, c: str, expected: Sequence[str], allow_other: bool = True) -> DataFrame:
    v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.lit(1).alias("one"))
    known = F.col("v").isin(list(expected))
    g = v.agg(F.count(F.when(known, 1)).alias("seen"), F.count(F.when(~known, 1)).alias("odd"))
    missing = F.lit(len(expected)) - F.col("seen")
    bad = missing if allow_other else missing + F.col("odd")
    return one(g, row("segments", c, bad_if(bad > 0), missing, 0, bad, F.format_string("%d unexpected", F.col("odd"))))


def check_cardinality(df: DataFrame, bounds: Mapping[str, tuple[int | None, int | None]]) -> DataFrame:
    """Distinct values of several columns within bounds, from one grouping of their digests."""
    u = distinct_counts(df, list(bounds)).withColumnRenamed("n_unique", "n")
    lo = F.create_map(*[x for c, (a, _) in bounds.items() for x in (F.lit(c), F.lit(a).cast("long"))])[F.col("column_name")]
    hi = F.create_map(*[x for c, (_, b) in bounds.items() for x in (F.lit(c), F.lit(b).cast("long"))])[F.col("column_name")]
    bad = F.coalesce(F.col("n") < lo, F.lit(False)) | F.coalesce(F.col("n") > hi, F.lit(False))
    sev = bad_if(bad)
    return u.select(F.lit("cardinality").alias("check"), F.col("column_name").alias("subject"), (sev == PASS).alias("ok"), sev.alias("severity"), F.col("n").cast("double").alias("observed"), hi.cast("double").alias("expected"), bad.cast("long").alias("n_bad"), F.lit("").alias("detail"))


# --- logic --------------------------------------------------------------------------

def check_aggregation(detail: DataFrame, summary: DataFrame, keys: Sequence[str], metric: str, tol: float = 0.01) -> DataFrame:
    """Re-aggregated detail against the summary: total within ``tol``; a group 5% apart or one-sided blocks."""
    side = lambda df, s: df.groupBy(*keys).agg(F.sum(metric).cast("double").alias("_v")).select(*keys, F.lit(s).alias("_s"), "_v")
    g = side(detail, "d").unionByName(side(summary, "s")).groupBy(*keys).agg(F.max(F.when(F.col("_s") == "d", F.col("_v"))).alias("_d"), F.max(F.when(F.col("_s") == "s", F.col("_v"))).alias("_m"))
    base = F.when(F.col("_d") != 0, F.abs("_d")).otherwise(F.abs("_m"))
    g = g.withColumn("_e", F.when(F.col("_d").isNull() | F.col("_m").isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(F.abs(F.col("_m") - F.col("_d")), base), F.lit(0.0))))
    a = g.agg(F.sum("_d").alias("d"), F.sum("_m").alias("m"), F.count(F.when(F.col("_e") > tol, 1)).alias("bad"), F.count(F.when(F.col("_e") > 0.05, 1)).alias("far"))
    total = F.coalesce(F.try_divide(F.abs(F.col("d") - F.col("m")), F.when(F.col("d") != 0, F.abs("d")).otherwise(F.abs("m"))), F.lit(0.0))
    return one(a, row("aggregation", metric, levels(total, (F.col("bad") > 0) | (total > tol), F.col("far") > 0), total, tol, F.col("bad")))


def check_pct_sum(df: DataFrame, pct: str, group: Sequence[str], expected: float = 100.0, tol: float = 1.0) -> DataFrame:
    """Worst group's distance from the expected sum: within tol passes, within twice warns."""
    g = df.groupBy(*group).agg(F.sum(pct).alias("s")).withColumn("d", F.abs(F.col("s") - expected))
    a = g.agg(F.max("d").alias("worst"), F.count(F.when(F.col("d") > tol, 1)).alias("bad"))
    return one(a, row("pct_sum", pct, levels(F.col("worst"), F.col("worst") > tol, F.col("worst") > 2 * tol), F.col("worst"), tol, F.col("bad")))


def check_monotonic(df: DataFrame, keys: Sequence[str], order: str, c: str, increasing: bool = True, strict: bool = False) -> DataFrame:
    """Steps against the direction along an explicit order; the first violating position is the detail."""
    x, prev = F.col(c), F.col("_prev")
    bad = (x <= prev if strict else x < prev) if increasing else (x >= prev if strict else x > prev)
    g = running(df.where(x.isNotNull()), keys, [order], previous={"_prev": c}).withColumn("_b", bad).agg(F.count(F.when(F.col("_b"), 1)).alias("bad"), F.min(F.when(F.col("_b"), F.col(order))).alias("first"))
    return one(g, row("monotonic", c, bad_if(F.col("bad") > 0), F.col("bad"), 0, F.col("bad"), F.coalesce(F.col("first").cast("string"), F.lit(""))))


def check_spikes(df: DataFrame, keys: Sequence[str], order: str, c: str, window: int, z: float) -> DataFrame:
    """Points far from the ``window`` points before them."""
    x = df.where(F.col(c).isNotNull()).withColumn("_x", F.col(c).cast("double"))
    g = prior_z(x, "_x", keys, order, window).withColumn("_z", F.abs("z")).agg(F.count(F.when(F.col("_z") > z, 1)).alias("bad"), F.max("_z").alias("mx"))
    return one(g, row("spikes", c, bad_if(F.col("bad") > 0, WARNING), F.col("mx"), z, F.col("bad")))


def check_group_balance(df: DataFrame, group: str, min_size: int = 10, max_ratio: float = 100.0) -> DataFrame:
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).agg(F.max("n").alias("mx"), F.min("n").alias("mn"), F.count(F.when(F.col("n") < min_size, 1)).alias("small"))
    rt = ratio("mx", "mn")
    return one(g, row("group_balance", group, bad_if((F.col("small") > 0) | (rt > max_ratio)), rt, max_ratio, F.col("small")))


def _change(df: DataFrame, keys: Sequence[str], order: str, c: str) -> DataFrame:
    """Absolute relative change on the previous point; infinite when it was zero and is no longer."""
    x, p = F.col(c).cast("double"), F.col("_prev").cast("double")
    ch = F.when(p == 0, F.when(x != 0, F.lit(float("inf")))).otherwise(F.abs(x - p) / F.abs(p))
    return running(df.where(F.col(c).isNotNull()), keys, [order], previous={"_prev": c}).withColumn("_c", ch)


def check_trend_breaks(df: DataFrame, keys: Sequence[str], order: str, c: str, jump: float = 0.5) -> DataFrame:
    """Jumps over 50%: one or two warn, more block."""
    g = _change(df, keys, order, c).agg(F.count(F.when(F.col("_c") > jump, 1)).alias("bad"))
    return one(g, row("trend_breaks", c, levels(F.col("bad"), F.col("bad") > 0, F.col("bad") > 2), F.col("bad"), 0, F.col("bad")))


def check_period_change(df: DataFrame, keys: Sequence[str], order: str, c: str, limit_pct: float = 200.0) -> DataFrame:
    g = _change(df, keys, order, c).agg(F.count(F.when(F.col("_c") * 100 > limit_pct, 1)).alias("bad"), (F.max(F.when(F.col("_c") < float("inf"), F.col("_c"))) * 100).alias("mx"))
    return one(g, row("period_change", c, bad_if(F.col("bad") > 0), F.col("mx"), limit_pct, F.col("bad")))


def check_yoy(monthly: DataFrame, keys: Sequence[str], month: str, c: str, limit: float = 2.0) -> DataFrame:
    """Each month against the same month a year earlier; over the limit or a zero prior blocks, over half warns."""
    old = monthly.select(*keys, F.add_months(month, 12).alias(month), F.col(c).cast("double").alias("_p"))
    j = monthly.join(old, [*keys, month]).withColumn("_x", F.col(c).cast("double"))
    ch = F.when(F.col("_p") == 0, F.when(F.col("_x") != 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.abs(F.col("_x") - F.col("_p")) / F.abs("_p"))
    g = j.withColumn("_c", ch).agg(F.count(F.when(F.col("_c") > limit, 1)).alias("far"), F.count(F.when(F.col("_c") > limit / 2, 1)).alias("near"), F.max("_c").alias("mx"))
    return one(g, row("yoy", c, levels(F.col("mx"), F.col("near") > 0, F.col("far") > 0), F.col("mx"), limit, F.col("near")))


def check_temporal(df: DataFrame, dt: str, metric: str) -> DataFrame:
    """Missing, repeated and zero days; the first and last row may be zero."""
    d = df.groupBy(F.col(dt).cast("date").alias("dt")).agg(F.count("*").alias("n"), F.count(F.when(F.col(metric).isNull() | (F.col(metric) == 0), 1)).alias("z"))
    ends = d.agg(F.struct(F.min("dt").alias("lo"), F.max("dt").alias("hi")).alias("e"))
    d = d.withColumn("_e", ends.scalar())
    inner = (F.col("dt") > F.col("_e.lo")) & (F.col("dt") < F.col("_e.hi"))
    g = d.groupBy("_e").agg(F.count("*").alias("days"), F.count(F.when(F.col("n") > 1, 1)).alias("dup"), F.coalesce(F.sum(F.when(inner, F.col("z"))), F.lit(0)).alias("zero"))
    span = F.datediff(F.col("_e.hi"), F.col("_e.lo")) + 1
    missing = span - F.col("days")
    bad = missing + F.col("dup") + F.col("zero")
    return one(g, row("temporal", dt, levels(bad, bad > 0, (F.col("dup") > 0) | (bad / span > 0.1)), bad / span, 0.1, bad, F.format_string("%d missing, %d repeated, %d zero", missing, F.col("dup"), F.col("zero"))))


def check_coverage(df: DataFrame, dt: str, grain: str = "day", tolerance: int = 1) -> DataFrame:
    """Missing periods between the first and the last; at least 95% covered warns, less blocks."""
    p = df.where(F.col(dt).isNotNull()).groupBy(F.date_trunc(grain, dt).cast("date").alias("p")).agg(F.lit(1).alias("one"))
    idx = F.datediff("p", F.lit("1970-01-05").cast("date")) if grain == "day" else F.floor(F.datediff("p", F.lit("1970-01-05").cast("date")) / 7) if grain == "week" else F.year("p") * 12 + F.month("p")
    p = p.withColumn("_i", idx.cast("long"))
    step = F.col("_i") - F.lag("_i").over(W.orderBy("_i")) - 1  # one row per period
    g = p.withColumn("_m", step).agg((F.max("_i") - F.min("_i") + 1).alias("expected"), F.count("*").alias("actual"), F.count(F.when(F.col("_m") > tolerance, 1)).alias("gaps"))
    missing = F.col("expected") - F.col("actual")
    cov = F.round((1 - missing / F.col("expected")) * 100, 2)
    return one(g, row("coverage", dt, levels(cov, missing > 0, (missing > 0) & (cov < 95)), cov, 95.0, missing, F.format_string("%d gaps", F.col("gaps"))))


# --- business -------------------------------------------------------------------------

def check_metric_relations(metrics: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str, float]]) -> DataFrame:
    """``left ≈ right`` within a tolerance over named metric columns, e.g. ('aov * orders', 'revenue', 0.01)."""
    names = [c for c in metrics.columns if c not in keys]
    out = []
    for left, right, tol in rules:
        a, b = metric_expr(left, names).cast("double"), metric_expr(right, names).cast("double")
        base = F.greatest(F.abs(a), F.abs(b))
        d = F.coalesce(F.try_divide(F.abs(a - b), base), F.lit(0.0))
        bad = F.count(F.when(d > tol, 1))
        out.append(row("metric_relation", f"{left} = {right}", bad_if(bad > 0), F.max(d), tol, bad))
    return scan_checks(metrics, out)


def check_metric_value(metrics: DataFrame, definitions: DataFrame) -> DataFrame:
    """(metric, value) against (metric, min_value, max_value, target): out of bounds blocks, over 50% from target warns."""
    j = metrics.join(definitions, "metric", "left")
    out = F.coalesce(F.col("value") < F.col("min_value"), F.lit(False)) | F.coalesce(F.col("value") > F.col("max_value"), F.lit(False))
    away = F.try_divide(F.abs(F.col("value") - F.col("target")), F.col("target")) * 100
    far = F.coalesce(away > 50, F.lit(False))
    sev = levels(away, far, out)
    return j.select(F.lit("metric_value").alias("check"), F.col("metric").alias("subject"), (~out).alias("ok"), sev.alias("severity"), F.col("value").cast("double").alias("observed"), F.col("target").cast("double").alias("expected"), (out.cast("long") + far.cast("long")).alias("n_bad"), F.lit("").alias("detail"))


def check_join_fanout(left: DataFrame, right: DataFrame, lk: str, rk: str, limit: float = 2.0, expected: str = "same") -> DataFrame:
    """Rows an inner join would give, from key counts alone: the join itself is never run."""
    a = left.where(F.col(lk).isNotNull()).groupBy(F.col(lk).alias("k")).agg(F.count("*").alias("a"))
    b = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("k")).agg(F.count("*").alias("b"))
    g = a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("after")).withColumn("before", left.agg(F.count("*").alias("n")).scalar())
    rt = ratio("after", "before")
    fits = {"same": F.col("after") == F.col("before"), "more": F.col("after") > F.col("before"), "fewer": F.col("after") < F.col("before")}[expected]
    return one(g, row("join_fanout", f"{lk}={rk}", levels(rt, ~fits, rt > limit), rt, limit, F.abs(F.col("after") - F.col("before"))))


def claim_check(claims: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(claim, reported) against (claim, actual): under 0.1% passes, up to 1% warns, more or missing blocks."""
    j = claims.join(recomputed, "claim", "left")
    d = F.when(F.col("actual") == F.col("reported"), 0.0).otherwise(F.try_divide(F.abs(F.col("reported") - F.col("actual")), F.abs("actual")))
    sev = F.when(d < 0.001, PASS).when(d <= 0.01, WARNING).otherwise(BLOCKER)
    return j.select(F.lit("claim").alias("check"), F.col("claim").alias("subject"), (sev == PASS).alias("ok"), sev.alias("severity"), F.col("actual").cast("double").alias("observed"), F.col("reported").cast("double").alias("expected"), (sev != PASS).cast("long").alias("n_bad"), F.lit("").alias("detail"))


def event_sanity(events: DataFrame, starts: DataFrame, user: str, ts: str, start: str, lo: str, hi: str, min_per_day: int) -> DataFrame:
    """Events before the user's start, outside the period, thin days and the peak week over the median week."""
    early = events.join(starts.select(user, start), user).agg(F.count(F.when(F.col(ts) < F.col(start), 1)).alias("bad"))
    days = events.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n"))
    thin = days.agg(F.count(F.when(F.col("n") < min_per_day, 1)).alias("bad"), F.min("n").alias("mn"))
    # Few rows (one per week), so the exact built-in percentile is bounded.
    week = days.groupBy(F.trunc("d", "week").alias("w")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k = 7").agg(F.max("n").alias("mx"), F.percentile("n", F.lit(0.5)).alias("md"))
    return suite(
        one(early, row("events_before_start", user, bad_if(F.col("bad") > 0), F.col("bad"), 0, F.col("bad"))), scan_checks(events, [date_bounds(ts, lo, hi)]),
        one(thin, row("events_per_day", ts, bad_if(F.col("bad") > 0), F.col("mn"), min_per_day, F.col("bad"))),
        one(week, row("peak_week", ts, bad_if(ratio("mx", "md") > 1.5, WARNING), ratio("mx", "md"), 1.5)),
    )


# --- suites ------------------------------------------------------------------------------

Check = Callable[[DataFrame], DataFrame]


def run_structural(
    df: DataFrame,
    keys: Sequence[str] = (),
    completeness_cols: Sequence[str] | None = None,
    rows: tuple[int | None, int | None] = (1, None),
    schema: Mapping[str, str] | None = None,
    dates: Mapping[str, tuple[str | None, str | None]] | None = None,
    days: Mapping[str, tuple[str | None, str | None, int]] | None = None,
    parents: Sequence[tuple[str, DataFrame, str]] = (),
    domains: Mapping[str, Sequence[str]] | None = None,
    extra: Sequence[Check] = (),
) -> DataFrame:
    """All structural rules that are configured.

    Rows, completeness and the bounds of ``dates`` are one scan; ``schema`` reads metadata; keys, ``days`` (first and
    last day, widest gap), ``parents`` (column, parent table, its key) and ``domains`` group once each.
    """
    rules = [row_count(*rows), *[completeness(c) for c in (df.columns if completeness_cols is None else completeness_cols)]]
    rules += [date_bounds(c, lo, hi) for c, (lo, hi) in (dates or {}).items()]
    parts = [scan_checks(df, rules)]
    if schema:
        parts.append(check_schema(df, schema))
    if keys:
        parts.append(check_primary_key(df, keys))
    parts += [check_date_range(df, c, lo, hi, gap) for c, (lo, hi, gap) in (days or {}).items()]
    parts += [check_referential(df, parent, c, k) for c, parent, k in parents]
    parts += [check_domain(df, c, v) for c, v in (domains or {}).items()]
    return suite(*parts, *[f(df) for f in extra])


def run_logical(
    detail: DataFrame,
    summary: DataFrame,
    keys: Sequence[str],
    metric: str,
    order: str,
    percents: Mapping[str, Sequence[str]] | None = None,
    monotonic: Mapping[str, bool] | None = None,
    spikes: Mapping[str, tuple[int, float]] | None = None,
    ratios: Sequence[tuple[str, str, float, float]] = (),
    not_after: Mapping[str, str] | None = None,
    extra: Sequence[Check] = (),
) -> DataFrame:
    """All logical rules that are configured.

    Exhaustive segments, ``ratios`` (numerator, denominator, bounds) and ``not_after`` (date column: latest time) are
    one scan of the detail; ``percents`` (column: groups whose values sum to 100), ``monotonic`` (column: increasing)
    and ``spikes`` (column: window and z) run on the summary along ``order``.
    """
    rules = [exhaustive(keys[0], metric), *[ratio_bounds(n, d, lo, hi) for n, d, lo, hi in ratios], *[future_dates(c, t) for c, t in (not_after or {}).items()]]
    parts = [check_aggregation(detail, summary, keys, metric), scan_checks(detail, rules)]
    parts.append(check_trend_breaks(summary, [], order, metric) if order in summary.columns else check_group_balance(detail, keys[0]))
    parts += [check_pct_sum(summary, c, g) for c, g in (percents or {}).items()]
    parts += [check_monotonic(summary, [], order, c, up) for c, up in (monotonic or {}).items()]
    parts += [check_spikes(summary, [], order, c, w, z) for c, (w, z) in (spikes or {}).items()]
    return suite(*parts, *[f(detail) for f in extra])


# Bounds of well-known rates and scores, and measures that are never negative.
DEFAULT_RANGES = {"conversion_rate": (0, 1), "bounce_rate": (0, 1), "click_through_rate": (0, 1), "retention_rate": (0, 1), "churn_rate": (0, 1), "nps_score": (-100, 100)}
DEFAULT_NON_NEGATIVE = ("revenue", "orders", "sessions", "users", "page_views", "transactions", "quantity")


def run_business(
    df: DataFrame,
    ranges: Mapping[str, tuple] | None = None,
    non_negatives: Sequence[str] | None = None,
    cardinality: Mapping[str, tuple] | None = None,
    segments: Mapping[str, Sequence[str]] | None = None,
    changes: Mapping[str, tuple[str, float]] | None = None,
    relations: Sequence[tuple[str, str, float]] = (),
    extra: Sequence[Check] = (),
) -> DataFrame:
    """Configured rules, or the defaults on the columns present.

    ``changes`` (column: order column and limit in percent) looks at the step from row to row; ``relations`` compares
    arithmetic over the columns. Ranges and signs are one scan, relations another.
    """
    rg = ranges if ranges is not None else {c: b for c, b in DEFAULT_RANGES.items() if c in df.columns}
    nn = non_negatives if non_negatives is not None else [c for c in DEFAULT_NON_NEGATIVE if c in df.columns]
    rules = [value_range(c, *b) for c, b in rg.items()] + [non_negative(c) for c in nn]
    parts = [scan_checks(df, rules)] if rules else []
    if cardinality:
        parts.append(check_cardinality(df, cardinality))
    parts += [check_segments(df, c, v) for c, v in (segments or {}).items()]
    parts += [check_period_change(df, [], order, c, limit) for c, (order, limit) in (changes or {}).items()]
    if relations:
        parts.append(check_metric_relations(df, [], relations))
    return suite(*parts, *[f(df) for f in extra])


# --- reconciliation ----------------------------------------------------------------------

def tie_profile(df: DataFrame) -> DataFrame:
    """(check, metric, value): rows, nulls, sums and date bounds in one aggregation, distincts in one grouping."""
    s = lambda check, metric, v: F.struct(F.lit(check).alias("check"), F.lit(metric).alias("metric"), v.cast("double").alias("value"))
    rows = [s("row_count", "rows", F.count("*"))]
    for c, t in df.dtypes:
        rows.append(s("null_count", c, F.count("*") - F.count(c)))
        if is_numeric(t):
            rows.append(s("numeric_sum", c, F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))))
        elif t in ("date", "timestamp", "timestamp_ntz"):
            rows += [s("date_min", c, F.unix_date(F.min(c).cast("date"))), s("date_max", c, F.unix_date(F.max(c).cast("date")))]
    a = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    d = distinct_counts(df, df.columns).select(F.col("column_name").alias("metric"), F.col("n_unique").cast("double").alias("value"))
    return a.unionByName(d.select(F.lit("distinct_count").alias("check"), "metric", "value"))


def tieout(a: DataFrame, b: DataFrame, tol: float = 0.0001, floor: float = 0.01) -> DataFrame:
    """Two copies of a table compared measure by measure; sums may differ by the tolerance, ten times it warns."""
    p, q = tie_profile(a).withColumnRenamed("value", "left"), tie_profile(b).withColumnRenamed("value", "right")
    j = p.join(q, ["check", "metric"], "full")
    ab = F.abs(F.col("left") - F.col("right"))
    small = (F.abs("left") < floor) & (F.abs("right") < floor)
    base = F.when(small, F.lit(floor)).when(F.col("left") != 0, F.abs("left")).otherwise(F.abs("right"))
    d = F.when(ab == 0, 0.0).otherwise(F.try_divide(ab, base))
    status = (
        F.when(F.col("left").isNull() | F.col("right").isNull(), F.when(F.col("check") == "numeric_sum", WARNING).otherwise(BLOCKER))
        .when(F.col("check") != "numeric_sum", F.when(ab == 0, PASS).otherwise(BLOCKER)).when(d <= tol, PASS).when(d <= tol * 10, WARNING).otherwise(BLOCKER)
    )
    return j.withColumns({"diff": d, "severity": status})


def check_simpson(found: DataFrame, subject: str, core: bool = True) -> DataFrame:
    """Paradoxes among the dimensions of ``rootcause.simpson``: any blocks for a core metric, else it warns."""
    g = found.agg(F.count(F.when(F.col("paradox"), 1)).alias("n"))
    return one(g, row("simpson", subject, bad_if(F.col("n") > 0, BLOCKER if core else WARNING), F.col("n"), 0, F.col("n")))


# --- confidence ----------------------------------------------------------------------------

LAYERS = {
    "structural": ("completeness", "primary_key", "referential", "schema"), "logical": ("aggregation", "exhaustive", "temporal", "trend_breaks"),
    "business": ("range", "rates", "yoy"), "simpson": ("simpson",),
}


def confidence_score(checks: DataFrame) -> DataFrame:
    """0–100 and a grade per dataset from check rows with a ``dataset`` column; a missing layer caps the grade at C.

    ``observed`` is read for completeness (null rate), aggregation and exhaustive (difference), temporal and
    trend_breaks (n_bad), simpson (paradoxes; severity BLOCKER marks a core metric) and row_count.
    """
    c, sev = F.col("check"), F.col("severity")
    of = lambda *names: c.isin(list(names))
    has = lambda *names: F.count(F.when(of(*names), 1)) > 0
    worst = lambda *names: F.max(F.when(of(*names), F.when(sev == BLOCKER, 2).when(sev == WARNING, 1).otherwise(0)))
    obs = lambda agg, *names: agg(F.when(of(*names), F.col("observed")))
    g = checks.groupBy("dataset").agg(
        has("completeness").alias("h_c"), obs(F.avg, "completeness").alias("null_rate"), has("primary_key", "referential", "schema").alias("h_s"), worst("primary_key", "referential", "schema").alias("w_s"),
        has("aggregation", "exhaustive").alias("h_a"), worst("aggregation", "exhaustive").alias("w_a"), obs(F.max, "aggregation", "exhaustive").alias("d_a"),
        has("temporal", "trend_breaks").alias("h_t"), F.coalesce(F.sum(F.when(of("temporal"), F.col("n_bad"))), F.lit(0)).alias("miss"), F.coalesce(F.sum(F.when(of("trend_breaks"), F.col("n_bad"))), F.lit(0)).alias("brk"), worst("trend_breaks").alias("w_t"),
        has("range", "rates", "yoy").alias("h_b"), worst("range", "rates", "yoy").alias("w_b"), has("simpson").alias("h_p"), F.coalesce(obs(F.sum, "simpson"), F.lit(0.0)).alias("par"), worst("simpson").alias("w_p"),
        has("row_count").alias("h_n"), obs(F.max, "row_count").alias("rows"), *[has(*v).alias(f"l_{k}") for k, v in LAYERS.items()],
    )
    x = F.col
    factors = {
        "data_completeness": (x("h_c"), F.when(x("null_rate") < 0.01, 15).when(x("null_rate") < 0.05, 12).when(x("null_rate") < 0.1, 9).when(x("null_rate") < 0.2, 5).otherwise(2), 15),
        "structural_integrity": (x("h_s"), F.when(x("w_s") == 2, 3).when(x("w_s") == 1, 10).otherwise(15), 15),
        "aggregation_consistency": (x("h_a"), F.when((x("w_a") == 2) | (x("d_a") > 0.05), 3).when(x("d_a") > 0.01, 8).when(x("w_a") == 1, 12).otherwise(15), 15),
        "temporal_consistency": (x("h_t"), F.when(x("w_t") == 2, 3).when((x("brk") > 0) | (x("miss") > 5), 5).when(x("miss") > 0, 10).otherwise(15), 15),
        "business_plausibility": (x("h_b"), F.when(x("w_b") == 2, 5).when(x("w_b") == 1, 10).otherwise(15), 15),
        "simpsons_paradox_risk": (x("h_p"), F.when(x("par") == 0, 15).when(x("w_p") == 2, 2).otherwise(8), 15),
        "sample_size": (x("h_n"), F.when(x("rows") > 10000, 10).when(x("rows") > 1000, 8).when(x("rows") > 100, 5).when(x("rows") > 30, 3).otherwise(1), 10),
    }
    actual, possible = F.lit(0), F.lit(0)
    for h, s, m in factors.values():
        actual, possible = actual + F.when(h, s).otherwise(0), possible + F.when(h, m).otherwise(0)
    layers = sum((F.col(f"l_{k}").cast("int") for k in LAYERS), F.lit(0))
    g = g.withColumns({k: F.when(h, s) for k, (h, s, _) in factors.items()} | {"_a": actual, "_p": possible, "layers": layers})
    g = g.withColumn("score", F.coalesce(F.bround(F.try_divide(F.col("_a") * 100.0, F.col("_p"))).cast("int"), F.lit(0)))
    raw = grade(F.col("score"))
    g = g.withColumn("grade", F.when((F.col("layers") < len(LAYERS)) & raw.isin("A", "B"), "C").otherwise(raw))
    return g.select("dataset", "score", "grade", "layers", *factors)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def merge_confidence(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean score, lowest factors; any D or F caps the merged grade at C."""
    names = [c for c in scores.columns if c not in ("dataset", "score", "grade", "layers", *by)]
    g = scores.groupBy(*by).agg(F.bround(F.avg("score")).cast("int").alias("score"), F.bool_or(F.col("grade").isin("D", "F")).alias("_bad"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in names])
    raw = grade(F.col("score"))
    return g.withColumn("grade", F.when(F.col("_bad") & raw.isin("A", "B"), "C").otherwise(raw)).drop("_bad")
