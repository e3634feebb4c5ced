"""Joins, set operations and top-k forms used by the analyses."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import month_key, shift
from funnelwright.operators.ordered import as_number, running


def cap_outlier(c: str, top: float) -> tuple[Column, Column]:
    """(capped value, was-capped flag)."""
    return F.least(F.col(c), F.lit(float(top))), F.col(c) > F.lit(float(top))


def align_partial_month(df: DataFrame, dt: str, end: str) -> DataFrame:
    """Keep only the elapsed days of last year's month of ``end``."""
    last = f"{int(end[:4]) - 1}{end[4:7]}"
    return df.where(~((month_key(dt) == last) & (F.dayofmonth(dt) > int(end[8:10]))))


def two_year_windows(dt: str, end: str, weeks: int) -> Column:
    """The last ``weeks`` weeks or the same weeks 364 days earlier; half-open days on the bare column, so both reach the scan."""
    span = 7 * weeks - 1
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    part = lambda lo, hi: (F.col(dt) >= day(lo)) & (F.col(dt) < day(shift(hi, 1)))
    return part(shift(end, -span), end) | part(shift(end, -span - 364), shift(end, -364))


def transpose_metrics(df: DataFrame, period: str, metrics: Sequence[str], periods: Sequence[str]) -> DataFrame:
    """Metric per row, one column per period."""
    long = df.unpivot([period], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy("metric").pivot(period, list(periods)).agg(F.first("value"))


def scale_sample(c: str | Column, factor: float) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * F.lit(float(factor))


def join_dimension(fact: DataFrame, dim: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """No forced hint: the planner broadcasts the dimension only when its measured size allows, and
    splits skewed keys otherwise."""
    return fact.join(dim, on, how)


def align_stages(frames: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Stages that may each miss a key, side by side with 0 for the missing: one union and one aggregation
    in place of a chain of full joins."""
    stacked = None
    for name, df in frames.items():
        d = df.select(*keys, F.lit(name).alias("_stage"), F.col(value).alias("_v"))
        stacked = d if stacked is None else stacked.unionByName(d)
    return stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_stage") == n, F.col("_v"))), F.lit(0)).alias(n) for n in frames])


def attach_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a single aggregated value as a scalar subquery: no join at all."""
    return df.withColumn(name, one_row.scalar())


def yoy_join(df: DataFrame, dt: str, columns: Sequence[str], year: int) -> DataFrame:
    """Rows of ``year`` with last year's columns of the same month-day."""
    md = F.date_format(dt, "MM-dd")
    cur = df.where(F.year(dt) == year).withColumn("_md", md)
    old = df.where(F.year(dt) == year - 1).select(md.alias("_md"), *[F.col(c).alias(f"{c}_last") for c in columns])
    return cur.join(old, "_md").drop("_md")


CUTS = 64
HOT_SHARE = 10_000


def interval_join(facts: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, how: str = "inner", bucket_rows: int = 500_000) -> DataFrame:
    """Facts inside [start, end] of a span with the same key; a null end is open. ``how`` is inner, left, left_semi or
    left_anti: every fact lies in one bucket, a span in all it touches.

    Keys of more than ``bucket_rows`` facts and more than a ``HOT_SHARE``-th of all (so at most that many keys, with
    ``CUTS`` numbers each) are cut at quantiles of their own facts' times, into as many buckets as their size asks for;
    the join is on key and bucket. Other keys have one bucket.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a span may lie in several buckets: only facts can be kept unmatched")
    n = facts.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(as_number(facts, ts), [k / CUTS for k in range(1, CUTS)], 50 * CUTS).alias("_q"))
    least = F.greatest(F.lit(bucket_rows), facts.agg((F.count("*") / HOT_SHARE).cast("long").alias("x")).scalar())
    buckets = F.least(F.lit(CUTS), F.ceil(F.col("_n") / least))
    # Of the grid's cuts those that end a bucket; a value that is often a cut is one cut.
    chosen = F.array_distinct(F.filter("_q", lambda q, k: F.floor((k + 1) * F.col("_b") / CUTS) > F.floor(k * F.col("_b") / CUTS)))
    hot = n.where(F.col("_n") > least).withColumn("_b", buckets).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], chosen.alias("_cuts"))
    hot = F.broadcast(hot)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_h{i}"))
    gone = ["_cuts", *[f"_h{i}" for i in range(len(keys))]]
    place = lambda x: F.coalesce(F.size(F.filter("_cuts", lambda q: q <= x)), F.lit(0))
    f = facts.join(hot, same, "left").withColumn("_bucket", place(as_number(facts, ts))).drop(*gone)
    s = spans.join(hot, same, "left")
    last = F.when(F.col(end).isNull(), F.coalesce(F.size("_cuts"), F.lit(0))).otherwise(place(as_number(spans, end)))
    first = place(as_number(spans, start))
    s = s.withColumn("_bucket", F.explode(F.when(last >= first, F.sequence(first, last)))).select("_bucket", *[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in spans.columns if c not in keys])
    s = s.withColumnRenamed("_bucket", "_span_bucket")
    cond = (F.col("_bucket") == F.col("_span_bucket")) & (F.col(ts) >= F.col(start)) & (F.col(end).isNull() | (F.col(ts) <= F.col(end)))
    for k in keys:
        cond = (F.col(k) == F.col(f"_k_{k}")) & cond
    return f.join(s, cond, how).drop("_bucket", "_span_bucket", *[f"_k_{k}" for k in keys])


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def ever_flag(df: DataFrame, key: str, cond: Column, name: str, *more: Column) -> DataFrame:
    """Who ever met a condition, in one pass instead of a semi join."""
    return df.groupBy(key).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(name), *more)


def set_overlap(left: DataFrame, lk: str, right: DataFrame, rk: str) -> DataFrame:
    """Share of distinct left values found on the right."""
    a = left.where(F.col(lk).isNotNull()).groupBy(F.col(lk).alias("k")).agg(F.lit(1).alias("in_a"))
    b = right.where(F.col(rk).isNotNull()).groupBy(F.col(rk).alias("k")).agg(F.lit(1).alias("in_b"))
    g = a.join(b, "k", "left").agg(F.count("in_a").alias("n_distinct"), F.count("in_b").alias("n_found"))
    return g.withColumn("overlap", F.try_divide("n_found", "n_distinct"))


def detail_vs_summary(detail: DataFrame, summary: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Re-aggregated detail beside the summary; both are aggregated first, so the join is one row per key."""
    both = (
        detail.groupBy(*keys).agg(F.sum(value).alias("v")).select(*keys, F.lit("d").alias("_side"), "v")
        .unionByName(summary.groupBy(*keys).agg(F.sum(value).alias("v")).select(*keys, F.lit("s").alias("_side"), "v"))
    )
    g = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == "d", F.col("v"))).alias("detail"), F.max(F.when(F.col("_side") == "s", F.col("v"))).alias("summary"))
    return g.withColumn("diff", F.col("detail") - F.col("summary"))


def pairs(df: DataFrame, idx: str, columns: Sequence[str]) -> DataFrame:
    """Each unordered pair of already aggregated rows once (idx_a < idx_b).

    Meant for report rows such as segments, whose pairs are the wanted output.
    """
    a = df.select(F.col(idx).alias(f"{idx}_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = df.select(F.col(idx).alias(f"{idx}_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, F.col(f"{idx}_a") < F.col(f"{idx}_b"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Row-number filter; the planner keeps only k rows per group before the shuffle."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rn") <= k)


def top_share(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The ceil(n * share) largest entities, ranked by a distributed row number."""
    neg = df.withColumn("_neg", -F.col(value))
    ranked = running(neg, [], ["_neg", key], row_number="rank")
    n = df.agg(F.count("*").alias("n"))
    return ranked.withColumn("_n", n.scalar()).where(F.col("rank") <= F.ceil(F.col("_n") * F.lit(share))).drop("_n", "_neg")


def bounded_samples(df: DataFrame, keys: Sequence[str], key: str, k: int) -> DataFrame:
    """Count and the k smallest offending keys per group: k rows per group survive the map side."""
    top = top_k(df.select(*keys, key), keys, [F.col(key)], k).groupBy(*keys).agg(F.sort_array(F.collect_list(key)).alias("sample"))
    return df.groupBy(*keys).agg(F.count("*").alias("n")).join(top, list(keys), "left")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values found on one side only, labelled; one aggregation serves both directions."""
    u = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = u.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).where("_a + _b = 1")
    return g.select(F.when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("side"), key)


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order; a combinable minimum, so copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def date_parse_share(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Share of non-null texts that parse as dates, per column, in one aggregation."""
    aggs = [F.struct(F.lit(c).alias("column_name"), F.try_divide(F.count(F.col(c).try_cast("date")), F.count(c)).alias("parsed_share")) for c in columns]
    g = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    return g.withColumn("is_date", F.coalesce(F.col("parsed_share") >= threshold, F.lit(False)))


def alias_matches(df: DataFrame, text: str, aliases: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Whole-word alias hits, longest alias first and without overlaps: one alternation per text."""
    ordered = sorted(aliases, key=lambda a: (-len(a[0]), a[0]))
    pattern = r"\b(" + "|".join(re.escape(a) for a, _, _ in ordered) + r")\b"
    hits = df.withColumn("alias", F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))
    name = F.create_map(*[x for a, e, _ in ordered for x in (F.lit(a), F.lit(e))])
    conf = F.create_map(*[x for a, _, c in ordered for x in (F.lit(a), F.lit(float(c)))])
    return hits.withColumns({"entity": name[F.col("alias")], "confidence": conf[F.col("alias")]})


def _deletions(c: Column, most: int) -> Column:
    """Every string that deleting at most ``most`` letters leaves."""
    level = every = F.array(c)
    for _ in range(most):
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda s: F.length(s) > 0), cut)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def close_names(asked: DataFrame, q: str, names: DataFrame, name: str, max_distance: int, best: int = 3) -> DataFrame:
    """The ``best`` nearest names within an edit distance, nearest first, then by name.

    Two strings within d edits share a string left by at most d deletions from each: an equi-join on those keys
    finds every such pair, wherever the misspelling stands, and the distance is then verified.
    """
    a = asked.select(F.col(q).alias("_q")).distinct().select("_q", F.explode(_deletions(F.col("_q"), max_distance)).alias("_k"))
    n = names.select(F.col(name).alias("_name")).distinct().select("_name", F.explode(_deletions(F.col("_name"), max_distance)).alias("_k"))
    j = a.join(n, "_k").select("_q", "_name").distinct().withColumn("_d", F.levenshtein("_q", "_name")).where(F.col("_d") <= max_distance)
    # The names around one asked name, not the table: a short list to rank.
    w = W.partitionBy("_q").orderBy("_d", "_name")
    ranked = j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)
    return ranked.select(F.col("_q").alias(q), F.col("_name").alias("suggestion"), F.col("_d").cast("long").alias("distance"), "rank")
