"""Grouped aggregates and window expressions shared by the analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import members
from funnelwright.operators.ordered import BLOCK, framed, running

ROWS_EACH = 250_000


def per_day_average(df: DataFrame, keys: Sequence[str], dt: str, cond: Column) -> DataFrame:
    """Rows per observed day; days are combined before they are counted."""
    per_day = df.where(cond).groupBy(*keys, dt).agg(F.count("*").alias("n"))
    return per_day.groupBy(*keys).agg(F.avg("n").alias("per_day"))


def distinct_by_stage(df: DataFrame, keys: Sequence[str], user: str, order_flag: Column) -> DataFrame:
    """Distinct users and flagged rows from one combined (keys, user) table, without row expansion."""
    u = df.groupBy(*keys, user).agg(F.count(F.when(order_flag, 1)).alias("orders"))
    return u.groupBy(*keys).agg(F.count(user).alias("users"), F.sum("orders").alias("orders"))


def with_overall(df: DataFrame, keys: Sequence[str], member: str, name: str, entity: str, sums: Mapping[str, str]) -> DataFrame:
    """Per member and de-duplicated overall from one scan, after one that counts the rows.

    Rows shrink to (keys, member, entity) first; the overall row then counts each entity once. More than ``ROWS_EACH``
    rows a shuffle partition are dealt by (keys, entity) into as many as that takes, which serves both groupings.
    """
    pieces = -(-df.count() // ROWS_EACH)
    if pieces > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(pieces, *keys, entity)
    base = df.groupBy(*keys, member, entity).agg(*[F.sum(c).alias(o) for o, c in sums.items()])
    both = base.select(*keys, entity, *sums, F.explode(F.array(F.col(member), F.lit("overall"))).alias(name))
    u = both.groupBy(*keys, name, entity).agg(*[F.sum(o).alias(o) for o in sums])
    return u.groupBy(*keys, name).agg(F.count(entity).alias("n_distinct"), *[F.sum(o).alias(o) for o in sums])


def single_dimension_cube(df: DataFrame, dims: Mapping[str, str], aggs: Sequence[Column]) -> DataFrame:
    """Overall plus every member of every dimension in one aggregation."""
    d = df.withColumns({k: F.col(v).cast("string") for k, v in dims.items()})
    sets = [[], *[[F.col(k)] for k in dims]]
    tag = F.lit("overall")
    for k in dims:
        tag = F.when(F.grouping(k) == 0, k).otherwise(tag)
    g = d.groupingSets(sets, *[F.col(k) for k in dims]).agg(tag.alias("tag"), *aggs)
    keep = [c for c in g.columns if c not in dims]
    return g.withColumn("member", F.coalesce(*[F.col(k) for k in dims], F.lit("overall"))).select("tag", "member", *[c for c in keep if c != "tag"])


def moments(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    """n, mean, sample deviation, biased and bias-corrected skewness and excess kurtosis."""
    g = df.groupBy(*keys).agg(
        F.count(c).cast("double").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.skewness(c).alias("skew_biased"), F.kurtosis(c).alias("kurt_biased")
    )
    n = F.col("n")
    return g.withColumns({
        "skew_corrected": F.when(n > 2, F.col("skew_biased") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)),
        "kurt_corrected": F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.col("kurt_biased") + 6)),
    })


def weighted_mean(df: DataFrame, x: str, weight: str, segment: str) -> DataFrame:
    """Per segment and overall; only positive weights count."""
    d = members(df.where(F.col(weight) > 0), [segment], [x, weight])
    return d.groupBy(F.col("member").alias("segment")).agg(
        F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(weight)).alias("weighted"), F.avg(x).alias("unweighted"), F.count("*").alias("n")
    )


def most_common(df: DataFrame, c: str, k: int) -> DataFrame:
    return df.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes; the right edge belongs to the last bin."""
    ends = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("e"))
    x = df.where(F.col(c).isNotNull()).select(F.col(c).alias("x")).withColumn("e", ends.scalar())
    width = (F.col("e.hi") - F.col("e.lo")) / F.lit(float(bins))
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("e.lo"), width)), F.lit(0)).cast("int"), F.lit(bins - 1))
    g = x.groupBy(b.alias("bin"), "e").agg(F.count("*").alias("n"))
    return g.select("bin", (F.col("e.lo") + F.col("bin") * width).alias("left"), "n")


def share_of(value: str | Column, keys: Sequence[str]) -> Column:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.try_divide(v, F.sum(v).over(W.partitionBy(*keys)))


def with_previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """``prev_`` columns from the row before; a key of any size is scanned piece by piece."""
    return running(df, keys, [order], previous={f"prev_{c}": c for c in columns})


def moving(df: DataFrame, c: str, keys: Sequence[str], order: str, window: int, min_periods: int, block: int = BLOCK) -> DataFrame:
    """``moving_mean`` and ``moving_sd`` over ``window`` rows including the current one, null under ``min_periods``."""

    def new(w):
        f = w.rowsBetween(-(window - 1), 0)
        enough = F.count(c).over(f) >= min_periods
        return {"moving_mean": F.when(enough, F.avg(c).over(f)), "moving_sd": F.when(enough, F.stddev_samp(c).over(f))}

    return framed(df, keys, [order], window - 1, new, block)


def prior_z(df: DataFrame, c: str, keys: Sequence[str], order: str, window: int, block: int = BLOCK) -> DataFrame:
    """``z``: distance from the ``window`` rows before the point in their own deviations."""

    def new(w):
        f = w.rowsBetween(-window, -1)
        sd = F.stddev_samp(c).over(f)
        return {"z": F.when((F.count(c).over(f) == window) & (sd > 0), (F.col(c) - F.avg(c).over(f)) / sd)}

    return framed(df, keys, [order], window, new, block)


def run_length(df: DataFrame, flag: str, keys: Sequence[str], order: str, sizes: Sequence[int], block: int = BLOCK) -> DataFrame:
    """``of<k>``: flagged rows among the last k, for every k of ``sizes``."""
    return framed(df, keys, [order], max(sizes) - 1, lambda w: {f"of{k}": F.sum(flag).over(w.rowsBetween(-(k - 1), 0)) for k in sizes}, block)


def islands(days: DataFrame, keys: Sequence[str], dt: str) -> DataFrame:
    """Runs of consecutive days; ``days`` holds one row per key and day."""
    g = running(days, keys, [dt], row_number="_rn").withColumn("_grp", F.date_sub(F.col(dt), F.col("_rn").cast("int")))
    return g.groupBy(*keys, "_grp").agg(F.min(dt).alias("island_start"), F.max(dt).alias("island_end"), F.count("*").alias("days")).drop("_grp")


def gaps(days: DataFrame, keys: Sequence[str], dt: str) -> DataFrame:
    """Missing stretches between observed days: first and last missing day and length."""
    g = running(days, keys, [dt], previous={"_prev": dt}).where(F.datediff(dt, "_prev") > 1)
    return g.select(*keys, F.date_add("_prev", 1).alias("gap_start"), F.date_sub(dt, 1).alias("gap_end"), (F.datediff(dt, "_prev") - 1).cast("long").alias("missing_days"))


def position_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """1-based position and size of the group; long groups are numbered piece by piece."""
    size = df.groupBy(*keys).agg(F.count("*").alias("size"))
    return running(df, keys, order, row_number="pos").join(size, list(keys))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value in a stated order: combinable, no sort of the group."""
    pos = F.struct(*[F.col(o) for o in order])
    return df.groupBy(*keys).agg(
        F.min_by(value, pos).alias(f"first_{value}"), F.max_by(value, pos).alias(f"last_{value}"), F.min(order[0]).alias(f"first_{order[0]}"), F.max(order[0]).alias(f"last_{order[0]}")
    )


def ordinal_violations(df: DataFrame, keys: Sequence[str], order: str, c: str) -> DataFrame:
    """Rows lower than the one before and the first such position."""
    d = running(df, keys, [order], previous={"_prev": c}).withColumn("_bad", F.col(c) < F.col("_prev"))
    return d.groupBy(*keys).agg(F.count(F.when(F.col("_bad"), 1)).alias("violations"), F.min(F.when(F.col("_bad"), F.col(order))).alias("first_violation"))
