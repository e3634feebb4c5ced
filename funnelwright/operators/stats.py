"""Statistical tests from sufficient statistics: one aggregation over the data, formulas on its few rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions import dist
from funnelwright.functions.scalars import ratio
from funnelwright.operators.aggregates import histogram, moments
from funnelwright.operators.ordered import BLOCK, extremes, quantiles, ranked_counts, running, value_counts
from funnelwright.session import cut_lineage

Z975 = dist.norm_ppf(0.975)


def significance_label(p: str | Column, alpha: float = 0.05) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return F.when(c < 0.001, "Highly significant (p<0.001)").when(c < alpha, F.format_string("Statistically significant (p=%.3f)", c)).when(c.isNotNull(), F.format_string("Not statistically significant (p=%.3f)", c))


def effect_label(d: str | Column) -> Column:
    a = F.abs(F.col(d) if isinstance(d, str) else d)
    name = F.when(a < 0.2, "Small").when(a <= 0.8, "Medium").otherwise("Large")
    return F.when(a.isNotNull(), F.format_string("%s effect (d=%.2f)", name, a))


def mean_stats(df: DataFrame, keys: Sequence[str], c: str) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    return g.withColumn("se", F.col("sd") / F.sqrt("n"))


def mean_ci(df: DataFrame, keys: Sequence[str], c: str, confidence: float = 0.95) -> DataFrame:
    return dist.with_t_interval(mean_stats(df, keys, c), "mean", "se", "n", confidence)


def prop_ztest(df: DataFrame, group: Column, flag: Column, a, b, keys: Sequence[str] = (), z_crit: float = Z975) -> DataFrame:
    """Pooled z of two proportions with the unpooled interval of their difference."""
    g = df.select(*keys, group.alias("_g"), flag.alias("_f")).groupBy(*keys).agg(
        *[F.count(F.when(F.col("_g") == v, 1)).alias(f"n_{s}") for s, v in (("a", a), ("b", b))],
        *[F.count(F.when((F.col("_g") == v) & F.col("_f"), 1)).alias(f"x_{s}") for s, v in (("a", a), ("b", b))],
    )
    pa, pb = ratio("x_a", "n_a"), ratio("x_b", "n_b")
    pooled = ratio(F.col("x_a") + F.col("x_b"), F.col("n_a") + F.col("n_b"))
    inv = F.try_divide(F.lit(1.0), F.col("n_a")) + F.try_divide(F.lit(1.0), F.col("n_b"))
    g = g.withColumns({"prop_a": pa, "prop_b": pb, "diff": pb - pa, "_se": F.sqrt(pooled * (1 - pooled) * inv)})
    se = F.sqrt(F.col("prop_a") * (1 - F.col("prop_a")) / F.col("n_a") + F.col("prop_b") * (1 - F.col("prop_b")) / F.col("n_b"))
    return g.withColumns({
        "z": F.when(F.col("_se") > 0, F.col("diff") / F.col("_se")).otherwise(0.0), "lift": F.try_divide("diff", "prop_a"),
        "ci_lower": F.col("diff") - z_crit * se, "ci_upper": F.col("diff") + z_crit * se,
    }).drop("_se")


def with_normal_p(df: DataFrame, z: str = "z") -> DataFrame:
    d = df.withColumn("p_value", dist.p_norm_two_sided(z))
    return d.withColumn("label", significance_label("p_value"))


def _welch(n_a, m_a, v_a, n_b, m_b, v_b) -> dict[str, Column]:
    qa, qb = v_a / n_a, v_b / n_b
    pooled = F.sqrt(F.try_divide((n_a - 1) * v_a + (n_b - 1) * v_b, n_a + n_b - 2))
    return {
        "t": F.try_divide(m_a - m_b, F.sqrt(qa + qb)),
        "df": F.try_divide((qa + qb) * (qa + qb), F.try_divide(qa * qa, n_a - 1) + F.try_divide(qb * qb, n_b - 1)),
        "cohens_d": F.coalesce(F.try_divide(m_b - m_a, pooled), F.lit(0.0)),
    }


def welch_ttest(df: DataFrame, group: Column, c: str, a, b, keys: Sequence[str] = ()) -> DataFrame:
    """t, Welch degrees of freedom and Cohen's d with the pooled deviation, from one aggregation."""
    x = F.col("_x")
    sel = lambda v: F.when(F.col("_g") == v, x)
    g = df.select(*keys, group.alias("_g"), F.col(c).alias("_x")).groupBy(*keys).agg(
        *[f(sel(v)).alias(f"{n}_{s}") for s, v in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    )
    w = _welch(F.col("n_a"), F.col("mean_a"), F.col("var_a"), F.col("n_b"), F.col("mean_b"), F.col("var_b"))
    return g.withColumns(w | {"diff": F.col("mean_b") - F.col("mean_a")})


def with_t_p(df: DataFrame) -> DataFrame:
    d = df.withColumn("p_value", dist.p_t_two_sided("t", "df"))
    return d.withColumns({"label": significance_label("p_value"), "effect": effect_label("cohens_d")})


def _rank_sums(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """U of side a, normal deviate with tie and continuity correction; input (keys, v, n_a, n_b)."""
    c = cut_lineage(counts.withColumn("_t", F.col("n_a") + F.col("n_b")))  # counted, sampled and dealt: the table is read once for it
    run = running(c, keys, ["v"], sums={"_cum": "_t"})
    t = F.col("_t").cast("double")
    rank = F.col("_cum") - (t - 1) / 2.0
    g = run.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum(F.col("n_a") * rank).alias("_r"), F.sum(t * t * t - t).alias("_ties"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    g = g.withColumn("u", F.col("_r") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    big = F.greatest(F.col("u"), na * nb - F.col("u"))
    return g.withColumns({"z": F.coalesce(F.try_divide(big - na * nb / 2 - 0.5, sd), F.lit(0.0)), "rank_biserial": 1 - F.try_divide(2 * F.col("u"), na * nb)}).drop("_r", "_ties")


def mann_whitney(df: DataFrame, group: str, c: str, a, b) -> DataFrame:
    """Rank test from value counts; duplicates are combined before ranking and no key is sorted in one task."""
    vc = value_counts(df.where(F.col(group).isin(a, b)), [group], c)
    counts = vc.groupBy("v").agg(*[F.coalesce(F.sum(F.when(F.col(group) == g, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s, g in (("a", a), ("b", b))])
    g = _rank_sums(counts, [])
    med = quantiles(df.where(F.col(group).isin(a, b)), [group], c, {"m": 0.5})
    m = med.agg(F.struct(F.max(F.when(F.col(group) == a, F.col("m"))).alias("a"), F.max(F.when(F.col(group) == b, F.col("m"))).alias("b")).alias("s"))
    return g.withColumn("_m", m.scalar()).select("*", F.col("_m.a").alias("median_a"), F.col("_m.b").alias("median_b")).drop("_m")


def chi2_independence(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square of a contingency table; 2×2 tables use the continuity correction.

    The cells that exist are counted once; margins are sums over them, and empty cells follow from the margins, so
    no grid is built.
    """
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").cast("double").alias("o"))
    wr, wc = W.partitionBy("r"), W.partitionBy("c")  # cells of one row or column of the table
    x = cells.withColumns({"ro": F.sum("o").over(wr), "kr": F.count("*").over(wr)}).withColumns({"co": F.sum("o").over(wc), "kc": F.count("*").over(wc)})
    g = x.agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ro") * F.col("co"))).alias("_s"), F.max(F.struct("r", "c", "o", "ro", "co")).alias("_cell"),
        F.round(F.sum(1 / F.col("kr"))).cast("long").alias("_rows"), F.round(F.sum(1 / F.col("kc"))).cast("long").alias("_cols"),
        F.sum(1 / (F.col("ro") * F.col("kr"))).alias("_ri"), F.sum(1 / (F.col("co") * F.col("kc"))).alias("_ci"),
    )
    d = F.abs(F.col("_cell.o") - F.col("_cell.ro") * F.col("_cell.co") / F.col("n"))
    adj = d - F.least(F.lit(0.5), d)
    two = (F.col("_rows") == 2) & (F.col("_cols") == 2)
    chi = F.when(two, adj * adj * F.col("n") * F.col("_ri") * F.col("_ci")).otherwise(F.col("n") * (F.col("_s") - 1))
    return g.select(F.col("n").cast("long").alias("n"), chi.alias("chi2"), ((F.col("_rows") - 1) * (F.col("_cols") - 1)).alias("dof"))


# Cumulative Poisson(1) probabilities: the number of them below a uniform draw is the weight.
_POISSON1 = [sum(math.exp(-1.0) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


_MASK = (1 << 32) - 1


def with_poisson_weights(df: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """``_w0``, ``_w1``, ...: a weight of every replicate from whole-number arithmetic on an integer ``key``.

    Uniform draws from three rounds of xor-shift and multiplication modulo 2^32 over both halves of the key, the same
    in any SQL engine. Each round is a projection of its own, so that no expression is repeated.
    """
    half, mask = "({x} ^ shiftright({x}, 16))", f"{_MASK}L"
    mix = f"({half} * 73244475L) & {mask}"
    weight = "case " + " ".join(f"when {{x}} < {p:.17e} then {k}" for k, p in enumerate(_POISSON1)) + f" else {len(_POISSON1)} end"
    first = {f"_w{b}": (seed * 2654435769 + (b + 1) * 40503) & _MASK for b in range(replicates)}
    out = df.selectExpr("*", *[f"({key} & {mask}) ^ {start}L as {n}" for n, start in first.items()])
    for f in (f"({mix}) ^ shiftrightunsigned({key}, 32)", mix, mix, f"cast({half} as double) / {float(1 << 32)!r}D", weight):
        out = out.selectExpr(*[f"`{c}`" for c in df.columns], *[f"{f.format(x=n)} as {n}" for n in first])
    return out


def bootstrap_ci(df: DataFrame, key: str, value: str, stat: Callable[[Column, Column], Column], replicates: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of ``stat(value, weight)`` over Poisson resamples.

    Each row draws its weight of every replicate from a seeded hash of its key (an integer, else its 64-bit hash). The
    replicates are columns of one aggregation, so no row is repeated and a task sends one row of sums.
    """
    k = F.col(key).cast("long") if dict(df.dtypes)[key] in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), k.alias("_k"))
    x = with_poisson_weights(x, "_k", replicates, seed)
    per = x.agg(stat(F.col("_v"), F.lit(1)).alias("stat"), *[stat(F.col("_v"), F.col(f"_w{b}")).alias(f"_s{b}") for b in range(replicates)])
    # One row: the replicates' values in order, those that could not be formed left out.
    own = per.select("stat", F.array_sort(F.filter(F.array(*[f"_s{b}" for b in range(replicates)]), lambda s: s.isNotNull())).alias("s"))
    n = F.size("s")

    def at(p: float) -> Column:
        h = (n - 1) * F.lit(p)
        lo, hi = F.get("s", F.floor(h).cast("int")), F.get("s", F.ceil(h).cast("int"))
        return lo + (hi - lo) * (h - F.floor(h))

    edge = (1 - confidence) / 2
    return own.select(at(edge).alias("ci_lower"), at(1 - edge).alias("ci_upper"), n.cast("long").alias("replicates"), "stat")


def weighted_mean_stat(v: Column, w: Column) -> Column:
    return F.sum(v * w) / F.sum(w)


def adjust_pvalues(df: DataFrame, p: str, family: Sequence[str], key: str, block: int = BLOCK) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg per family of tests, of any size.

    Tests are ranked piece by piece; Holm's running maximum and the other's minimum from a test on are carried over
    blocks of ranks.
    """
    n = df.groupBy(*family).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(family)], "_n")
    same = F.lit(True)
    for i, c in enumerate(family):
        same = same & F.col(c).eqNullSafe(F.col(f"_f{i}"))
    d = running(df, family, [p, key], row_number="_r").join(n, same).drop(*[f"_f{i}" for i in range(len(family))])
    d = d.withColumns({"_h": F.col(p) * (F.col("_n") - F.col("_r") + 1), "_q": F.col(p) * F.col("_n") / F.col("_r")})
    d = extremes(d, family, ["_r"], highest={"holm": "_h"}, lowest_from={"bh": "_q"}, block=block, number="_r")
    one = F.lit(1.0)
    return d.withColumns({"bonferroni": F.least(F.col(p) * F.col("_n"), one), "holm": F.least("holm", one), "bh": F.least("bh", one)}).drop("_n", "_r", "_h", "_q")


def k_squared(n: Column, g1: Column, g2: Column) -> dict[str, Column]:
    """D'Agostino's omnibus normality statistic from biased skewness and excess kurtosis; p is exact for 2 df."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    ya = y / F.sqrt(2 / (w2 - 1))
    z1 = F.ln(ya + F.sqrt(ya * ya + 1)) / F.sqrt(0.5 * F.ln(w2))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    den = 1 + x * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(den) * F.pow(F.try_divide(1 - 2 / a, F.abs(den)), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    ok = n >= 20
    return {"k2": F.when(ok, k2), "p_normal": F.when(ok, F.exp(-k2 / 2))}


def shape_words(skew: str, kurt: str) -> Column:
    s = F.when(F.abs(F.col(skew)) < 0.5, "approximately symmetric").when(F.col(skew) > 0, "right-skewed").otherwise("left-skewed")
    k = F.when(F.col(kurt) > 1, ", heavy-tailed").when(F.col(kurt) < -1, ", light-tailed").otherwise("")
    return F.concat(s, k)


PERCENTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def characterise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """n, mean, deviation, percentiles, biased skewness and kurtosis, normality and wording per column."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "column_name", "x").where("x is not null")
    m = moments(long, ["column_name"], "x")
    q = quantiles(long, ["column_name"], "x", PERCENTILES)
    d = m.join(q, "column_name").withColumns(k_squared(F.col("n"), F.col("skew_biased"), F.col("kurt_biased")))
    return d.withColumns({"is_normal": F.col("p_normal") >= 0.05, "shape": shape_words("skew_biased", "kurt_biased")})


def modality(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Peaks of an equal-width histogram: one is unimodal, two bimodal, more multimodal."""
    h = histogram(df, c, bins).select("bin", "n")
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(h, "bin", "left").fillna(0, ["n"])
    w = W.partitionBy().orderBy("bin")  # one row per bin
    p = full.withColumns({"_l": F.lag("n").over(w), "_r": F.lead("n").over(w)})
    peak = F.when(F.col("_l").isNull(), F.col("n") > F.col("_r")).when(F.col("_r").isNull(), F.col("n") > F.col("_l")).otherwise((F.col("n") > F.col("_l")) & (F.col("n") > F.col("_r")))
    g = p.agg(F.count(F.when(peak, 1)).alias("peaks"))
    return g.withColumn("modality", F.when(F.col("peaks") <= 1, "unimodal").when(F.col("peaks") == 2, "bimodal").otherwise("multimodal"))


def rank_dimensions(df: DataFrame, metric: str, dims: Sequence[str]) -> DataFrame:
    """Eta-squared and F of every dimension from one pass over unpivoted members."""
    long = df.where(F.col(metric).isNotNull()).unpivot([metric], [F.col(d).cast("string").alias(d) for d in dims], "dimension", "member").where("member is not null")
    x = F.col(metric).cast("double")
    # Deviations from each member's own mean, combined around the dimension's mean: large means cancel nothing.
    g = long.groupBy("dimension", "member").agg(F.count("*").alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count("*")).alias("ss"))
    big = F.col("n") >= 2
    means = g.groupBy("dimension").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), (F.sum(F.when(big, F.col("n") * F.col("m"))) / F.sum(F.when(big, F.col("n")))).alias("bm"))
    off = lambda c: F.col("n") * (F.col("m") - F.col(c)) * (F.col("m") - F.col(c))
    t = g.join(means, "dimension").groupBy("dimension").agg(
        F.count(F.when(big, 1)).alias("n_groups"), F.sum(F.when(big, F.col("n"))).alias("n2"), F.sum(F.col("ss") + off("gm")).alias("total"),
        F.sum(F.when(big, off("gm"))).alias("between"), F.sum(F.when(big, off("bm"))).alias("own"), F.sum(F.when(big, F.col("ss"))).alias("within"),
    )
    total, between, own, within = (F.col(c) for c in ("total", "between", "own", "within"))
    k = F.col("n_groups")
    t = t.withColumns({
        "eta_squared": F.when(k >= 2, F.coalesce(F.try_divide(between, total), F.lit(0.0))).otherwise(0.0),
        "f_statistic": F.when(k >= 2, F.try_divide(own / (k - 1), F.try_divide(within, F.col("n2") - k))).otherwise(0.0), "df1": k - 1, "df2": F.col("n2") - k,
    })
    rank = F.row_number().over(W.orderBy(F.desc("eta_squared"), "dimension"))  # one row per dimension
    return t.withColumn("rank", rank).select("dimension", "eta_squared", "n_groups", "f_statistic", "df1", "df2", "rank")


def segment_stats(df: DataFrame, segment: str, metric: str, median: bool = True) -> DataFrame:
    """Summary per segment plus the normality verdict that decides the test."""
    d = df.where(F.col(segment).isNotNull() & F.col(metric).isNotNull())
    m = moments(d, [segment], metric)
    if median:
        m = m.join(quantiles(d, [segment], metric, {"median": 0.5}), segment)
    return m.withColumns(k_squared(F.col("n"), F.col("skew_biased"), F.col("kurt_biased"))).withColumn("use_rank", (F.col("n") < 30) | F.coalesce(F.col("p_normal") < 0.05, F.lit(False)))


def compare_segments(df: DataFrame, segment: str, metric: str, each: bool = False) -> DataFrame:
    """Every pair of segments: rank test when any segment (with ``each``: of the pair) is small or not normal, else
    Welch's t.

    The pairs are the wanted rows, made from one row per segment; each segment's value counts (not its rows) go to its
    pairs. For many segments see :func:`segments_vs_rest`.
    """
    s = segment_stats(df, segment, metric, median=False).select(F.col(segment).alias("seg"), "n", "mean", (F.col("sd") * F.col("sd")).alias("var"), "use_rank")
    # One row per segment, read many times below: written once so the data is not aggregated again for each use.
    s = cut_lineage(s)
    every = s.agg(F.sort_array(F.collect_list(F.struct("seg", "n", "mean", "var", "use_rank"))).alias("all"), F.bool_or("use_rank").alias("_rank"), (F.count("*") * (F.count("*") - 1) / 2).alias("n_pairs"))
    a = every.select("all", "_rank", "n_pairs", F.posexplode("all").alias("i", "a"))
    p = a.select("_rank", "n_pairs", "a", F.explode(F.filter("all", lambda x, k: k > F.col("i"))).alias("b"))
    p = p.select("_rank", "n_pairs", *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in ("seg", "n", "mean", "var", "use_rank")])
    if each:
        p = p.withColumn("_rank", F.col("use_rank_a") | F.col("use_rank_b"))
    w = _welch(F.col("n_a"), F.col("mean_a"), F.col("var_a"), F.col("n_b"), F.col("mean_b"), F.col("var_b"))
    p = p.withColumns(w).withColumn("cohens_d", -F.col("cohens_d"))
    vc = value_counts(df.where(F.col(segment).isNotNull()), [segment], metric)
    sides = p.select("seg_a", "seg_b", F.explode(F.array(F.col("seg_a"), F.col("seg_b"))).alias("_seg"))
    j = sides.join(vc, F.col("_seg") == F.col(segment))
    counts = j.groupBy("seg_a", "seg_b", "v").agg(*[F.coalesce(F.sum(F.when(F.col("_seg") == F.col(f"seg_{x}"), F.col("n"))), F.lit(0)).alias(f"n_{x}") for x in "ab"])
    u = _rank_sums(counts, ["seg_a", "seg_b"]).select("seg_a", "seg_b", "u", "z")
    out = p.join(u, ["seg_a", "seg_b"])
    return out.select("seg_a", "seg_b", F.when(F.col("_rank"), "mann-whitney").otherwise("welch-t").alias("test_used"), F.when(F.col("_rank"), F.col("u")).otherwise(F.col("t")).alias("stat"),
                      F.col("cohens_d").alias("effect_size"), "t", "df", "z", "n_pairs")


def segments_vs_rest(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Each segment against all other rows together, linear in rows and segments.

    One pooled ranking of the values gives every segment's rank sum; the mean and variance of the rest follow from the
    totals. The test is chosen for each comparison: the rank test where the segment or the rest is small or the segment
    is not normal, Welch's t otherwise. Columns as :func:`compare_segments`, with ``segment`` in place of the pair.
    """
    d = df.where(F.col(segment).isNotNull() & F.col(metric).isNotNull()).select(F.col(segment).alias("segment"), F.col(metric).cast("double").alias("_x"))
    vc = value_counts(d, ["segment"], "_x")
    pooled = vc.groupBy("v").agg(F.sum("n").alias("n"))
    # Mean rank and tie term of each value, once for all segments.
    ranks = running(pooled, [], ["v"], sums={"cum": "n"}).select(F.col("v").alias("_v"), (F.col("cum") - (F.col("n") - 1) / 2.0).alias("rank"), (F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("tie"))
    sums = vc.join(ranks, F.col("v") == F.col("_v")).groupBy("segment").agg(F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))
    ties = ranks.agg(F.sum("tie").alias("t")).scalar()
    s = segment_stats(d, "segment", "_x", median=False).select("segment", "n", "mean", (F.col("sd") * F.col("sd")).alias("var"), "use_rank")
    # Deviations from each segment's own mean, combined around the mean of the rest: large means cancel nothing.
    total = s.agg(F.struct(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.count("*").alias("segments")).alias("t"))
    s = s.withColumn("_t", total.scalar())
    own = (F.col("n") - 1) * F.coalesce("var", F.lit(0.0)) + F.col("n") * (F.col("mean") - F.col("_t.mean")) * (F.col("mean") - F.col("_t.mean"))
    spread = s.agg(F.sum(own).alias("ss")).scalar()
    nr = F.col("_t.n") - F.col("n")
    mean_r = F.col("_t.mean") - F.col("n") * (F.col("mean") - F.col("_t.mean")) / nr
    s = s.where(nr > 0).withColumns({"n_r": nr, "mean_r": mean_r, "n_comparisons": F.col("_t.segments")})
    var_r = F.when(F.col("n_r") > 1, F.greatest(F.lit(0.0), (spread - own - F.col("n_r") * (F.col("mean_r") - F.col("_t.mean")) * (F.col("mean_r") - F.col("_t.mean"))) / (F.col("n_r") - 1)))
    s = s.withColumn("var_r", var_r).join(sums, "segment")
    w = _welch(F.col("n"), F.col("mean"), F.col("var"), F.col("n_r"), F.col("mean_r"), F.col("var_r"))
    s = s.withColumns(w).withColumn("cohens_d", -F.col("cohens_d"))
    n, m, all_ = F.col("n"), F.col("n_r"), F.col("n") + F.col("n_r")
    u = F.col("rank_sum") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * (all_ + 1 - F.coalesce(ties, F.lit(0.0)) / (all_ * (all_ - 1))))
    z = F.coalesce(F.try_divide(F.greatest(u, n * m - u) - n * m / 2 - 0.5, sd), F.lit(0.0))
    s = s.withColumns({"u": u, "z": z, "_rank": F.col("use_rank") | (F.col("n_r") < 30)})
    return s.select("segment", F.when(F.col("_rank"), "mann-whitney").otherwise("welch-t").alias("test_used"), F.when(F.col("_rank"), F.col("u")).otherwise(F.col("t")).alias("stat"),
                    F.col("cohens_d").alias("effect_size"), "t", "df", "z", F.col("n_comparisons").alias("n_pairs"))


def with_pairwise_p(compared: DataFrame) -> DataFrame:
    """Two-sided p values with Bonferroni correction."""
    d = compared.withColumns({"_pz": dist.p_norm_two_sided("z"), "_pt": dist.p_t_two_sided("t", "df")})
    d = d.withColumn("p_value", F.when(F.col("test_used") == "mann-whitney", F.col("_pz")).otherwise(F.col("_pt")))
    d = d.withColumn("p_adjusted", F.least(F.col("p_value") * F.col("n_pairs"), F.lit(1.0)))
    return d.withColumn("significant", F.col("p_adjusted") < 0.05).drop("_pz", "_pt", "t", "df", "z", "n_pairs")


def correlations(df: DataFrame, cols: Sequence[str], threshold: float) -> DataFrame:
    """All pairs of columns in one aggregation; strength and direction in words."""
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.corr(a, b).alias("r")) for a, b in combinations(cols, 2)]
    g = df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("x")).select("x.*").where(F.abs("r") >= threshold)
    a = F.abs("r")
    return g.withColumns({"strength": F.when(a >= 0.8, "very strong").when(a >= 0.6, "strong").when(a >= 0.4, "moderate").otherwise("weak"), "direction": F.when(F.col("r") > 0, "positive").otherwise("negative")})


def group_difference(df: DataFrame, metric: str, attrs: Sequence[str], low: float = 0.5, high: float = 0.5) -> DataFrame:
    """Means of attributes in the high and low group of a metric, ranked by scaled difference."""
    q = quantiles(df, [], metric, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("q"))
    d = df.withColumn("_q", q.scalar()).withColumn("_side", F.when(F.col(metric) > F.col("_q.hi"), "high").when(F.col(metric) <= F.col("_q.lo"), "low"))
    long = d.unpivot(["_side"], [F.col(a).cast("double").alias(a) for a in attrs], "attribute", "x")
    g = long.groupBy("attribute").agg(F.avg(F.when(F.col("_side") == "high", F.col("x"))).alias("mean_high"), F.avg(F.when(F.col("_side") == "low", F.col("x"))).alias("mean_low"), F.stddev_samp("x").alias("sd"))
    g = g.withColumns({"diff": F.col("mean_high") - F.col("mean_low"), "scaled": F.try_divide(F.col("mean_high") - F.col("mean_low"), F.col("sd"))})
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("scaled")), "attribute")))  # one row per attribute


def feature_importance(df: DataFrame, target: str, cols: Sequence[str], seed: int = 42, trees: int = 20, depth: int = 5, least_cols: int = 5, least_rows: int = 500, fit_rows: int = 2_000_000) -> DataFrame:
    """Forest importances for ranking, fitted on about ``fit_rows`` complete rows at most (by a hash of their values;
    all rows where there are fewer). ``advised`` says whether there are more than ``least_cols`` columns and
    ``least_rows`` complete rows, below which a ranking means little; the fit is made either way."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    schema = "feature string, importance double, rank int, advised boolean"
    x = VectorAssembler(inputCols=list(cols), outputCol="features").transform(df.select(*[F.col(c).cast("double") for c in (*cols, target)]).dropna())
    rows = x.count()
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    if rows > fit_rows:
        x = x.where(F.pmod(F.xxhash64(*cols, target), F.lit(1 << 30)) < int(fit_rows / rows * (1 << 30)))
    model = RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(x)
    ranked = sorted(zip(cols, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return df.sparkSession.createDataFrame([(c, float(v), i, len(cols) > least_cols and rows > least_rows) for i, (c, v) in enumerate(ranked, 1)], schema)


def run_summary(df: DataFrame, config: str, metrics: Sequence[str], first: str, second: str) -> DataFrame:
    """Mean, deviation and extremes per configuration with the difference of two of them."""
    long = df.unpivot([config], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "x")
    g = long.groupBy("metric", config).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = W.partitionBy("metric")
    pick = lambda v: F.max(F.when(F.col(config) == v, F.col("mean"))).over(w)
    return g.withColumn("delta", pick(second) - pick(first))


def segment_summary(df: DataFrame, dims: Sequence[str], metric: str, apart: float = 0.2, small: int = 100) -> DataFrame:
    """Size, share, mean against overall and best-to-worst gap per dimension, in one scan."""
    long = df.unpivot([metric], [F.col(d).cast("string").alias(d) for d in dims], "dimension", "member")
    g = long.groupBy("dimension", "member").agg(F.count("*").alias("n"), F.sum(metric).alias("s"), F.avg(metric).alias("mean"))
    w = W.partitionBy("dimension")
    g = g.withColumns({"share": ratio("n", F.sum("n").over(w)), "overall": F.sum("s").over(w) / F.sum("n").over(w), "gap": F.max("mean").over(w) - F.min("mean").over(w)})
    g = g.withColumn("vs_overall", F.try_divide(F.col("mean"), F.col("overall")) - 1)
    return g.withColumns({"stands_out": F.abs("vs_overall") > apart, "too_small": F.col("n") < small}).drop("s")
