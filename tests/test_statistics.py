"""Distribution helpers against published values, tests against direct formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from funnelwright.functions import dist
from funnelwright.operators import growth as G
from funnelwright.operators import series as Q
from funnelwright.operators import stats as D


@pytest.mark.parametrize("got,want", [
    (dist.norm_ppf(0.975), 1.959963984540054), (dist.norm_ppf(0.8), 0.8416212335729143), (dist.norm_cdf(1.0), 0.8413447460685429),
    (dist.t_ppf(0.975, 1), 12.706204736), (dist.t_ppf(0.975, 10), 2.228138852), (dist.t_ppf(0.995, 30), 2.749995654), (dist.t_cdf(-2.0, 5), 0.05096973941),
    (dist.chi2_sf(3.841458821, 1), 0.05), (dist.chi2_sf(18.30703805, 10), 0.05), (dist.chi2_ppf(0.95, 4), 9.487729037), (dist.f_sf(4.964602744, 1, 10), 0.05), (dist.f_ppf(0.95, 5, 20), 2.710889837),
    (dist.t_two_sided(2.0, 1e9), 2 * dist.norm_sf(2.0)), (dist.t_two_sided(2.5, 9.99e6), dist.t_two_sided(2.5, 1.001e7)), (dist.t_two_sided(3.0, 1e13), 2 * dist.norm_sf(3.0)), (dist.f_sf(2.0, 4, 1e12), dist.chi2_sf(8.0, 4)), (dist.chi2_sf(80.0, 2), math.exp(-40.0)),
])
def test_distributions(got, want):
    assert got == pytest.approx(want, rel=2e-7)


def test_welch_and_effect(spark):
    a, b = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    r = D.with_t_p(D.welch_ttest(df, F.col("g"), "x", "a", "b")).first()
    va, vb = np.var(a, ddof=1) / 5, np.var(b, ddof=1) / 6
    assert r["t"] == pytest.approx((3 - 7) / math.sqrt(va + vb))
    assert r["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 4 + vb**2 / 5))
    assert r["p_value"] == pytest.approx(dist.t_two_sided(r["t"], r["df"]))
    assert r["effect"].startswith("Large")


def test_rank_test_counts_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 15, 60), rng.integers(3, 18, 45)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, x double")
    want = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    r = D.mann_whitney(df, "g", "x", "a", "b").first()
    assert r["u"] == want and r["median_a"] == np.median(a)


def test_compare_segments_picks_the_test(spark):
    rng = np.random.default_rng(5)
    normal = [(s, float(x)) for s, m in (("a", 0), ("b", 0.1), ("c", 2)) for x in rng.normal(m, 1, 400)]
    df = spark.createDataFrame(normal, "s string, x double")
    out = {(r["seg_a"], r["seg_b"]): r for r in D.with_pairwise_p(D.compare_segments(df, "s", "x")).collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r["test_used"] for r in out.values()} == {"welch-t"} and out[("a", "c")]["significant"]
    small = df.unionByName(spark.createDataFrame([("d", 1.0)] * 5, "s string, x double"))
    assert {r["test_used"] for r in D.compare_segments(small, "s", "x").collect()} == {"mann-whitney"}


def test_bootstrap_covers_the_mean(spark):
    x = np.random.default_rng(1).normal(50, 10, 2000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, x double")
    r = D.bootstrap_ci(df, "id", "x", D.weighted_mean_stat, replicates=300).first()
    se = x.std(ddof=1) / math.sqrt(len(x))
    assert r["stat"] == pytest.approx(x.mean())
    assert r["ci_upper"] - r["ci_lower"] == pytest.approx(2 * 1.96 * se, rel=0.25) and r["ci_lower"] < x.mean() < r["ci_upper"]


def test_chi2_with_an_empty_cell(spark):
    df = spark.createDataFrame([("a", "x")] * 12 + [("b", "x")] * 5 + [("b", "y")] * 9, "r string, c string")
    o = np.array([[12.0, 0.0], [5.0, 9.0]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    want = ((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2 / e).sum()
    assert D.chi2_independence(df, "r", "c").first()["chi2"] == pytest.approx(want)


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "f string, i int, p double")
    r = {x["i"]: x for x in D.adjust_pvalues(df, "p", ["f"], "i").collect()}
    assert [r[i]["holm"] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert [r[i]["bh"] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02])
    assert [r[i]["bonferroni"] for i in range(4)] == pytest.approx([0.04, 0.16, 0.12, 0.02])


def _reference_score(s, labels):
    """The documented rule: five bins, then fewer with the first labels, then the middle score."""
    for q in range(5, 1, -1):
        edges = s.quantile(np.linspace(0, 1, q + 1)).to_numpy()
        if len(np.unique(edges)) == q + 1:
            return pd.cut(s, edges, labels=labels[:q], include_lowest=True).astype(int)
    return pd.Series(3, index=s.index)


@pytest.mark.parametrize("freq", [[1] * 50 + [2] * 40 + [3] * 6 + [9] * 4, list(range(1, 101)), [4] * 100, [1] * 30 + [2] * 30 + [3] * 40])
def test_rfm_scores_with_ties(spark, freq):
    data = [(c, f"2024-01-{1 + c % 28:02d}", float(f)) for c, f in enumerate(freq) for _ in range(f)]
    df = spark.createDataFrame(data, "c int, d string, v double").withColumn("d", F.to_date("d"))
    got = G.rfm(df, "c", "d", "v").toPandas().set_index("customer").sort_index()
    np.testing.assert_array_equal(got["F"], _reference_score(got["frequency"], [1, 2, 3, 4, 5]))
    np.testing.assert_array_equal(got["R"], _reference_score(got["recency"], [5, 4, 3, 2, 1]))


def test_concentration_extremes(spark):
    equal = spark.createDataFrame([(i, 10.0) for i in range(200)], "k int, v double")
    one = spark.createDataFrame([(i, 1000.0 if i == 0 else 0.0) for i in range(200)], "k int, v double")
    assert G.concentration(equal, "v", "k").first()["gini"] == pytest.approx(0.0, abs=1e-9)
    r = G.concentration(one, "v", "k").first()
    assert r["gini"] == pytest.approx(199 / 200) and r["top_10_share"] == 1.0 and r["pareto_ratio"] == 0.5


def test_control_chart_rules(spark):
    x = [10.0, 11.0] * 10 + [30.0] + [10.0, 11.0] * 5 + [12.0] * 9
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    r = Q.control_chart(df, ["k"], "i", "v").orderBy("i").collect()
    assert [i for i, p in enumerate(r) if p["rule1"]] == [20]
    c = np.mean(x)
    run = [i for i in range(7, len(x)) if all(v > c for v in x[i - 7:i + 1]) or all(v < c for v in x[i - 7:i + 1])]
    assert [i for i, p in enumerate(r) if p["rule4"]] == run


def test_smoothing_recurrences():
    x = np.array([3.0, 5.0, 9.0, 4.0, 6.0])
    f, ahead = Q._smooth(x, 0.5, None, None)
    assert f.tolist() == [3.0, 4.0, 6.5, 5.25, 5.625] and ahead.tolist() == [3.0, 3.0, 4.0, 6.5, 5.25]
    line = np.arange(20.0) * 2 + 1
    f, ahead = Q._smooth(line, 0.4, 0.3, None)
    np.testing.assert_allclose(ahead[1:], line[1:])
    season = np.tile([10.0, 20.0, 15.0, 5.0], 6)
    _, ahead = Q._smooth(season, 0.3, 0.1, 4)
    np.testing.assert_allclose(ahead, season)
    assert Q._best_alpha(lambda a: (a - 0.37) ** 2) == pytest.approx(0.37, abs=1e-4)


def test_seasonality_finds_the_week(spark):
    noise = np.random.default_rng(0).normal(0, 0.5, 140)
    df = spark.createDataFrame([("w", i, float([5, 6, 7, 8, 9, 20, 18][i % 7] + noise[i])) for i in range(140)] + [("c", i, 4.0) for i in range(50)], "k string, i int, v double")
    r = {x["k"]: x for x in Q.seasonality(df, ["k"], "i", "v").collect()}
    assert r["w"]["dominant_period"] % 7 == 0 and r["w"]["label"] == "strong" and "c" not in r


def test_trend_words(spark):
    s = {"increasing": [10 + i for i in range(20)], "decreasing": [40 - i for i in range(20)], "stable": [10, 10.01] * 10, "volatile": [1, 50] * 10, "unknown": [1, 2, 3]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in s.items() for i, v in enumerate(x)], "k string, i int, v double")
    assert {r["k"]: r["trend"] for r in Q.linear_trend(df, ["k"], "i", "v").collect()} == {k: k for k in s}


@pytest.mark.parametrize("block", [10, 100_000])
def test_adjusted_p_values_of_a_large_family(spark, block):
    """One family over many pieces against the plain step procedures."""
    rng = np.random.default_rng(4)
    p = np.round(rng.uniform(0, 0.2, 3_000) ** 2, 6)
    df = spark.createDataFrame([("f" if i % 10 else None, i, float(x)) for i, x in enumerate(p)], "f string, i long, p double").repartition(8)
    got = {r.i: r for r in D.adjust_pvalues(df, "p", ["f"], "i", block=block).collect()}
    for own in ([i for i in range(3_000) if i % 10], [i for i in range(3_000) if i % 10 == 0]):
        own.sort(key=lambda i: (p[i], i))
        n, high, low = len(own), 0.0, 1.0
        holm = [high := max(high, p[i] * (n - k)) for k, i in enumerate(own)]
        bh = [low := min(low, p[i] * n / (k + 1)) for k, i in reversed(list(enumerate(own)))][::-1]
        for k, i in enumerate(own):
            np.testing.assert_allclose((got[i].holm, got[i].bh, got[i].bonferroni), (min(holm[k], 1), min(bh[k], 1), min(p[i] * n, 1)))


def test_segments_against_the_rest(spark):
    """Each comparison has its own test: the skewed segment is ranked, the others are Welch's."""
    rng = np.random.default_rng(11)
    data = [("a", x) for x in rng.normal(10, 2, 200)] + [("b", x) for x in rng.normal(11, 2, 300)] + [("c", x) for x in rng.exponential(9, 80)]
    data = [(s, float(np.round(x, 1))) for s, x in data]
    df = spark.createDataFrame(data, "s string, x double")
    got = {r.segment: r for r in D.segments_vs_rest(df, "s", "x").collect()}
    assert {s: r.test_used for s, r in got.items()} == {"a": "welch-t", "b": "welch-t", "c": "mann-whitney"}
    for s in "abc":
        x, y = np.array([v for k, v in data if k == s]), np.array([v for k, v in data if k != s])
        n, m = len(x), len(y)
        u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
        va, vb = x.var(ddof=1) / n, y.var(ddof=1) / m
        np.testing.assert_allclose(got[s].t, (x.mean() - y.mean()) / np.sqrt(va + vb))
        np.testing.assert_allclose(got[s].effect_size, (x.mean() - y.mean()) / np.sqrt(((n - 1) * x.var(ddof=1) + (m - 1) * y.var(ddof=1)) / (n + m - 2)))
        ties = np.unique(np.concatenate([x, y]), return_counts=True)[1].astype(float)
        sd = np.sqrt(n * m / 12 * (n + m + 1 - (ties**3 - ties).sum() / ((n + m) * (n + m - 1))))
        np.testing.assert_allclose(got[s].z, (max(u, n * m - u) - n * m / 2 - 0.5) / sd)
        if s == "c":
            assert got[s].stat == u
    each = {(r.seg_a, r.seg_b): r.test_used for r in D.compare_segments(df, "s", "x", each=True).collect()}
    assert each == {("a", "b"): "welch-t", ("a", "c"): "mann-whitney", ("b", "c"): "mann-whitney"}
    plan = D.compare_segments(df, "s", "x")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_bootstrap_repeats_no_row(spark):
    df = spark.range(1_000).select("id", F.rand(3).alias("x"))
    out = D.bootstrap_ci(df, "id", "x", D.weighted_mean_stat, replicates=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and out.first().replicates == 50
