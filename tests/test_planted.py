"""Planted patterns with known answers."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from funnelwright.functions import scalars as S
from funnelwright.functions.lexicons import PHRASES_ZH
from funnelwright.operators import causal as E
from funnelwright.operators import checks as V
from funnelwright.operators import findings as L
from funnelwright.operators import growth as G
from funnelwright.operators import panel as P
from funnelwright.operators import profile as B
from funnelwright.operators import rootcause as RC
from funnelwright.operators import sessions as X
from funnelwright.operators import text as N

D0 = dt.date(2024, 1, 1)
day = lambda i: D0 + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def paradox(spark):
    rows = []
    for g, d, yes, n in (("A", "easy", 80, 100), ("A", "hard", 20, 100), ("B", "easy", 46, 60), ("B", "hard", 3, 20)):
        rows += [(g, d, 1 if i < yes else 0) for i in range(n)]
    return spark.createDataFrame(rows, "grp string, dep string, ok int")


def test_simpson_paradox(paradox):
    r = RC.simpson(paradox, "ok", ["dep"], "grp", ("A", "B")).first()
    assert (r["overall_direction"], r["reversals"], r["paradox"], r["severity"]) == ("negative", 2, True, "high")
    s = {x["segment"]: x for x in RC.simpson_segments(paradox, "ok", ["dep"], "grp", ("A", "B")).collect()}
    assert s["easy"]["overall_a"] == pytest.approx(0.5) and s["easy"]["overall_b"] == pytest.approx(0.6125)


def test_no_paradox(spark):
    rows = [(g, d, 1 if i < y else 0) for g, y in (("X", 70), ("Y", 30)) for d in "abc" for i in range(100)]
    r = RC.simpson(spark.createDataFrame(rows, "grp string, dep string, ok int"), "ok", ["dep"], "grp").first()
    assert not r["paradox"] and r["severity"] == "none"


def test_mix_and_rate_effects_add_up(paradox):
    d = paradox.withColumn("post", F.col("grp") == "B")
    m = RC.mix_rate(d, "dep", F.col("ok"), F.lit(1), ~F.col("post"), F.col("post")).agg(F.sum("mix_effect").alias("m"), F.sum("rate_effect").alias("r")).first()
    assert m["m"] + m["r"] == pytest.approx(0.6125 - 0.5) and m["m"] > 0 > m["r"]


@pytest.fixture(scope="module")
def dirty_orders(spark):
    rows = []
    for i in range(100):
        oid = i if i < 95 else i - 95
        amount = {3: -10.0, 4: 0.0, 5: 1e7, 6: None, 7: None}.get(i, 50.0 + i)
        rows.append((oid, None if i % 10 == 9 else i % 30, None if i % 10 == 8 else day(i % 60), amount))
    return spark.createDataFrame(rows, "order_id int, user_id int, order_date date, amount double")


def test_defects_are_found(dirty_orders, spark):
    c = {(r["check"], r["subject"]): r for r in V.suite(
        V.check_primary_key(dirty_orders, ["order_id"]), V.check_duplicates(dirty_orders, ["order_id"]),
        V.scan_checks(dirty_orders, [V.completeness("user_id"), V.completeness("amount"), V.non_negative("amount"), V.value_range("amount", 0, 10000), V.row_count(100, 100)]),
        V.check_referential(dirty_orders, spark.range(25).withColumnRenamed("id", "user_id2"), "user_id", "user_id2"),
    ).collect()}
    assert (c["primary_key", "order_id"]["n_bad"], c["primary_key", "order_id"]["severity"]) == (5, "BLOCKER")
    assert (c["duplicates", "order_id"]["n_bad"], c["duplicates", "order_id"]["detail"]) == (10, "0;1;2;3;4")
    assert c["completeness", "user_id"]["severity"] == "WARNING" and c["completeness", "user_id"]["observed"] == pytest.approx(0.1)
    assert c["completeness", "amount"]["severity"] == "PASS"
    assert c["non_negative", "amount"]["n_bad"] == 1 and c["range", "amount"]["n_bad"] == 2 and c["row_count", "rows"]["ok"]
    orphans = dirty_orders.where("user_id >= 25").count()
    assert c["referential", "user_id->user_id2"]["n_bad"] == orphans > 0


def test_schema_check(dirty_orders):
    r = {(x["check"], x["subject"]): x["severity"] for x in V.check_schema(dirty_orders, {"order_id": "bigint", "amount": "string", "city": "string"}).collect()}
    assert r[("schema_missing", "city")] == "BLOCKER" and r[("schema_type", "amount")] == "WARNING" and ("schema_type", "order_id") not in r
    assert r[("schema", "columns")] == "BLOCKER" and r[("schema_extra", "user_id")] == "PASS"


def test_confidence_grades(spark):
    def rows(ds, **sev):
        base = {"completeness": ("PASS", 0.0, 0), "primary_key": ("PASS", 0.0, 0), "aggregation": ("PASS", 0.0, 0), "temporal": ("PASS", 0.0, 0), "range": ("PASS", 0.0, 0), "simpson": ("PASS", 0.0, 0), "row_count": ("PASS", 20000.0, 0)}
        base.update(sev)
        return [(ds, k, *v) for k, v in base.items() if v]
    data = rows("clean") + rows("partial", simpson=None) + rows("bad", completeness=("BLOCKER", 0.4, 9), primary_key=("BLOCKER", 1.0, 1), aggregation=("BLOCKER", 0.2, 1), temporal=("WARNING", 0.0, 9), simpson=("BLOCKER", 1.0, 1))
    df = spark.createDataFrame(data, "dataset string, check string, severity string, observed double, n_bad long")
    scores = V.confidence_score(df)
    g = {r["dataset"]: (r["score"], r["grade"]) for r in scores.collect()}
    assert g["clean"] == (100, "A") and g["partial"] == (100, "C") and g["bad"] == (round((2 + 3 + 3 + 5 + 15 + 2 + 10) * 100 / 100), "D")
    m = V.merge_confidence(scores).first()
    assert m["grade"] == "C" and m["data_completeness"] == 2


def test_tieout_levels(spark):
    a = spark.createDataFrame([(i, 100.0) for i in range(100)], "k int, v double")
    near = a.withColumn("v", F.when(F.col("k") == 0, 100.05).otherwise(100.0))
    far = a.withColumn("v", F.when(F.col("k") == 0, 200.0).otherwise(100.0))
    sev = lambda b: {(r["check"], r["metric"]): r["severity"] for r in V.tieout(a, b).collect()}
    assert set(sev(a).values()) == {"PASS"}
    assert sev(near)[("numeric_sum", "v")] == "PASS" and sev(near)[("distinct_count", "v")] == "BLOCKER"
    assert sev(far)[("numeric_sum", "v")] == "BLOCKER" and sev(far)[("row_count", "rows")] == "PASS"


def test_root_cause_drill_down(spark):
    rows = []
    for i in range(28):
        for dev, cat, ver in itertools.product(("ios", "android"), ("payment", "other"), ("v1", "v2")):
            rows.append((day(i), dev, cat, ver, 10.0 + (300.0 if i >= 14 and (dev, cat, ver) == ("ios", "payment", "v2") else 0.0)))
    df = spark.createDataFrame(rows, "d date, device string, category string, version string, n double")
    b, p = F.col("d") < F.lit(day(14)), F.col("d") >= F.lit(day(14))
    got = [(r["dimension"], r["member"], round(r["share"], 3)) for r in RC.drill_down(df, ["device", "category", "version"], "n", b, p, 14.0, 14.0).orderBy("level").collect()]
    assert got == [("category", "payment", 1.0), ("device", "ios", 1.0), ("version", "v2", 1.0)]
    iso = RC.isolate_check(df, F.expr("device = 'ios' and category = 'payment' and version = 'v2'"), "n", b, p, 14.0, 14.0).first()
    assert not iso["still_anomalous"] and iso["change_all"] > 1


def test_difference_in_differences(spark):
    rows = [(g, i, 100.0 + i + (50 if g == "t" else 0) + (12.0 if g == "t" and i >= 30 else 0)) for g in "tc" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, y double")
    r = E.did(df, F.col("g") == "t", F.col("i") >= 30, "y", F.col("i")).first()
    assert r["did"] == pytest.approx(12.0) and r["trend_gap"] == pytest.approx(0.0, abs=1e-9)
    its = E.interrupted_series(df.where("g = 't'").withColumn("d", F.date_add(F.lit(D0), F.col("i"))), "d", "y", str(day(30))).first()
    assert its["excess"] == pytest.approx(12.0 * 30)


def test_matching_removes_the_confounder(spark):
    rows = [("hi" if i < 80 else "lo", True, 10.0 if i < 80 else 2.0) for i in range(100)] + [("hi" if i < 20 else "lo", False, 9.0 if i < 20 else 1.0) for i in range(100)] + [("rare", True, 99.0)]
    df = spark.createDataFrame(rows, "s string, t boolean, y double")
    r = E.match_outcomes(df, F.col("t"), ["s"], "y").first()
    assert r["effect"] == pytest.approx(1.0) and r["naive_diff"] > 5 and (r["matched_treated"], r["treated"]) == (100, 101)


def test_decision_table(spark):
    df = spark.createDataFrame([("a", 0.1, True, 0.0), ("b", 0.1, True, -0.1), ("c", 0.1, True, -0.2), ("d", 0.1, False, 0.0), ("e", -0.1, True, 0.0), ("f", 0.1, True, -0.02)], "x string, e double, s boolean, g double")
    assert {r["x"]: r["decision"] for r in E.decision_rule(df, "e", "s", "g").collect()} == {"a": "SHIP", "b": "INVESTIGATE", "c": "DON'T SHIP", "d": "DON'T SHIP", "e": "DON'T SHIP", "f": "SHIP"}


def test_panel_counts_shared_users_once(spark):
    e = spark.createDataFrame([(D0, 1, "exp", "a"), (D0, 1, "exp", "b"), (D0, 1, "pay", "b"), (D0, 2, "exp", "a")], "dt date, user_id int, stage string, src string")
    got = {(r["tag"], r["member"]): (r["uv_all"], r["exp_uv"], r["exp_pv"], r["pay_pv"]) for r in P.funnel_panel(e, ["src"]).collect()}
    assert got == {("overall", "overall"): (2, 2, 3, 1), ("src", "a"): (2, 2, 2, 0), ("src", "b"): (1, 1, 1, 1)}


def test_zero_divisors_are_null(spark):
    p = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0, 0)], ", ".join(f"{c} long" for c in P.COUNTS))
    r = P.add_funnel_rates(p).first()
    assert all(r[k] is None for k in (*P.RATES, "pv_per_user"))


def test_right_censoring(spark):
    rows = [(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 3, 5)), (2, dt.date(2024, 2, 5))]
    g = {(r["cohort"].month, r["offset"]): r["retained"] for r in G.right_censor(G.retention_matrix(spark.createDataFrame(rows, "u int, d date"), "u", "d"), "2024-03-31", 3).collect()}
    assert g == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): None, (2, 0): 1, (2, 1): 0, (2, 2): None, (2, 3): None}


def test_funnel_requires_order(spark):
    ts = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, ts(0), "a"), (1, ts(1), "b"), (1, ts(2), "c"), (2, ts(0), "b"), (2, ts(1), "a"), (3, ts(0), "a"), (3, ts(5), "b"), (3, ts(30), "c"), (4, ts(0), "a")]
    t = G.funnel_times(spark.createDataFrame(rows, "u int, ts timestamp, s string"), "u", "ts", F.col("s"), ["a", "b", "c"], 24 * 3600)
    f = {r["step"]: (r["users"], r["median_seconds"]) for r in G.event_funnel(t, ["a", "b", "c"]).collect()}
    assert f == {"a": (4, None), "b": (2, 3 * 3600.0), "c": (1, 3600.0)}


def test_event_quality_finds_plants(spark):
    ts = lambda d, h: dt.datetime(2024, 1, 1 + d, h)
    rows = [(i, 1, "ios", ts(i % 10, 12)) for i in range(20) if i % 10 not in (4, 5)] + [(0, 1, "ios", ts(0, 12)), (100, 2, "web", ts(0, 3))]
    e = spark.createDataFrame(rows, "id int, u int, device string, ts timestamp")
    s = spark.createDataFrame([(1, ts(0, 1), ts(0, 5)), (1, ts(0, 4), ts(0, 6)), (1, ts(0, 7), ts(0, 8))], "u int, session_start timestamp, session_end timestamp")
    q = {r["check"]: r["observed"] for r in X.event_quality(e, s, "id", "u", "device", "ts", (3,)).collect()}
    assert q == {"duplicate_events": 1.0, "missing_device_days": 2.0, "odd_hour_share": pytest.approx(1 / 18), "overlapping_sessions": 1.0}


def test_contradictions_match_all_pairs(spark):
    """Counts from totals equal those of forming every pair."""
    import random

    rnd = random.Random(2)
    fs = [(f"f{i}", rnd.choice(["m1", "M1", "m2", "m3"]), rnd.choice(["up", "down", ""]), rnd.choice([0.1, 0.3]), rnd.choice([0.5, 0.9])) for i in range(60)]
    df = spark.createDataFrame(fs, "finding_id string, metric_name string, direction string, affected_pct double, confidence double")

    def rule(a, b):
        if {a[2], b[2]} != {"up", "down"}:
            return 0
        down = a if a[2] == "down" else b
        return 1 if a[1].lower() == b[1].lower() else 2 if down[3] > 0.2 else 3 if min(a[4], b[4]) >= 0.8 else 0

    got = {r["finding_id"]: (r["same_metric"], r["large_decline"], r["both_confident"]) for r in L.contradictions(df).collect()}
    want = {a[0]: tuple(sum(rule(a, b) == k for b in fs) for k in (1, 2, 3)) for a in fs if a[2]}
    assert got == want and sum(map(sum, want.values())) > 50


def test_lineage_with_a_cycle(spark):
    e = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("d", "b"), ("a", "c"), ("x", "y")], "child string, parent string")
    got = {r["step"]: r["depth"] for r in L.lineage_ancestors(e, spark.createDataFrame([("d",)], "step string")).collect()}
    assert got == {"d": 0, "c": 1, "b": 1, "a": 2}


def test_text_patterns(spark):
    d = spark.createDataFrame([(1, "Here's the thing: I just really JUST mean it — ok. It is “fine” \U0001F600 **b**."), (2, "One two three. Four five six. Seven eight nine. Ten."), (3, "值得注意的是，赋能闭环。未来可期"), (4, "")], "id int, text string")
    from funnelwright.functions.lexicons import PHRASES

    h = {r["id"]: r for r in N.phrase_hits(d, "text", PHRASES, ["id"]).collect()}
    assert (h[1]["openers"], h[1]["adverbs"], h[2]["adverbs"]) == (1, 3, 0)
    m = {r["id"]: r for r in N.punctuation_tells(d, "text", ["id"]).collect()}
    assert (m[1]["dashes"], m[1]["curly_quotes"], m[1]["emoji"], m[1]["bold"]) == (1, 2, 1, 1)
    r = {x["id"]: x for x in N.rhythm(d, "id", "text").collect()}
    assert (r[2]["sentences"], r[2]["equal_runs"], r[4]["sentences"]) == (4, 1, 0)
    z = {x["id"]: x for x in N.phrase_hits(d, "text", PHRASES_ZH, ["id"], words=False).collect()}
    assert (z[3]["openers"], z[3]["jargon"], z[3]["endings"]) == (1, 2, 1)


def test_snapshot_and_profile(spark):
    a = spark.createDataFrame([(1, "x", "2024-01-01"), (2, None, "2024-01-03")], "k int, s string, d string")
    p = {r["column_name"]: r for r in B.profile_columns(a).collect()}
    assert (p["s"]["n_null"], p["s"]["n_unique"], p["k"]["sample_values"]) == (1, 1, ["1", "2"])
    assert [r["column_name"] for r in B.date_columns(a).collect()] == ["d"]
    c = {(r["change"], r["column_name"]): r["breaking"] for r in B.compare_snapshots(B.snapshot({"t": a}), B.snapshot({"t": a.drop("s")})).collect()}
    assert c == {("column_removed", "s"): True}


def test_metric_expressions_refuse_code():
    with pytest.raises(ValueError):
        S.metric_expr("aov * rand()", ["aov"])
    with pytest.raises(ValueError):
        S.metric_expr("aov; 1", ["aov"])
