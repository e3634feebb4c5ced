"""Retention, payment, cohorts, segmentation, sessions."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import bucketise, month_key, r, ratio
from funnelwright.operators import growth as G
from funnelwright.operators import relations as R
from funnelwright.operators import sessions as X
from funnelwright.plans.registry import query
from funnelwright.sources.tables import BEHAVIOUR_SQL

def money(t):
    """Orders with exact prices: sums do not depend on the order of addition."""
    return t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))


CURVE_SQL = """ue as (select distinct user_id, 'G'||(user_id % 4) as source, cast(ts as date) as dt from events), uk as (select *, datediff('day', min(dt) over (partition by user_id), dt) as k from ue),
  cv as (select source, k, count(*) as active from uk group by 1,2), curve as (select source, k as "offset", active, max(case when k=0 then active end) over (partition by source) as cohort, active/max(case when k=0 then active end) over (partition by source)::double as rate from cv)"""


def curve(t):
    e = t.events.select("user_id", F.concat(F.lit("G"), F.col("user_id") % 4).alias("source"), F.to_date("ts").alias("dt"))
    return G.retention_curve(e, "user_id", "dt", "source")


@query("c01_retention_curve", f"with {CURVE_SQL} select source, cast(\"offset\" as integer) as \"offset\", active, cohort, round(rate,6) as rate from curve")
def _(t):
    return curve(t).select("source", "offset", "active", "cohort", r("rate").alias("rate"))


@query("c02_retention_milestones", f"""with {CURVE_SQL}, s as (select *, abs(rate/lag(rate) over (partition by source order by "offset") - 1) as chg from curve)
  select source, {", ".join(f'round(max(case when "offset"={m} then rate end),6) as d{m}' for m in (1, 3, 7, 14, 28))},
  round((max(case when "offset"=1 then rate end)-max(case when "offset"=7 then rate end))/max(case when "offset"=1 then rate end),6)+0.0 as decay,
  round(max(case when "offset"=28 then rate end)/max(case when "offset"=7 then rate end),6) as stickiness, cast(min(case when chg < 0.03 and "offset" >= 2 then "offset" end) as integer) as stable_day from s group by 1""")
def _(t):
    marks = (1, 3, 7, 14, 28)
    return G.retention_milestones(curve(t), "source", marks).select("source", *[r(f"d{m}").alias(f"d{m}") for m in marks], r("decay").alias("decay"), r("stickiness").alias("stickiness"), "stable_day")


@query("c03_retention_gap", f"""with {CURVE_SQL} select cast(a."offset" as integer) as "offset", round(a.rate,6) as rate_a, round(b.rate,6) as rate_b, round(a.rate-b.rate,6)+0.0 as gap from curve a join curve b on a."offset"=b."offset" and b.source='G2' where a.source='G1' and a."offset" in (1,3,7,14)""")
def _(t):
    return G.retention_gap(curve(t), "source", "G1", "G2", (1, 3, 7, 14)).select("offset", *[r(c).alias(c) for c in ("rate_a", "rate_b", "gap")])


PAY_SQL = """od as (select o_custkey as u, o_orderstatus as s0, cast(o_orderdate as date) as dt, count(*) as n from orders group by 1,2,3),
  ox as (select c_mktsegment as source, u, dt, sum(n) as n from od join customer on c_custkey=u group by 1,2,3), ok as (select *, datediff('day', min(dt) over (partition by u), dt) as k from ox),
  pr as (select source, k as "offset", sum(n)::bigint as orders, max(case when k=0 then count(*) end) over (partition by source) as cohort from ok group by 1,2), rates as (select *, orders/cohort::double as rate from pr)"""


def pay_rates(t):
    o = t.orders.join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("source")), F.col("o_custkey") == F.col("c_custkey"))
    return G.pay_rate_by_offset(o.withColumn("n1", F.lit(1)), "o_custkey", "o_orderdate", "n1", "source")


@query("c04_pay_rate_by_offset", f"with {PAY_SQL} select source, cast(\"offset\" as integer) as \"offset\", orders, cohort, round(rate,6) as rate from rates")
def _(t):
    return pay_rates(t).select("source", "offset", "orders", "cohort", r("rate").alias("rate"))


@query("c05_cumulative_conversion", f"""with {PAY_SQL}, c as (select *, sum(orders) over (partition by source order by "offset")/sum(orders) over (partition by source)::double as sh from rates)
  select source, round(max(case when "offset"=0 then rate end),6) as d0, {", ".join(f'round(sum(case when "offset"<={h} then rate end),6) as d0_{h}' for h in (7, 30, 90, 180))}, round(max(case when "offset"=7 then rate end)/max(case when "offset"=0 then rate end),6) as d7_over_d0,
  round(sum(orders)/max(cohort)::double,6) as orders_per_user, cast(min(case when sh>=0.5 then "offset" end) as integer) as day_50, cast(min(case when sh>=0.8 then "offset" end) as integer) as day_80 from c group by 1""")
def _(t):
    cols = ("d0", "d0_7", "d0_30", "d0_90", "d0_180", "d7_over_d0", "orders_per_user")
    return G.cumulative_conversion(pay_rates(t), "source").select("source", *[r(c).alias(c) for c in cols], "day_50", "day_80")


@query("c05_smoothed_repeat_curve", f"with {PAY_SQL} select source, cast(\"offset\" as integer) as \"offset\", round(avg(rate) over (partition by source order by \"offset\" rows between 6 preceding and current row),6) as smoothed from rates where \"offset\" > 0")
def _(t):
    return G.smoothed_curve(pay_rates(t), "source", 7, skip_first=True).select("source", "offset", r("smoothed").alias("smoothed"))


@query("c06_order_contribution", f"""with {PAY_SQL}, p as (select source, case when "offset"<1 then 'D0' when "offset"<8 then 'D1-7' when "offset"<31 then 'D8-30' when "offset"<91 then 'D31-90' when "offset"<181 then 'D91-180' else 'D181+' end as period, sum(orders)::bigint as orders from rates group by 1,2)
  select source, period, orders, round(orders/sum(orders) over (partition by source)::double,6) as share from p""")
def _(t):
    return G.order_contribution(pay_rates(t), "source").select("source", "period", "orders", r("share").alias("share"))


DETAIL_SQL = """d0 as (select distinct user_id, cast(ts as date) as dt from events), ds as (select 'G'||(user_id%4) as source, dt, count(*) as users from d0 group by 1,2),
  dp as (select 'G'||(user_id%4) as source, cast(ts as date) as pdt, count(*) as n from events where event_type='purchase' group by 1,2),
  det as (select a.source, a.dt, a.users, datediff('day', a.dt, b.pdt) as "offset", b.n as orders from ds a join dp b on a.source=b.source and b.pdt between a.dt and a.dt + 13)"""


def pay_detail(t):
    e = t.events.select("user_id", F.concat(F.lit("G"), F.col("user_id") % 4).alias("source"), F.to_date("ts").alias("dt"), "event_type")
    users = e.groupBy("source", "dt", "user_id").agg(F.lit(1).alias("one")).groupBy("source", "dt").agg(F.count("one").alias("users"))
    # Spread each payment day over the 14 start days it can belong to: an equi-join instead of a range join.
    paid = e.where("event_type = 'purchase'").groupBy("source", F.col("dt").alias("pdt")).agg(F.count("*").alias("orders"))
    paid = paid.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(13)))).withColumn("dt", F.date_sub("pdt", F.col("offset")))
    return users.join(paid, ["source", "dt"])


@query("c07_weekday_vs_cycle", f"""with {DETAIL_SQL}, x as (select source, 'weekday' as view, cast(isodow(dt + cast("offset" as integer))-1 as integer) as slot, orders/users::double as rate from det union all select source, 'mod7', cast("offset" % 7 as integer), orders/users::double from det), g as (select source, view, slot, avg(rate) as rate from x group by 1,2,3)
  select source, view, slot, round(rate,6) as rate, round(max(rate) over w/min(rate) over w,6) as peak_trough from g window w as (partition by source, view)""")
def _(t):
    return G.weekday_vs_cycle(pay_detail(t), "source", "dt", "offset", "users", "orders").select("source", "view", "slot", r("rate").alias("rate"), r("peak_trough").alias("peak_trough"))


PAID = "ord_7 > 0"
METRICS = ("sx_all", "xd_all", "sc_all", "jg_all")


@query("c08_payer_contrast", "with " + BEHAVIOUR_SQL + ", l as (" + " union all ".join(f"select '{m}' as metric, {m}::double as v, ord_7 > 0 as p from beh" for m in METRICS) + """)
  select metric, round(avg(case when p then v end),6) as mean_paid, round(avg(case when not p then v end),6) as mean_other, round(avg(case when p then (v>0)::int end),6) as nonzero_paid, round(avg(case when not p then (v>0)::int end),6) as nonzero_other, round(avg(case when p then v end)/avg(case when not p then v end),6) as ratio from l group by 1""")
def _(t):
    d = G.payer_contrast(t.behaviour, F.col("ord_7") > 0, METRICS)
    return d.select("metric", *[r(c).alias(c) for c in ("mean_paid", "mean_other", "nonzero_paid", "nonzero_other", "ratio")])


DEPTH_SQL = """dg as (select coalesce(source,'overall') as member, bucket, pos, count(*) as users, count(case when ord_7>0 then 1 end) as paid from (select source, ord_7, case when sx_all<1 then '0' when sx_all<2 then '1' when sx_all<4 then '2-3' when sx_all<8 then '4-7' when sx_all<16 then '8-15' when sx_all<31 then '16-30' else '30+' end as bucket,
  case when sx_all<1 then 0 when sx_all<2 then 1 when sx_all<4 then 2 when sx_all<8 then 3 when sx_all<16 then 4 when sx_all<31 then 5 else 6 end as pos from beh) group by grouping sets ((source,bucket,pos),(bucket,pos)))"""


def depth(t):
    return G.depth_gradient(t.behaviour, "sx_all", F.col("ord_7") > 0, "source")


@query("c09_depth_gradient", f"with {BEHAVIOUR_SQL}, {DEPTH_SQL} select member, bucket, users, paid, round(paid/users::double,6) as rate from dg")
def _(t):
    return depth(t).select("member", "bucket", "users", "paid", r("rate").alias("rate"))


@query("c10_aha_threshold", f"with {BEHAVIOUR_SQL}, {DEPTH_SQL} select member, arg_min(bucket,pos) as bucket, round(arg_min(paid/users::double,pos),6) as rate from dg where paid/users::double > 0.6 group by 1")
def _(t):
    return G.aha_threshold(depth(t), 0.6).select("member", "bucket", r("rate").alias("rate"))


@query("c11_multi_signal", f"""with {BEHAVIOUR_SQL}, s as (select cast((sc_all>0)::int + (jg_all>0)::int + (xd_all>0)::int as integer) as signals, count(*) as users, count(case when ord_7>0 then 1 end) as paid from beh group by 1)
  select signals, users, paid, round(paid/sum(paid) over ()::double,6) as share_paid, round((users-paid)/sum(users-paid) over ()::double,6) as share_other, round(paid/users::double,6) as rate from s""")
def _(t):
    return G.multi_signal(t.behaviour, ["sc_all", "jg_all", "xd_all"], F.col("ord_7") > 0).select("signals", "users", "paid", *[r(c).alias(c) for c in ("share_paid", "share_other", "rate")])


@query("c12_condition_ladder", f"""with {BEHAVIOUR_SQL} select c as condition, count(case when ok then 1 end) as users, count(case when ok and ord_7>0 then 1 end) as paid, round(count(case when ok and ord_7>0 then 1 end)/nullif(count(case when ok then 1 end),0)::double,6) as rate from
  (select 'all' as c, true as ok, ord_7 from beh union all select 'view', sx_all>=1, ord_7 from beh union all select 'view+click', sx_all>=1 and xd_all>=1, ord_7 from beh union all select 'view2+click2', sx_all>=2 and xd_all>=2, ord_7 from beh) group by 1""")
def _(t):
    c = {"all": F.lit(True), "view": F.col("sx_all") >= 1, "view+click": F.expr("sx_all >= 1 and xd_all >= 1"), "view2+click2": F.expr("sx_all >= 2 and xd_all >= 2")}
    return G.condition_ladder(t.behaviour, c, F.col("ord_7") > 0).select("condition", "users", "paid", r("rate").alias("rate"))


@query("c13_repeat_intensity", f"with {BEHAVIOUR_SQL} select source, count(case when ord_7=1 then 1 end) as one, count(case when ord_7>=2 then 1 end) as two_plus, round(count(case when ord_7>=2 then 1 end)/count(case when ord_7>=1 then 1 end)::double,6) as share_two_plus from beh group by 1")
def _(t):
    return G.repeat_intensity(t.behaviour, "ord_7", "source").select("source", "one", "two_plus", r("share_two_plus").alias("share_two_plus"))


THRESH_SQL = "th as (" + " union all ".join(
    f"select {c}::int as cut, count(case when {'sx_all=0' if c == 0 else f'sx_all>={c}'} then 1 end) as users, count(case when {'sx_all=0' if c == 0 else f'sx_all>={c}'} and ord_7>0 then 1 end) as paid, count(*) as n from beh" for c in (0, 1, 2, 4)) + ")"


def thresholds(t):
    return G.threshold_curve(t.behaviour, "sx_all", F.col("ord_7") > 0, [0, 1, 2, 4], 1.115)


@query("c14_threshold_curve", f"with {BEHAVIOUR_SQL}, {THRESH_SQL} select cut, users, round(users/n::double*100,6) as pct, round(users*1.115::double,4) as scaled, round(paid/nullif(users,0)::double*100,6) as rate from th")
def _(t):
    return thresholds(t).select("cut", "users", r("pct").alias("pct"), r("scaled", 4).alias("scaled"), r("rate").alias("rate"))


LINES = {"all": "ord_7", "hi": "ord_hi_7", "lo": "ord_lo_7"}
_PAYGAP = "case when pay_gap<=7 then '0-7' when pay_gap<=14 then '8-14' when pay_gap<=365 then '15+' else 'never' end"


def pay_gap_group():
    return bucketise("pay_gap", [7, 14, 365], ["0-7", "8-14", "15+", "never"], right_closed=True)


@query("c15_stratified_rates", f"with {BEHAVIOUR_SQL}, g as (select {_PAYGAP} as stratum, count(*) as users, count(case when ord_7>0 then 1 end) as p_all, count(case when ord_hi_7>0 then 1 end) as p_hi, count(case when ord_lo_7>0 then 1 end) as p_lo from beh group by 1), h as (select *, users/sum(users) over ()::double*100 as pct from g) "
  + " union all ".join(f"select stratum, '{k}' as line, users, round(pct,6) as pct, round(users*1.115::double,4) as scaled, p_{k} as paid, round(p_{k}/users::double*100,6) as rate from h" for k in LINES))
def _(t):
    d = G.stratified_rates(t.behaviour, pay_gap_group(), "stratum", LINES, 1.115)
    return d.select("stratum", "line", "users", r("pct").alias("pct"), r("scaled", 4).alias("scaled"), "paid", r("rate").alias("rate"))


@query("c16_rate_heatmap", f"""with {BEHAVIOUR_SQL}, x as (select {_PAYGAP} as stratum, case when ord_t=0 then 'f0' when ord_t<=2 then 'f1' else 'f3' end as f, (ord_7>0)::int*100.0 as p from beh)
  select stratum, round(avg(case when f='f0' then p end),6) as f0, round(avg(case when f='f1' then p end),6) as f1, round(avg(case when f='f3' then p end),6) as f3 from x group by 1""")
def _(t):
    freq = bucketise("ord_t", [0, 2], ["f0", "f1", "f3"], right_closed=True)
    return G.rate_heatmap(t.behaviour, pay_gap_group(), freq, ("stratum", "f"), ["f0", "f1", "f3"], F.col("ord_7") > 0).select("stratum", *[r(c).alias(c) for c in ("f0", "f1", "f3")])


@query("c17_penetration", "with " + BEHAVIOUR_SQL + " " + " union all ".join(f"select '{c}' as metric, round(avg(({c}>0)::int)*100,6) as pct, round(avg({c}),6) as mean_all, round(avg(case when {c}>0 then {c} end),6) as mean_active from beh" for c in ("sx_all", "sx_hi", "sx_lo", "xd_all")))
def _(t):
    return G.penetration(t.behaviour, ["sx_all", "sx_hi", "sx_lo", "xd_all"]).select("metric", *[r(c).alias(c) for c in ("pct", "mean_all", "mean_active")])


CLAIMS = [("conversion", 75.0), ("user_days", 4500.0), ("paid_and_unpaid", 100.0), ("unknown_measure", 1.0)]


@query("c18_report_recheck", f"""with {BEHAVIOUR_SQL}, a as (select 'conversion' as claim, count(case when ord_7>0 then 1 end)*100.0/count(*) as actual from beh union all select 'user_days', count(*) from beh union all select 'paid_and_unpaid', count(case when ord_7>0 then 1 end)*100.0/count(*) + count(case when ord_7=0 then 1 end)*100.0/count(*) from beh),
  c as (select * from (values {", ".join(f"('{n}', {v}::double)" for n, v in CLAIMS)}) v(claim, reported))
  select claim, round(actual::double,6) as actual, coalesce(abs(actual-reported) < 0.01, false) as ok from c left join a using (claim)""")
def _(t):
    share = lambda cond: F.count(F.when(cond, 1)) * 100.0 / F.count("*")
    paid, unpaid = F.col("ord_7") > 0, F.col("ord_7") == 0
    measures = {"conversion": share(paid), "user_days": F.count("*"), "paid_and_unpaid": share(paid) + share(unpaid)}
    claims = t.spark.createDataFrame(CLAIMS, "claim string, reported double")
    return G.report_recheck(t.behaviour, measures, claims).select("claim", r("actual").alias("actual"), "ok")


@query("c19_threshold_consistency", f"""with {BEHAVIOUR_SQL}, {THRESH_SQL}, o as (select cut, paid/users::double as rt, users, lag(paid/users::double) over (order by cut) as r0, lag(users) over (order by cut) as u0 from th where cut>0)
  select count(case when rt<r0 then 1 end) as rate_drops, count(case when users>u0 then 1 end) as size_rises, (select round(sum(users/n::double*100),6) from th where cut in (0,1)) as base_pct from o""")
def _(t):
    return G.threshold_consistency(thresholds(t)).select("rate_drops", "size_rises", r("base_pct").alias("base_pct"))


# --- cohorts: customers by month of first order ---------------------------------------

COHORT_SQL = """om as (select distinct o_custkey as u, date_trunc('month', o_orderdate)::date as m from orders), oc as (select *, min(m) over (partition by u) as cohort from om),
  mx as (select cohort, cast((year(m)-year(cohort))*12+month(m)-month(cohort) as integer) as "offset", count(*) as retained from oc group by 1,2), matrix as (select *, max(case when "offset"=0 then retained end) over (partition by cohort) as users from mx),
  spine as (select cohort, max(users) as users, unnest(range(0,13))::int as "offset" from matrix group by 1),
  grid as (select s.cohort, s."offset", s.users, case when s.cohort + to_months(s."offset") <= date '2001-08-01' then coalesce(m.retained,0) end as retained from spine s left join matrix m on s.cohort=m.cohort and s."offset"=m."offset"),
  g2 as (select *, retained/users::double*100 as pct from grid)"""


def grid(t):
    return G.right_censor(G.retention_matrix(t.orders, "o_custkey", "o_orderdate"), "2001-08-01", 12)


@query("c20_cohort_assign", "with f as (select o_custkey, date_trunc('month', min(o_orderdate))::date as cohort from orders group by 1) select cohort, count(*) as users, count(*) < 50 as too_small from f group by 1")
def _(t):
    return G.cohort_sizes(G.cohort_assign(t.orders, "o_custkey", "o_orderdate"))


@query("c21_retention_matrix", f"with {COHORT_SQL} select cohort, \"offset\", retained, users, round(retained/users::double*100,6) as pct from matrix")
def _(t):
    return G.retention_matrix(t.orders, "o_custkey", "o_orderdate").select("cohort", "offset", "retained", "users", r("pct").alias("pct"))


@query("c22_right_censor", f"with {COHORT_SQL} select cohort, \"offset\", users, retained, round(pct,6) as pct from g2")
def _(t):
    return grid(t).select("cohort", "offset", "users", "retained", r("pct").alias("pct"))


@query("c23_mean_curve", f"with {COHORT_SQL} select \"offset\", count(*) as n, round(avg(pct),6) as mean, round(stddev_samp(pct),6) as sd, round(stddev_samp(pct)/sqrt(count(*)),6) as se from g2 where pct is not null group by 1")
def _(t):
    return G.mean_curve(grid(t)).select("offset", "n", *[r(c).alias(c) for c in ("mean", "sd", "se")])


@query("c23_mean_curve_ci")
def _(t):
    from funnelwright.functions import dist

    return dist.with_t_interval(G.mean_curve(grid(t)), "mean", "se", "n", 0.95)


@query("c24_cohort_outliers", f"with {COHORT_SQL}, z as (select cohort, \"offset\", pct, case when stddev_samp(pct) over w > 0 then (pct-avg(pct) over w)/stddev_samp(pct) over w end as z from g2 where pct is not null window w as (partition by \"offset\")) select cohort, \"offset\", round(pct,6) as pct, round(z,6)+0.0 as z from z where abs(z) > 2")
def _(t):
    return G.cohort_outliers(grid(t)).select("cohort", "offset", r("pct").alias("pct"), r("z").alias("z"))


@query("c25_cohort_slope", f"with {COHORT_SQL} select \"offset\", round(regr_slope(pct, year(cohort)*12+month(cohort)-1),6)+0.0 as slope, count(*) as n from g2 where \"offset\" in (1,3,6) and pct is not null group by 1")
def _(t):
    return G.cohort_slope(grid(t), [1, 3, 6]).select("offset", r("slope").alias("slope"), "n")


LTV_SQL = """lm as (select o_custkey as u, date_trunc('month', o_orderdate)::date as m, sum(o_totalprice::decimal(18,2)) as v from orders group by 1,2), lc as (select *, min(m) over (partition by u) as cohort from lm),
  lo as (select cohort, cast((year(m)-year(cohort))*12+month(m)-month(cohort) as integer) as "offset", sum(v) as v, count(*) as n from lc group by 1,2),
  ltv as (select cohort, "offset", max(case when "offset"=0 then n end) over (partition by cohort) as users, (sum(v) over (partition by cohort order by "offset"))::double as cum, (sum(v) over (partition by cohort))::double as tot from lo)"""


@query("c26_cohort_ltv", f"with {LTV_SQL} select cohort, \"offset\", users, round(cum,2) as cum_revenue, round(cum/users,6) as ltv, round(cum/tot,6) as share_of_final from ltv")
def _(t):
    return G.cohort_ltv(money(t), "o_custkey", "o_orderdate", "o_totalprice").select("cohort", "offset", "users", r("cum_revenue", 2).alias("cum_revenue"), r("ltv").alias("ltv"), r("share_of_final").alias("share_of_final"))


@query("c26_ltv_maturity", f"with {LTV_SQL}, m as (select cohort, max(users) as users, arg_max(cum/users,\"offset\") as final_ltv, min(case when cum/tot>=0.8 then \"offset\" end) as mature_at from ltv group by 1) select cohort, users, round(final_ltv,6) as final_ltv, mature_at, cast(row_number() over (order by final_ltv desc, cohort) as integer) as rank from m")
def _(t):
    d = G.ltv_maturity(G.cohort_ltv(money(t), "o_custkey", "o_orderdate", "o_totalprice"))
    return d.select("cohort", "users", r("final_ltv").alias("final_ltv"), "mature_at", "rank")


@query("c27_mature_benchmark", f"""with {COHORT_SQL}, o3 as (select cohort from g2 group by 1 having count(case when pct is null then 1 end)=0 order by cohort limit 3), b as (select "offset", avg(pct) as bm from g2 where cohort in (select cohort from o3) group by 1)
  select g.cohort, g."offset", round(g.pct,6) as pct, round(b.bm,6) as benchmark, round(g.pct-b.bm,6)+0.0 as deviation, abs(g.pct-b.bm)>5 as flag from g2 g join b using ("offset") where g.pct is not null and g.cohort not in (select cohort from o3)""")
def _(t):
    return G.mature_benchmark(grid(t)).select("cohort", "offset", r("pct").alias("pct"), r("benchmark").alias("benchmark"), r("deviation").alias("deviation"), "flag")


STEPS = ["view", "click", "signup", "purchase"]


@query("c28_event_funnel", """with s1 as (select user_id, min(ts) as t1 from events where event_type='view' group by 1),
  s2 as (select user_id, t1, (select min(ts) from events e where e.user_id=s1.user_id and event_type='click' and ts>=t1 and epoch_us(ts)-epoch_us(t1)<=864000000000) as t2 from s1),
  s3 as (select *, (select min(ts) from events e where e.user_id=s2.user_id and event_type='signup' and ts>=t2 and epoch_us(ts)-epoch_us(t1)<=864000000000) as t3 from s2),
  s4 as (select *, (select min(ts) from events e where e.user_id=s3.user_id and event_type='purchase' and ts>=t3 and epoch_us(ts)-epoch_us(t1)<=864000000000) as t4 from s3),
  c as (select 1 as step_no, 'view' as step, count(t1) as users, null::double as med from s4 union all select 2, 'click', count(t2), median((epoch_us(t2)-epoch_us(t1))/1e6) from s4 union all select 3, 'signup', count(t3), median((epoch_us(t3)-epoch_us(t2))/1e6) from s4 union all select 4, 'purchase', count(t4), median((epoch_us(t4)-epoch_us(t3))/1e6) from s4),
  l as (select *, lag(users) over (order by step_no) as prev, first(users) over (order by step_no) as f from c)
  select step_no, step, users, round(users/prev::double,6) as step_rate, round(users/f::double,6) as overall_rate, prev-users as lost, coalesce(prev-users = max(prev-users) over (), false) as largest_loss, coalesce(users/prev::double = min(users/prev::double) over (), false) as lowest_rate, round(med,4) as median_seconds from l""")
def _(t):
    times = G.funnel_times(t.events, "user_id", "ts", F.col("event_type"), STEPS, 10 * 86400)
    f = G.event_funnel(times, STEPS)
    return f.select("step_no", "step", "users", r("step_rate").alias("step_rate"), r("overall_rate").alias("overall_rate"), "lost", "largest_loss", "lowest_rate", r("median_seconds", 4).alias("median_seconds"))


def _score_sql(x: str, labels) -> str:
    e = [f"(select quantile_cont({x}, {p}) from c)" for p in (0.2, 0.4, 0.6, 0.8)]
    return "case " + " ".join(f"when {x} <= {q} then {lab}" for q, lab in zip(e, labels)) + f" else {labels[-1]} end"


RFM_SQL = f"""c as (select o_custkey as customer, datediff('day', max(o_orderdate)::date, (select (max(o_orderdate) + interval 1 day)::date from orders)) as recency, count(*) as frequency, sum(o_totalprice) as monetary from orders group by 1),
  s as (select *, {_score_sql('recency', [5, 4, 3, 2, 1])} as "R", {_score_sql('frequency', [1, 2, 3, 4, 5])} as "F", {_score_sql('monetary', [1, 2, 3, 4, 5])} as "M" from c),
  seg as (select *, case when "R">=4 and "F">=4 and "M">=4 then 'Champions' when "F">=3 and "M">=3 then 'Loyal' when "R"<=2 and "F">=3 then 'At Risk' when "R"<=2 and "F"<=2 and "M"<=2 then 'Lost' else 'Other' end as segment from s)"""


@query("c29_rfm", f'with {RFM_SQL} select customer, recency::int as recency, frequency, round(monetary,2) as monetary, "R"::int as "R", "F"::int as "F", "M"::int as "M", "R"::varchar || "F"::varchar || "M"::varchar as score, segment from seg')
def _(t):
    return G.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice").withColumn("monetary", r("monetary", 2))


@query("c29_rfm_summary", f"with {RFM_SQL} select segment, count(*) as customers, round(avg(monetary),6) as avg_monetary, round(avg(frequency),6) as avg_frequency, round(count(*)*100.0/sum(count(*)) over (),6) as pct from seg group by 1")
def _(t):
    s = G.rfm_summary(G.rfm(t.orders, "o_custkey", "o_orderdate", "o_totalprice"))
    return s.select("segment", "customers", r("avg_monetary").alias("avg_monetary"), r("avg_frequency").alias("avg_frequency"), r("pct").alias("pct"))


CONC_SQL = """e as (select o_custkey as k, sum(o_totalprice) as v from orders group by 1), x as (select *, row_number() over (order by v, k) as i, count(*) over () as n, sum(v) over () as tot, sum(v) over (order by v desc, k desc) as from_top from e)"""


@query("c30_concentration", f"""with {CONC_SQL} select max(n) as n, round(2.0*sum(i*v)/(max(n)*max(tot)) - (max(n)+1)/max(n)::double,6) as gini, round(sum(case when i > n - greatest(1,ceil(n*0.1)) then v end)/max(tot),6) as top_10_share, round(sum(case when i > n - greatest(1,ceil(n*0.2)) then v end)/max(tot),6) as top_20_share,
  round(sum(case when i > n - greatest(1,ceil(n*0.5)) then v end)/max(tot),6) as top_50_share, round(min(case when from_top >= 0.8*tot then n-i+1 end)*100.0/max(n),6) as pareto_ratio from x""")
def _(t):
    c = G.concentration(t.orders, "o_totalprice", "o_custkey")
    return c.select("n", *[r(x).alias(x) for x in ("gini", "top_10_share", "top_20_share", "top_50_share", "pareto_ratio")])


@query("c30_lorenz_points", f"with {CONC_SQL}, y as (select i, n, tot, sum(v) over (order by i) as cum from x), p as (select cast(ceil(i*10.0/n) as integer) as point, max(i) as i, max(n) as n, max(tot) as tot, arg_max(cum, i) as cum from y group by 1) select point, round(i/n::double,6) as x, round(cum/tot,6) as y from p")
def _(t):
    return G.lorenz_points(t.orders, "o_totalprice", "o_custkey").select("point", r("x").alias("x"), r("y").alias("y"))


@query("c31_nps", "select year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, o_orderstatus as segment, count(*) as n, round((count(case when o_orderkey%11>=9 then 1 end)-count(case when o_orderkey%11<=6 then 1 end))/count(*)::double*100,6)+0.0 as nps from orders group by 1,2,3")
def _(t):
    o = t.orders.select(F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.col("o_orderstatus").alias("segment"), (F.col("o_orderkey") % 11).alias("score"))
    return G.nps(o, ["y", "q", "segment"], "score").select("y", "q", "segment", "n", r("nps").alias("nps"))


@query("c32_activation_rate", """with u as (select user_id, min(ts) as t0, 'C'||(user_id%3) as channel from events where event_type='signup' group by 1,3), f as (select u.user_id, min(ts) as t1 from u join events e on e.user_id=u.user_id and event_type='purchase' and ts>=t0 group by 1)
  select channel, date_trunc('week', t0)::date as wk, count(*) as users, count(case when epoch_us(t1)-epoch_us(t0) <= 2*86400*1000000::bigint then 1 end) as activated, round(count(case when epoch_us(t1)-epoch_us(t0) <= 2*86400*1000000::bigint then 1 end)/count(*)::double,6) as rate from u left join f using (user_id) group by 1,2""")
def _(t):
    u = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0")).withColumns({"channel": F.concat(F.lit("C"), F.col("user_id") % 3), "wk": F.trunc("t0", "week")})
    return G.activation_rate(u, t.events.where("event_type = 'purchase'").select("user_id", "ts"), "user_id", "t0", "ts", 2, ["channel", "wk"]).withColumn("rate", r("rate"))


@query("c33_spike_ratio", """with x as (select count(case when cast(ts as date) between date '2024-01-08' and date '2024-01-14' then 1 end) as n_in, count(case when cast(ts as date) not between date '2024-01-08' and date '2024-01-14' then 1 end) as n_out from events where event_type='error')
  select n_in, n_out, round(n_in/7.0::double,6) as daily_in, round(n_out/23.0::double,6) as daily_out, round(n_in/7.0::double/greatest(1.0,n_out/23.0::double),6) as ratio from x""")
def _(t):
    d = G.spike_ratio(t.events.withColumn("dt", F.to_date("ts")), "dt", "2024-01-08", "2024-01-14", 30, F.col("event_type") == "error")
    return d.select("n_in", "n_out", *[r(c).alias(c) for c in ("daily_in", "daily_out", "ratio")])


@query("c34_conversion_gap", """with g as (select case when user_id%3<2 then 'mobile' else 'web' end as p, count(case when event_type='purchase' then 1 end)/count(case when event_type='signup' then 1 end)::double as rt from events group by 1)
  select round(max(case when p='mobile' then rt end),6) as rate_a, round(max(case when p='web' then rt end),6) as rate_b, round((max(case when p='web' then rt end)-max(case when p='mobile' then rt end))*100,6)+0.0 as gap_pp from g""")
def _(t):
    platform = F.when(F.col("user_id") % 3 < 2, "mobile").otherwise("web")
    g = G.conversion_gap(t.events, platform, F.col("event_type") == "signup", F.col("event_type") == "purchase", "mobile", "web")
    return g.select(*[r(c).alias(c) for c in ("rate_a", "rate_b", "gap_pp")])


@query("c35_active_users", "select date_trunc('month', o_orderdate)::date as period, count(distinct o_custkey) as active_users from orders group by 1")
def _(t):
    return G.active_users(t.orders, "o_custkey", "o_orderdate", "month")


@query("c36_revenue_tree", "select date_trunc('month', o_orderdate)::date as month, count(distinct o_custkey) as buyers, count(*) as orders, round(sum(o_totalprice::decimal(18,2))::double,2) as revenue, round(count(*)/count(distinct o_custkey)::double,6) as orders_per_buyer, round(sum(o_totalprice::decimal(18,2))::double/count(*),6) as order_value from orders group by 1")
def _(t):
    d = G.revenue_tree(money(t), "o_custkey", "o_orderdate", "o_totalprice")
    return d.select("month", "buyers", "orders", r("revenue", 2).alias("revenue"), r("orders_per_buyer").alias("orders_per_buyer"), r("order_value").alias("order_value"))


@query("c37_state_funnel", """with x as (select user_id, min(case when event_type='signup' and value<120 then ts end) as a, max(case when event_type='purchase' and value<120 then ts end) as b from events group by 1)
  select count(*) as users, count(a) as trial, count(case when b>=a then 1 end) as paid, round(count(a)/count(*)::double,6) as trial_rate, round(count(case when b>=a then 1 end)/count(a)::double,6) as paid_rate from x""")
def _(t):
    s = t.events.withColumn("state", F.when(F.col("value") < 120, F.col("event_type")).otherwise("idle"))
    return G.state_funnel(s, "user_id", "ts", "state", "signup", "purchase").select("users", "trial", "paid", r("trial_rate").alias("trial_rate"), r("paid_rate").alias("paid_rate"))


@query("c37_state_transitions", "with l as (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as prev_state from events) select prev_state, event_type, count(*) as n from l where prev_state is not null group by 1,2")
def _(t):
    return G.state_transitions(t.events, "user_id", ["ts", "event_id"], "event_type")


@query("c38_churn_rate", """with s as (select c_mktsegment as plan, o_custkey, date_trunc('month', min(o_orderdate))::date as st, case when max(o_orderdate) < date '2001-01-01' then date_trunc('month', max(o_orderdate))::date end as en from orders join customer on o_custkey=c_custkey group by 1,2),
  mm as (select plan, min(m) as lo, max(m) as hi from (select plan, st as m from s union all select plan, en from s where en is not null) group by 1),
  m as (select plan, unnest(generate_series(lo, hi, interval 1 month))::date as m from mm)
  select m.plan, m.m as month, (select count(*) from s where s.plan=m.plan and en=m.m) as ended, (select count(*) from s where s.plan=m.plan and st<m.m and (en is null or en>=m.m)) as active_at_start,
  round((select count(*) from s where s.plan=m.plan and en=m.m)/nullif((select count(*) from s where s.plan=m.plan and st<m.m and (en is null or en>=m.m)),0)::double,6) as churn from m""")
def _(t):
    spans = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("plan"), "o_custkey").agg(F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("_last"))
    spans = spans.withColumn("ended_at", F.when(F.col("_last") < F.lit("2001-01-01").cast("date"), F.col("_last")))
    return G.churn_rate(spans, "plan", "started_at", "ended_at").select("plan", "month", "ended", "active_at_start", r("churn").alias("churn"))


@query("c39_revenue_by_category", "select p_type, date_trunc('month', l_shipdate)::date as month, round(sum(l_extendedprice),2) as revenue from lineitem join part on l_partkey=p_partkey group by 1,2")
def _(t):
    d = G.revenue_by_category(t.lineitem, t.part, F.col("l_partkey") == F.col("p_partkey"), "p_type", "l_shipdate", F.col("l_extendedprice"))
    return d.select("p_type", "month", r("revenue", 2).alias("revenue"))


@query("c40_ltv_by", "with o as (select o_custkey, sum(o_totalprice::decimal(18,2)) as v from orders group by 1) select c_mktsegment, count(*) as users, round(coalesce(sum(v),0)::double,2) as revenue, round(coalesce(sum(v),0)::double/count(*),6) as ltv from customer left join o on o_custkey=c_custkey group by 1")
def _(t):
    d = G.ltv_by(money(t), t.customer, "o_custkey", "c_custkey", "o_totalprice", "c_mktsegment")
    return d.select("c_mktsegment", "users", r("revenue", 2).alias("revenue"), r("ltv").alias("ltv"))


# --- sessions ----------------------------------------------------------------------------

GAP = 12 * 3600
SESS_SQL = """sp as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events), sn as (select *, sum(case when p is null or epoch_us(ts)-epoch_us(p) > 43200000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as session_no from sp),
  ss as (select user_id, session_no, min(ts) as session_start, max(ts) as session_end, count(*) as events, count(case when event_type='view' then 1 end) as page_views, arg_min(event_type, ts) as landing_page, bool_or(event_type='purchase') as had_purchase from sn group by 1,2)"""


def session_table(t, target_rows=X.TARGET_ROWS):
    s = X.sessionise(t.events, "user_id", "ts", "event_id", GAP, target_rows)
    return X.session_table(s, "user_id", "ts", "event_id", "event_type", F.col("event_type") == "view", F.col("event_type") == "purchase")


_SESS_OUT = "select user_id, session_no::bigint as session_no, strftime(session_start,'%Y-%m-%d %H:%M:%S') as session_start, strftime(session_end,'%Y-%m-%d %H:%M:%S') as session_end, events, page_views, landing_page, had_purchase from ss"


def _sess_out(df):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.select("user_id", F.col("session_no").cast("long").alias("session_no"), f("session_start"), f("session_end"), "events", "page_views", "landing_page", "had_purchase")


@query("x01_sessionise", f"with {SESS_SQL} {_SESS_OUT}")
def _(t):
    return _sess_out(session_table(t))


@query("x01_sessionise_split", f"with {SESS_SQL} {_SESS_OUT}")
def _(t):
    return _sess_out(session_table(t, target_rows=700))


# A user's device by event: a user's sessions on several devices can overlap.
DEVICE_SQL = """dv as (select *, 'd'||(event_id%3) as device, lag(ts) over (partition by user_id, 'd'||(event_id%3) order by ts, event_id) as p from events), dn as (select *, sum(case when p is null or epoch_us(ts)-epoch_us(p) > 43200000000 then 1 else 0 end) over (partition by user_id, device order by ts, event_id) as session_no from dv),
  ds as (select user_id, device, session_no, min(ts) as session_start, max(ts) as session_end, count(*) as events, arg_min(event_type, (ts, event_id)) as landing_page from dn group by 1,2,3)"""


def on_devices(t):
    return t.events.withColumn("device", F.concat(F.lit("d"), F.col("event_id") % 3))


def device_sessions(t):
    s = X.sessionise(on_devices(t), ["user_id", "device"], "ts", "event_id", GAP)
    return X.session_table(s, ["user_id", "device"], "ts", "event_id", "event_type", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("x01_session_device", f"with {DEVICE_SQL} select user_id, device, session_no::bigint as session_no, strftime(session_start,'%Y-%m-%d %H:%M:%S') as session_start, strftime(session_end,'%Y-%m-%d %H:%M:%S') as session_end, events, landing_page from ds")
def _(t):
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return device_sessions(t).select("user_id", "device", F.col("session_no").cast("long").alias("session_no"), f("session_start"), f("session_end"), "events", "landing_page")


@query("x01_session_first_device", f"with {SESS_SQL}, fd as (select user_id, session_no, arg_min('d'||(event_id%3), (ts, event_id)) as device from sn group by 1,2) select user_id, session_no::bigint as session_no, device from fd")
def _(t):
    s = X.sessionise(on_devices(t), "user_id", "ts", "event_id", GAP)
    d = X.session_table(s, "user_id", "ts", "event_id", "event_type", F.col("event_type") == "view", F.col("event_type") == "purchase", device="device")
    return d.select("user_id", F.col("session_no").cast("long").alias("session_no"), "device")


@query("x01_session_windows", f"with {SESS_SQL} select user_id, strftime(session_start,'%Y-%m-%d %H:%M:%S') as session_start, events from ss")
def _(t):
    return X.session_windows(t.events, "user_id", "ts", "12 hours").withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@query("x02_stay_distribution", """with u as (select user_id, max(value*20/(1+(user_id%60)*(user_id%60))) as s from events group by 1), c as (select least(s,7200.0) as c, s>7200 as o from u), b as (select case when c<5 then '0-5s' when c<10 then '5-10s' when c<30 then '10-30s' when c<60 then '30-60s' when c<120 then '1-2m' when c<300 then '2-5m' when c<600 then '5-10m' when c<1800 then '10-30m' when c<3600 then '30-60m' else '60m+' end as bucket, min(c) as lo, count(*) as users, sum(o::int)::bigint as capped from c group by 1)
  select bucket, users, capped, round(users/sum(users) over ()::double,6) as share, round(sum(users) over (order by lo)/sum(users) over ()::double,6) as cum_share from b""")
def _(t):
    split = F.col("user_id") % 60
    e = t.events.withColumn("stay", F.col("value") * 20 / (1 + split * split))
    return X.stay_distribution(e, "user_id", "stay").select("bucket", "users", "capped", r("share").alias("share"), r("cum_share").alias("cum_share"))


def paged(t):
    return t.events.withColumns({"page": F.concat(F.lit("p"), F.col("event_id") % 12), "module": F.concat(F.lit("m"), F.col("event_id") % 5), "stay": F.col("value") * 8})


PAGED_SQL = "pg as (select *, 'p'||(event_id%12) as page, 'm'||(event_id%5) as module, value*8 as stay from events)"


@query("x03_page_exposure", f"""with {PAGED_SQL}, g as (select page, count(distinct case when event_type='view' then user_id end) as uv, count(case when event_type='view' then 1 end) as shows, count(case when event_type='click' then 1 end) as clicks from pg group by 1)
  select page, uv, shows, clicks, round(uv/(select count(distinct user_id) from events)::double,6) as share, round(clicks/shows::double,6) as clicks_per_show from g where uv/(select count(distinct user_id) from events)::double >= 0.05""")
def _(t):
    d = X.page_exposure(paged(t), "user_id", "page", F.col("event_type") == "view", F.col("event_type") == "click", 0.05)
    return d.select("page", "uv", "shows", "clicks", r("share").alias("share"), r("clicks_per_show").alias("clicks_per_show"))


@query("x04_click_heat", f"with {PAGED_SQL} select page, module, count(distinct user_id) as uv, count(*) as clicks from pg where event_type='click' group by 1,2 having count(distinct user_id) >= 30")
def _(t):
    return X.click_heat(paged(t), "user_id", "page", "module", F.col("event_type") == "click", 30)


@query("x05_short_stay_contrast", f"""with {PAGED_SQL}, u as (select user_id, max(stay) < 3880 as short from pg group by 1), g as (select page, count(distinct user_id) as uv_all, count(distinct case when short then user_id end) as uv_short from pg join u using (user_id) group by 1)
  select page, uv_all, uv_short, round(uv_all/(select count(*) from u)::double,6) as share_all, round(uv_short/nullif((select count(*) from u where short),0)::double,6) as share_short from g""")
def _(t):
    return X.short_stay_contrast(paged(t), "user_id", "stay", "page", 3880.0).select("page", "uv_all", "uv_short", r("share_all").alias("share_all"), r("share_short").alias("share_short"))


@query("x05_short_stay_modules", f"""with {PAGED_SQL}, u as (select user_id, max(stay) < 3880 as short from pg group by 1), g as (select page, module, count(distinct user_id) as uv_all, count(distinct case when short then user_id end) as uv_short from pg join u using (user_id) group by 1, 2)
  select page, module, uv_all, uv_short, round(uv_all/(select count(*) from u)::double,6) as share_all, round(uv_short/nullif((select count(*) from u where short),0)::double,6) as share_short from g""")
def _(t):
    d = X.short_stay_contrast(paged(t), "user_id", "stay", ["page", "module"], 3880.0)
    return d.select("page", "module", "uv_all", "uv_short", r("share_all").alias("share_all"), r("share_short").alias("share_short"))


@query("x06_event_quality", f"""with {DEVICE_SQL}, d as (select distinct user_id as dev, cast(ts as date) as dt from events), l as (select datediff('day', dt, lead(dt) over (partition by dev order by dt)) as g from d)
  select 'duplicate_events' as "check", (select sum(n-1) from (select count(*) as n from events group by event_id))::double as observed union all select 'missing_device_days', (select coalesce(sum(g-1),0) from l where g>1)::double
  union all select 'odd_hour_share', round((select count(case when hour(ts) in (2,3,4) then 1 end)/count(*)::double from events),6) union all select 'overlapping_sessions', (select count(case when session_start < latest then 1 end) from (select session_start, max(session_end) over (partition by user_id order by session_start, session_end rows between unbounded preceding and 1 preceding) as latest from ds))::double""")
def _(t):
    d = X.event_quality(t.events.withColumn("device", F.col("user_id")), device_sessions(t), "event_id", "user_id", "device", "ts", (2, 3, 4))
    return d.select("check", r("observed").alias("observed"))
