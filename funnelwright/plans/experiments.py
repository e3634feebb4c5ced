"""Experiments and causal comparison."""

from pyspark.sql import functions as F

from funnelwright.functions import dist
from funnelwright.functions.scalars import month_index, r
from funnelwright.operators import causal as E
from funnelwright.operators import stats as D
from funnelwright.plans.registry import query
from funnelwright.sources.tables import ORDER_PANEL_SQL

Z = repr(D.Z975)
OUT = lambda df, keep, cols, digits=6: df.select(*keep, *[r(c, digits).alias(c) for c in cols])
WIN = {"pre": ("1998-06-01", "1998-06-09"), "post": ("1998-06-10", "1998-06-15"), "ref_pre": ("1997-06-01", "1997-06-09"), "ref_post": ("1997-06-10", "1997-06-15")}


def _periods_sql(windows: dict, where: str) -> str:
    cols = ("uv_all", "pay_pv", "detail_uv", "exp_uv", "exp_pv")
    sums = []
    for p, (a, b) in windows.items():
        c = f"dt between date '{a}' and date '{b}'"
        sums += [f"nullif(count(distinct case when {c} then dt end),0)::double as d_{p}"] + [f"sum(case when {c} then {x} else 0 end)::double as {x}_{p}" for x in cols]
    rows = []
    for v in E.DID_VOLUMES:
        rows.append(f"select '{v}' as metric, " + ", ".join(f"{v}_{p}/d_{p} as {p}" for p in windows) + " from s")
    for k in E.DID_RATES:
        n, d = {"pay_dau": ("pay_pv", "uv_all"), "detail_dau": ("detail_uv", "uv_all"), "pay_detail": ("pay_pv", "detail_uv"), "exp_dau": ("exp_uv", "uv_all")}[k]
        rows.append(f"select '{k}', " + ", ".join(f"{n}_{p}/nullif({d}_{p},0)" for p in windows) + " from s")
    rows.append("select 'pv_per_user', " + ", ".join(f"exp_pv_{p}/nullif(exp_uv_{p},0)" for p in windows) + " from s")
    return f"{ORDER_PANEL_SQL}, s as (select {', '.join(sums)} from opanel where {where}), pm as ({' union all '.join(rows)})"


OVERALL = "tag='overall'"


def overall(t):
    return t.order_panel_between("1997-06-01", "1998-06-30").where("tag = 'overall'")


@query("e01_did_relative", f"with {_periods_sql(WIN, OVERALL)} select metric, round(pre,6) as pre, round(post,6) as post, round((post-pre)/nullif(pre,0),6)+0.0 as change_treated, round((ref_post-ref_pre)/nullif(ref_pre,0),6)+0.0 as change_ref, round((post-pre)/nullif(pre,0)-(ref_post-ref_pre)/nullif(ref_pre,0),6)+0.0 as did from pm")
def _(t):
    return OUT(E.did_relative(overall(t), WIN), ["metric"], ["pre", "post", "change_treated", "change_ref", "did"])


@query("e02_counterfactual_gap", f"with {_periods_sql(WIN, OVERALL)}, x as (select *, pre*(1+(ref_post-ref_pre)/nullif(ref_pre,0)) as e from pm) select metric, round(e,6) as expected, round(post-e,6)+0.0 as gap, round((post-e)/nullif(e,0),6)+0.0 as rel_gap from x")
def _(t):
    return OUT(E.counterfactual_gap(E.did_relative(overall(t), WIN)), ["metric"], ["expected", "gap", "rel_gap"])


@query("e03_gap_progress", f"with {_periods_sql({**WIN, 'post_long': ('1998-06-10', '1998-06-21')}, OVERALL)}, x as (select *, pre*(1+(ref_post-ref_pre)/nullif(ref_pre,0)) as e from pm) select metric, round((post-e)/nullif(e,0),6)+0.0 as gap_short, round((post_long-e)/nullif(e,0),6)+0.0 as gap_long, abs((post_long-e)/nullif(e,0)) < abs((post-e)/nullif(e,0)) as narrowing from x")
def _(t):
    return OUT(E.gap_progress(overall(t), WIN, ("1998-06-10", "1998-06-21")), ["metric", "narrowing"], ["gap_short", "gap_long"])


DC = {"day": ("1998-06-21", "1998-06-21"), "prev_day": ("1998-06-20", "1998-06-20"), "before": ("1998-06-01", "1998-06-09")}


@query("e04_day_compare", f"with {_periods_sql(DC, OVERALL)} select metric, round(day,6) as value, round(prev_day,6) as prev_day, round(before,6) as before, round((day-prev_day)/nullif(prev_day,0),6)+0.0 as vs_prev_day, round((day-before)/nullif(before,0),6)+0.0 as vs_before from pm")
def _(t):
    d = E.day_compare(overall(t), "1998-06-21", {k: v for k, v in DC.items() if k != "day"})
    return OUT(d, ["metric"], ["value", "prev_day", "before", "vs_prev_day", "vs_before"])


@query("e05_daily_yoy", f"""with {ORDER_PANEL_SQL}, x as materialized (select tag, member, dt, uv_all, year(dt) as y, strftime(dt,'%m-%d') as md from opanel), a as (select * from x where y=1998), b as (select tag, member, md, uv_all from x where y=1997)
  select a.tag, a.member, a.dt, a.uv_all, b.uv_all as uv_all_last, round((a.uv_all-b.uv_all)/nullif(b.uv_all,0)::double,6)+0.0 as uv_all_yoy from a left join b on a.tag=b.tag and a.member=b.member and a.md=b.md""")
def _(t):
    return E.daily_yoy(t.order_panel_between("1997-01-01", "1998-12-31"), 1998, ["uv_all"]).withColumn("uv_all_yoy", r("uv_all_yoy"))


def seg_month(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("seg"), F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("y"))


SM = "sm as (select c_mktsegment as seg, date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as y from orders join customer on o_custkey=c_custkey group by 1,2)"


@query("e06_did", f"""with {SM}, x as (select seg='BUILDING' as t, m >= date '1998-01-01' as p, y, (year(m)*12+month(m)-1)::double as i from sm where seg in ('BUILDING','MACHINERY') and m between date '1997-01-01' and date '1998-12-01'), g as (select avg(case when t and not p then y end) tp, avg(case when t and p then y end) tq, avg(case when not t and not p then y end) cp, avg(case when not t and p then y end) cq, regr_slope(y,i) filter (where t and not p) ts, regr_slope(y,i) filter (where not t and not p) cs from x)
  select round(tp,4) as t_pre, round(tq,4) as t_post, round(cp,4) as c_pre, round(cq,4) as c_post, round((tq-tp)-(cq-cp),4)+0.0 as did, round(ts-cs,4)+0.0 as trend_gap from g""")
def _(t):
    s = seg_month(t).where("seg in ('BUILDING','MACHINERY') and m between date'1997-01-01' and date'1998-12-01'")
    d = E.did(s, F.col("seg") == "BUILDING", F.col("m") >= F.lit("1998-01-01").cast("date"), "y", month_index("m"))
    return OUT(d, [], ["t_pre", "t_post", "c_pre", "c_post", "did", "trend_gap"], 4)


def seg_day(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_orderdate").alias("dt")).agg(F.count("*").alias("y"))


SD = "sd as (select c_mktsegment as seg, cast(o_orderdate as date) as dt, count(*) as y, datediff('day', date '1998-06-10', cast(o_orderdate as date)) as d from orders join customer on o_custkey=c_custkey group by 1,2)"


@query("e07_pre_post", f"""with {SD}, g as (select seg, count(case when d between -30 and -1 then 1 end)::double n1, avg(case when d between -30 and -1 then y end) m1, var_samp(case when d between -30 and -1 then y end) v1, count(case when d between 0 and 29 then 1 end)::double n2, avg(case when d between 0 and 29 then y end) m2, var_samp(case when d between 0 and 29 then y end) v2, regr_slope(y, d) filter (where d between -30 and -1) sl, avg(case when d between -394 and -365 then y end) l1, avg(case when d between -364 and -335 then y end) l2 from sd group by 1)
  select seg, round(m1,6) as mean_pre, round(m2,6) as mean_post, round(m2-m1,6)+0.0 as diff, round(m2-m1-{Z}*sqrt(v1/n1+v2/n2),6)+0.0 as ci_lower, round(m2-m1+{Z}*sqrt(v1/n1+v2/n2),6)+0.0 as ci_upper, round(sl,6)+0.0 as prior_trend, round(l2-l1,6)+0.0 as last_year_diff from g""")
def _(t):
    d = E.pre_post(seg_day(t), "dt", "y", "1998-06-10", 30, ["seg"])
    return OUT(d, ["seg"], ["mean_pre", "mean_post", "diff", "ci_lower", "ci_upper", "prior_trend", "last_year_diff"])


@query("e08_interrupted_series", f"""with {SD}, f as (select seg, regr_slope(y,d) filter (where d<0) sl, regr_intercept(y,d) filter (where d<0) ic, count(case when d>=0 then 1 end) n, sum(case when d>=0 then y end) act, sum(case when d>=0 then d end) sd from sd group by 1)
  select seg, n as n_post, round(act,4)::double as actual, round(ic*n+sl*sd,4) as projected, round(act-(ic*n+sl*sd),4)+0.0 as excess, round((act-(ic*n+sl*sd))/(ic*n+sl*sd),6)+0.0 as excess_rate from f""")
def _(t):
    d = E.interrupted_series(seg_day(t), "dt", "y", "1998-06-10", ["seg"])
    return d.select("seg", "n_post", r("actual", 4).alias("actual"), r("projected", 4).alias("projected"), r("excess", 4).alias("excess"), r("excess_rate").alias("excess_rate"))


MATCH = "mt as (select o_orderkey % 3 = 0 as t, o_orderstatus as s1, year(o_orderdate) as s2, o_totalprice as y, day(o_orderdate) as dd from orders)"


def match_input(t):
    return t.orders.select((F.col("o_orderkey") % 3 == 0).alias("t"), F.col("o_orderstatus").alias("s1"), F.year("o_orderdate").alias("s2"), F.col("o_totalprice").alias("y"), F.dayofmonth("o_orderdate").alias("dd"))


@query("e09_match_outcomes", f"""with {MATCH}, s as (select s1, s2, count(case when t then 1 end) nt, count(case when not t then 1 end) nc, sum(case when t then y end) st, sum(case when not t then y end) sc from mt group by 1,2)
  select sum(case when nt>0 and nc>0 then nt end)::bigint as matched_treated, sum(nt)::bigint as treated, round(sum(case when nt>0 and nc>0 then st end)/sum(case when nt>0 and nc>0 then nt end),4) as mean_treated, round(sum(case when nt>0 and nc>0 then nt*sc/nc end)/sum(case when nt>0 and nc>0 then nt end),4) as mean_matched,
  round(sum(st)/sum(nt)-sum(sc)/sum(nc),4)+0.0 as naive_diff, round(sum(case when nt>0 and nc>0 then st end)/sum(case when nt>0 and nc>0 then nt end)-sum(case when nt>0 and nc>0 then nt*sc/nc end)/sum(case when nt>0 and nc>0 then nt end),4)+0.0 as effect from s""")
def _(t):
    d = E.match_outcomes(match_input(t), F.col("t"), ["s1", "s2"], "y")
    return d.select("matched_treated", "treated", *[r(c, 4).alias(c) for c in ("mean_treated", "mean_matched", "naive_diff", "effect")])


@query("e09_match_balance", f"""with {MATCH}, r as (select avg(case when t then dd end) mt1, avg(case when not t then dd end) mc1, var_samp(case when t then dd end) vt, var_samp(case when not t then dd end) vc from mt), s as (select s1, s2, count(case when t then 1 end) nt, count(case when not t then 1 end) nc, avg(case when t then dd end) at1, avg(case when not t then dd end) ac from mt group by 1,2),
  w as (select sum(nt*at1)/sum(nt) wt, sum(nt*ac)/sum(nt) wc from s where nt>0 and nc>0) select 'dd' as covariate, round((mt1-mc1)/sqrt((vt+vc)/2),6)+0.0 as smd_before, round((wt-wc)/sqrt((vt+vc)/2),6)+0.0 as smd_after from r, w""")
def _(t):
    return OUT(E.match_balance(match_input(t), F.col("t"), ["s1", "s2"], ["dd"]), ["covariate"], ["smd_before", "smd_after"])


ASG = """asg as (select user_id, 'v' || (user_id%2) as variant, 'C'||(user_id%3) as channel, min(ts) as t0 from events where event_type='signup' group by 1,2,3), ao as (select a.user_id, variant, channel, count(e.ts) as orders, coalesce(sum(e.value),0) as revenue from asg a left join events e on e.user_id=a.user_id and e.event_type='purchase' and e.ts between t0 and t0 + interval 3 day group by 1,2,3)"""


def assigned(t):
    a = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    a = a.withColumns({"variant": F.concat(F.lit("v"), F.col("user_id") % 2), "channel": F.concat(F.lit("C"), F.col("user_id") % 3)})
    return E.assigned_outcomes(a, t.events.where("event_type = 'purchase'"), "user_id", "t0", "ts", 3, "value")


@query("e10_ab_test", f"""with {ASG}, g as (select count(case when variant='v0' then 1 end)::double na, count(case when variant='v1' then 1 end)::double nb, count(case when variant='v0' and orders>0 then 1 end)::double xa, count(case when variant='v1' and orders>0 then 1 end)::double xb from ao), p as (select *, xa/na pa, xb/nb pb, (xa+xb)/(na+nb) pp from g)
  select na::bigint as n_a, nb::bigint as n_b, round(pa,6) as prop_a, round(pb,6) as prop_b, round((pb-pa)/pa,6)+0.0 as lift, round((pb-pa)/nullif(sqrt(pp*(1-pp)*(1/na+1/nb)),0),6)+0.0 as z from p""")
def _(t):
    return OUT(E.ab_test(assigned(t), "variant", "v0", "v1"), ["n_a", "n_b"], ["prop_a", "prop_b", "lift", "z"])


@query("e10_ab_test_p")
def _(t):
    return D.with_normal_p(E.ab_test(assigned(t), "variant", "v0", "v1"))


@query("e11_observational_lift", """with u as (select user_id, bool_or(event_type='error' and value>470) e, bool_or(event_type='purchase' and value>440) b from events group by 1) select count(case when e then 1 end) as n_with, count(case when not e then 1 end) as n_without, round(avg(case when e then b::int end),6) as rate_with, round(avg(case when not e then b::int end),6) as rate_without,
  round((avg(case when e then b::int end)-avg(case when not e then b::int end))/nullif(avg(case when not e then b::int end),0),6)+0.0 as lift from u""")
def _(t):
    d = E.observational_lift(t.events, "user_id", F.expr("event_type = 'error' and value > 470"), F.expr("event_type = 'purchase' and value > 440"))
    return OUT(d, ["n_with", "n_without"], ["rate_with", "rate_without", "lift"])


@query("e12_decision_rule", """with x as (select p_brand as experiment, (count(*)%9 - 3)/10.0::double as effect, count(*)%2=0 as significant, ((sum(p_size)%40)::double - 20)/100 as guard from part group by 1)
  select experiment, effect, significant, guard, case when significant and effect>0 then 'positive' when significant and effect<0 then 'negative' else 'null' end as "primary", case when greatest(-guard,0)>=0.05 then 'degraded' else 'ok' end as guardrail,
  case when not (significant and effect>0) then 'DON''T SHIP' when greatest(-guard,0)>0.15 then 'DON''T SHIP' when greatest(-guard,0)>=0.05 then 'INVESTIGATE' else 'SHIP' end as decision from x""")
def _(t):
    x = t.part.groupBy(F.col("p_brand").alias("experiment")).agg(((F.count("*") % 9 - 3) / 10.0).alias("effect"), (F.count("*") % 2 == 0).alias("significant"), (((F.sum("p_size") % 40).cast("double") - 20) / 100).alias("guard"))
    return E.decision_rule(x, "effect", "significant", "guard")


K = repr((dist.norm_ppf(0.975) + dist.norm_ppf(0.8)) ** 2)


@query("e13_power_table", f"""with s as (select o_orderpriority as seg, count(*) n, avg(case when o_orderstatus='F' then 1.0 else 0.0 end)::double p, avg(o_totalprice) m, stddev_samp(o_totalprice) sd from orders group by 1)
  select seg, n, ceil({K}*(p*(1-p)+p*1.05*(1-p*1.05))/((p*1.05-p)*(p*1.05-p)))::bigint as n_prop, ceil({K}*2*sd*sd/((m*0.05)*(m*0.05)))::bigint as n_mean, round(sqrt({K})*sqrt(2*p*(1-p)/floor(n/2)),6) as mde_rate, round(sqrt({K})*sqrt(2*p*(1-p)/floor(n/2))/p,6) as mde_rate_rel, round(sqrt({K})*sd*sqrt(2/floor(n/2)),4) as mde_mean from s""")
def _(t):
    s = t.orders.groupBy(F.col("o_orderpriority").alias("seg")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("p"), F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("sd"))
    d = E.power_table(s, "p", "m", "sd", "n", 0.05)
    return d.select("seg", "n", "n_prop", "n_mean", r("mde_rate").alias("mde_rate"), r("mde_rate_rel").alias("mde_rate_rel"), r("mde_mean", 4).alias("mde_mean"))


IMP = """sg as (select c_mktsegment as seg, count(distinct o_custkey) as users, 0.02::double as imp, avg(o_totalprice) as val from orders join customer on o_custkey=c_custkey group by 1), im as (select *, users*imp*val*4.0::double as impact from sg)"""


def impact(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    u = o.groupBy(F.col("c_mktsegment").alias("seg"), "o_custkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    s = u.groupBy("seg").agg(F.count("*").alias("users"), (F.sum("v") / F.sum("n")).alias("val")).withColumn("imp", F.lit(0.02))
    return E.impact_model(s, "seg", "users", "imp", "val", F.lit(0.8), F.length("seg").cast("double"), F.lit(1000000.0), 4.0)


@query("e14_impact_model", f"with {IMP} select seg, users, round(impact,2) as impact, round(impact*0.5,2) as pessimistic, round(impact*1.5,2) as optimistic, round(1000000.0/(users*val*4.0::double),8) as break_even, round(impact*0.8::double/length(seg),2) as priority, cast(row_number() over (order by impact*0.8::double/length(seg) desc, seg) as integer) as rank from im")
def _(t):
    return impact(t).select("seg", "users", *[r(c, 2).alias(c) for c in ("impact", "pessimistic", "optimistic")], r("break_even", 8).alias("break_even"), r("priority", 2).alias("priority"), "rank")


@query("e14_sensitivity", f"with {IMP} select seg, f as factor, round(impact*f,2) as scenario_impact, round((f-1)*100,2)+0.0 as vs_base_pct from im, (select unnest([0.5,0.75,1.0,1.25,1.5])::double as f)")
def _(t):
    return E.sensitivity(impact(t), "seg").select("seg", "factor", r("scenario_impact", 2).alias("scenario_impact"), r("vs_base_pct", 2).alias("vs_base_pct"))


@query("e15_balance_check", f"""with {ASG}, l as (select variant, 'channel' as attribute, channel as member from ao union all select variant, 'orders', orders::varchar from ao), g as (select attribute, member, count(case when variant='v0' then 1 end) a, count(case when variant='v1' then 1 end) b from l group by 1,2)
  select attribute, member, a as n_control, b as n_treatment, round(a/sum(a) over w::double,6) as share_control, round(b/sum(b) over w::double,6) as share_treatment, round(b/sum(b) over w::double-a/sum(a) over w::double,6)+0.0 as share_diff from g window w as (partition by attribute)""")
def _(t):
    d = E.balance_check(assigned(t), "variant", "v0", "v1", ["channel", "orders"])
    return OUT(d, ["attribute", "member", "n_control", "n_treatment"], ["share_control", "share_treatment", "share_diff"])


@query("e15_balance_chi2", f"""with {ASG}, c as (select variant r, channel c, count(*)::double o from ao group by 1,2), e as (select *, sum(o) over (partition by r)*sum(o) over (partition by c)/sum(o) over () as e from c) select sum(o)::bigint as n, round(sum((o-e)**2/e),6) as chi2, 2::bigint as dof from e""")
def _(t):
    return D.chi2_independence(assigned(t), "variant", "channel").select("n", r("chi2").alias("chi2"), "dof")


@query("e16_guardrail_check", f"""with {ASG}, l as (select variant v, 'orders' as metric, orders::double x from ao union all select variant, 'revenue', revenue from ao), g as (select metric, avg(x) filter (where v='v0') ma, avg(x) filter (where v='v1') mb, var_samp(x) filter (where v='v0') va, var_samp(x) filter (where v='v1') vb, count(*) filter (where v='v0') na, count(*) filter (where v='v1') nb from l group by 1)
  select metric, round(ma,6) as mean_a, round(mb,6) as mean_b, round((mb-ma)/ma,6)+0.0 as rel_change, round((ma-mb)/sqrt(va/na+vb/nb),6)+0.0 as t from g""")
def _(t):
    return OUT(E.guardrail_check(assigned(t), "variant", "v0", "v1", ["orders", "revenue"]), ["metric"], ["mean_a", "mean_b", "rel_change", "t"])


@query("e17_net_effect", f"with {ASG} select variant, count(*) as users, count(case when orders>0 then 1 end) as buyers, round(count(case when orders>0 then 1 end)/count(*)::double,6) as conversion, round(sum(revenue)/sum(orders),6) as order_value, round(sum(revenue)/count(*),6) as revenue_per_user from ao group by 1")
def _(t):
    return OUT(E.net_effect(assigned(t), "variant"), ["variant", "users", "buyers"], ["conversion", "order_value", "revenue_per_user"])


@query("e18_abandonment", "with g as (select user_id%3 as platform, count(case when event_type='click' then 1 end) s, count(case when event_type='purchase' then 1 end) c, avg(case when event_type='purchase' then value end) v from events group by 1) select platform, s as started, c as completed, greatest(s-c,0) as abandoned, round(v,6) as mean_value, round(greatest(s-c,0)*v*0.1,4) as recoverable from g")
def _(t):
    e = t.events.withColumn("platform", F.col("user_id") % 3)
    d = E.abandonment(e, F.col("event_type") == "click", F.col("event_type") == "purchase", F.col("value"), 0.1, ["platform"])
    return d.select("platform", "started", "completed", "abandoned", r("mean_value").alias("mean_value"), r("recoverable", 4).alias("recoverable"))
