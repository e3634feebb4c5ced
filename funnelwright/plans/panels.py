"""Funnel panel and KPI reports."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import in_period, like_any, r, shift, week_start
from funnelwright.operators import panel as P
from funnelwright.plans.primitives import RATE_COLS, RATES_SQL
from funnelwright.plans.registry import query
from funnelwright.sources.tables import FUNNEL_EVENTS_SQL, ORDER_PANEL_SQL, PANEL_SQL

END, MONTH, EIGHT = "2024-01-28", "2024-01-01", "2023-12-04"
YEAR = ("1997-06-01", "1998-06-30")
WEEK_SQL = "(dt - cast((dt - date '1970-01-05') % 7 as integer))"
AVG_SQL = ", ".join(f"avg({c}) as {c}" for c in P.COUNTS)
AVG_ROUND = ", ".join(f"round({c},6) as {c}" for c in P.COUNTS)


def _trend_out(df, *keys):
    return df.select(*keys, "days", *[r(c).alias(c) for c in P.COUNTS], *[r(c).alias(c) for c in RATE_COLS])


@query("k01_funnel_panel", f"with {PANEL_SQL} select * from panel")
def _(t):
    return t.panel


@query("k01_order_panel", f"with {ORDER_PANEL_SQL} select * from opanel")
def _(t):
    return t.order_panel


TARGETS = {"pay_dau": 0.5, "uv_all": 150.0, "pay_pv": 70.0}


@query("k02_kpi_achievement", f"""with {PANEL_SQL}, s as (select sum(case when dt >= date '2024-01-01' then pay_pv end)::double pm, sum(case when dt >= date '2024-01-01' then uv_all end)::double um, count(distinct dt) dm,
   sum(case when dt >= date '2024-01-22' then pay_pv end)::double pw, sum(case when dt >= date '2024-01-22' then uv_all end)::double uw, count(distinct case when dt >= date '2024-01-22' then dt end) dw,
   sum(case when dt between date '2024-01-15' and date '2024-01-21' then pay_pv end)::double pp, sum(case when dt between date '2024-01-15' and date '2024-01-21' then uv_all end)::double up, count(distinct case when dt between date '2024-01-15' and date '2024-01-21' then dt end) dp
   from panel where tag='overall' and dt <= date '2024-01-28'), k as (
   select 'pay_dau' kpi, 0.5::double target, pm/um m, pw/uw w, pp/up p, round(pw/uw,6) wf, round(pp/up,6) pf from s union all select 'uv_all', 150.0, um/dm, uw/dw, up/dp, floor(uw/dw), floor(up/dp) from s union all select 'pay_pv', 70.0, pm/dm, pw/dw, pp/dp, floor(pw/dw), floor(pp/dp) from s)
   select kpi, target, round(m,6) as month_mean, round(m/target,6) as achieved, round(w,6) as week_mean, round(p,6) as prior_mean, round((wf-pf)/pf,6)+0.0 as wow from k""")
def _(t):
    d = P.kpi_achievement(t.panel_between(MONTH, END), TARGETS, END)
    return d.select("kpi", "target", *[r(c).alias(c) for c in ("month_mean", "achieved", "week_mean", "prior_mean", "wow")])


def _wow_sql(where: str, dau_tags: str | None = None) -> str:
    sums = []
    for v in P.VOLUMES:
        sums += [f"sum(case when dt >= date '2024-01-22' then {v} else 0 end)::double as {v}_c", f"sum(case when dt between date '2024-01-15' and date '2024-01-21' then {v} else 0 end)::double as {v}_p"]
    sums += ["sum(pay_pv)::double as pay_m, sum(uv_all)::double as uv_m", "nullif(count(case when dt >= date '2024-01-22' then 1 end),0) as dc", "nullif(count(case when dt between date '2024-01-15' and date '2024-01-21' then 1 end),0) as dp"]
    mid = []
    for v in P.VOLUMES:
        show = f"case when tag in ({dau_tags}) then {{}} end" if v == "uv_all" and dau_tags else "{}"
        mid += [show.format(f"floor({v}_c/dc)") + f" as f_{v}_c", show.format(f"floor({v}_p/dp)") + f" as f_{v}_p"]
    for k, (n, d) in P.RATES.items():
        mid += [f"round({n}_c/nullif({d}_c,0),6) as r_{k}_c", f"round({n}_p/nullif({d}_p,0),6) as r_{k}_p"]
    out = ["round(pay_m/nullif(uv_m,0),6) as pay_dau_month"]
    for v in P.VOLUMES:
        out += [f"f_{v}_c::bigint as {v}_week", f"round((f_{v}_c-f_{v}_p)/nullif(f_{v}_p,0),6)+0.0 as {v}_wow"]
    for k in P.RATES:
        out += [f"r_{k}_c as {k}_week", f"round((r_{k}_c-r_{k}_p)/nullif(r_{k}_p,0),6)+0.0 as {k}_wow"]
    return f"s as (select tag, member, {', '.join(sums)} from panel where dt between date '2024-01-01' and date '2024-01-28' and {where} group by 1,2), x as (select *, {', '.join(mid)} from s), wow as (select tag, member, {', '.join(out)} from x)"


@query("k03_funnel_wow", f"with {PANEL_SQL}, {_wow_sql(chr(39) + 'overall' + chr(39) + ' = tag')} select * from wow")
def _(t):
    return P.funnel_wow(t.panel_between(MONTH, END), END, ["overall"])


DIM_WHERE = "tag in ('terminal','scene','source') and member not in ('S3')"


def dims_wow(t):
    return P.funnel_wow(t.panel_between(MONTH, END), END, ["terminal", "scene", "source"], exclude=["S3"], dau_tags=["terminal", "source"])


DIM_WOW = _wow_sql(DIM_WHERE, "'terminal','source'")


@query("k04_funnel_wow_by_dims", f"with {PANEL_SQL}, {DIM_WOW} select * from wow")
def _(t):
    return dims_wow(t)


@query("k05_weekly_trend", f"with {PANEL_SQL}, w as (select tag, member, {WEEK_SQL} as week_start, count(distinct dt) as days, {AVG_SQL} from panel where dt between date '2023-12-04' and date '2024-01-28' group by 1,2,3) select tag, member, week_start, week_start+6 as week_end, days, {AVG_ROUND}, {RATES_SQL} from w")
def _(t):
    return _trend_out(P.weekly_trend(t.panel_between(EIGHT, END), END), "tag", "member", "week_start", "week_end")


@query("k06_monthly_trend", f"with {ORDER_PANEL_SQL}, m as (select tag, member, strftime(dt,'%Y-%m') as month, count(distinct dt) as days, {AVG_SQL} from opanel where dt between date '1997-01-01' and date '1998-07-19' and not (strftime(dt,'%Y-%m')='1997-07' and day(dt) > 19) group by 1,2,3) select tag, member, month, days, {AVG_ROUND}, {RATES_SQL} from m")
def _(t):
    return _trend_out(P.monthly_trend(t.order_panel_between("1997-01-01", "1998-07-19"), "1997-01-01", "1998-07-19"), "tag", "member", "month")


@query("k07_daily_metrics", f"with {PANEL_SQL} select tag, member, dt, uv_all, pay_pv, {RATES_SQL} from panel where dt between date '2024-01-22' and date '2024-01-28'")
def _(t):
    return P.daily_metrics(t.panel_between("2024-01-22", END), "2024-01-22", END).select("tag", "member", "dt", "uv_all", "pay_pv", *[r(c).alias(c) for c in RATE_COLS])


TWO_WEEKS, TWO_YEARS = ("1998-06-15", "1998-06-28"), ("1997-05-05", "1998-06-28")


def brand_events(t, lo, hi):
    """Stage events of lineitems: category from the part, entity is the order."""
    pool = t.part.where("p_size <= 30").select("p_partkey", F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), "phone").when(F.col("p_brand").isin("Brand#4", "Brand#5"), "tablet").when(F.col("p_brand") == "Brand#6", "watch").alias("category"))
    stage = F.when(F.col("l_linenumber") <= 2, "exp").when(F.col("l_linenumber") <= 4, "detail").when(F.col("l_linenumber") <= 5, "order").otherwise("pay")
    li = t.lineitem_between(lo, hi).select(F.col("l_shipdate").alias("dt"), stage.alias("stage"), F.col("l_orderkey").alias("entity"), "l_partkey")
    return li.join(pool, F.col("l_partkey") == F.col("p_partkey")).select("dt", "stage", "category", "entity")


BRAND_SQL = """be as (select cast(l_shipdate as date) as dt, case when l_linenumber<=2 then 'exp' when l_linenumber<=4 then 'detail' when l_linenumber<=5 then 'order' else 'pay' end as stage,
   case when p_brand in ('Brand#1','Brand#2','Brand#3') then 'phone' when p_brand in ('Brand#4','Brand#5') then 'tablet' when p_brand='Brand#6' then 'watch' end as category, l_orderkey as entity
   from lineitem join part on l_partkey=p_partkey where p_size <= 30), dau as (select cast(l_shipdate as date) as dt, count(distinct l_orderkey) as uv_all from lineitem group by 1),
   bd as (select dt, stage, coalesce(category,'all') as category, uv from (select dt, stage, category, count(distinct entity) as uv from be where category is not null group by grouping sets ((dt,stage,category),(dt,stage))))"""


def brand_dau(t, lo, hi):
    u = t.lineitem_between(lo, hi).groupBy(F.col("l_shipdate").alias("dt"), "l_orderkey").agg(F.lit(1).alias("one"))
    return u.groupBy("dt").agg(F.count("one").alias("uv_all"))


BRAND_PAIRS = {"exp_dau": ("exp", "dau"), "detail_dau": ("detail", "dau"), "detail_exp": ("detail", "exp"), "pay_detail": ("pay", "detail"), "order_detail": ("order", "detail"), "pay_order": ("pay", "order"), "pay_exp": ("pay", "exp"), "pay_dau": ("pay", "dau"), "order_dau": ("order", "dau")}
_bw = ", ".join(f"coalesce(sum(case when stage='{s}' and dt >= date '1998-06-22' then uv end),0)/7.0::double as {s}_c, coalesce(sum(case when stage='{s}' and dt < date '1998-06-22' then uv end),0)/7.0::double as {s}_p" for s in P.STAGES)
_bo = ", ".join(f"round({s}_c,4) as {s}, round(({s}_c-{s}_p)/nullif({s}_p,0),6)+0.0 as {s}_wow" for s in P.STAGES)
_br = ", ".join(f"round({a}_c/nullif({b}_c,0),6) as {k}, round(({a}_c/nullif({b}_c,0)-{a}_p/nullif({b}_p,0))/nullif({a}_p/nullif({b}_p,0),0),6)+0.0 as {k}_wow" for k, (a, b) in BRAND_PAIRS.items())


@query("k08_brand_funnel", f"""with {BRAND_SQL}, c as (select category, {_bw} from bd where dt between date '1998-06-15' and date '1998-06-28' group by 1),
   x as (select *, (select sum(uv_all)/7.0::double from dau where dt between date '1998-06-22' and date '1998-06-28') as dau_c, (select sum(uv_all)/7.0::double from dau where dt between date '1998-06-15' and date '1998-06-21') as dau_p from c)
   select category, round(dau_c,4) as dau, {_bo}, {_br} from x""")
def _(t):
    return P.brand_funnel(brand_events(t, *TWO_WEEKS), brand_dau(t, *TWO_WEEKS), "1998-06-28")


_ty = "(dt between date '1998-05-04' and date '1998-06-28' or dt between date '1997-05-05' and date '1997-06-29')"


@query("k09_brand_trend_yoy", f"""with {BRAND_SQL}, w as (select {WEEK_SQL} as week_start, category, stage, sum(uv)/count(distinct dt)::double as v from bd where {_ty} group by 1,2,3), g as (select week_start, category, {", ".join(f"coalesce(max(case when stage='{s}' then v end),0)::double as {s}" for s in P.STAGES)} from w group by 1,2),
   d as (select {WEEK_SQL} as week_start, avg(uv_all) as dau from dau where {_ty} group by 1), j as (select g.*, d.dau from g left join d using (week_start))
   select category, case when week_start >= date '1998-05-04' then 'this' else 'last' end as year_label, week_start, week_start+6 as week_end, case when week_start >= date '1998-05-04' then week_start+6 else week_start+370 end as aligned_end,
   round(dau,4) as dau, round(exp,4) as exp, round(detail,4) as detail, round("order",4) as "order", round(pay,4) as pay, {", ".join(f'round("{a}"/nullif("{b}",0),6) as {k}' for k, (a, b) in BRAND_PAIRS.items() if k != 'order_dau')}
   from j where week_start >= date '1998-05-04' or week_start between date '1997-05-05' and date '1997-06-29'""")
def _(t):
    return P.brand_trend_yoy(brand_events(t, *TWO_YEARS), brand_dau(t, *TWO_YEARS), "1998-06-28")


_sm = ("pay_pv", "uv_all", "exp_uv", "exp_pv")
_ss = ", ".join(f"floor(sum(case when dt >= date '2024-01-22' then {m} else 0 end)/nullif(count(case when dt >= date '2024-01-22' then 1 end),0)::double) as {m}_c, floor(sum(case when dt between date '2024-01-15' and date '2024-01-21' then {m} else 0 end)/nullif(count(case when dt between date '2024-01-15' and date '2024-01-21' then 1 end),0)::double) as {m}_p" for m in _sm)
_sh = ", ".join(f"{m}_c/sum({m}_c) over (partition by tag) as {m}_sc, {m}_p/sum({m}_p) over (partition by tag) as {m}_sp" for m in _sm)
_so = ", ".join(f"{m}_c::bigint as {m}_week, round({m}_sc,6) as {m}_share, round(({m}_sc-{m}_sp)/nullif({m}_sp,0),6)+0.0 as {m}_share_wow" for m in _sm)


@query("k10_structure_share", f"with {PANEL_SQL}, s as (select tag, member, {_ss} from panel where tag<>'overall' and dt between date '2024-01-01' and date '2024-01-28' group by 1,2), h as (select *, {_sh} from s) select tag, member, {_so} from h")
def _(t):
    return P.structure_share(t.panel_between(MONTH, END), END)


_FOUR = "round(avg(pay_pv)/nullif(avg(uv_all),0),6) as pay_dau, round(avg(detail_uv)/nullif(avg(uv_all),0),6) as detail_dau, round(avg(pay_pv)/nullif(avg(detail_uv),0),6) as pay_detail, round(avg(exp_uv)/nullif(avg(uv_all),0),6) as exp_dau"


@query("k11_category_upgrade", f"with {ORDER_PANEL_SQL} select tag, member, {WEEK_SQL} as week_start, {_FOUR} from opanel where dt between date '1998-05-04' and date '1998-06-28' and (tag='overall' or (tag='category' and member in ('BF','BO'))) group by 1,2,3")
def _(t):
    p = t.order_panel_between("1998-05-04", "1998-06-28").where((F.col("tag") == "overall") | ((F.col("tag") == "category") & F.col("member").isin("BF", "BO")))
    return P.weekly_trend(p, "1998-06-28").select("tag", "member", "week_start", *[r(c).alias(c) for c in ("pay_dau", "detail_dau", "pay_detail", "exp_dau")])


@query("k12_page_penetration", f"""with d as (select cast(ts as date) as dt, event_type as page, count(distinct user_id) as uv from events group by 1,2), j as (select a.dt, a.page, a.uv, b.uv as home from d a left join d b on a.dt=b.dt and b.page='view' where a.page<>'view')
   select {WEEK_SQL}+6 as week_end, page, round(avg(home),6) as home_uv, round(avg(uv),6) as page_uv, round(avg(uv)/avg(home),6) as penetration from j group by 1,2""")
def _(t):
    log = t.events.select(F.to_date("ts").alias("dt"), "user_id", F.col("event_type").alias("page"))
    return P.page_penetration(log, "view").select("week_end", "page", *[r(c).alias(c) for c in ("home_uv", "page_uv", "penetration")])


@query("k13_segment_watch", f"with {PANEL_SQL} select tag, member, {WEEK_SQL}+6 as week_end, round(avg(pay_pv)/nullif(avg(uv_all),0),6) as pay_dau, round(avg(exp_uv)/nullif(avg(uv_all),0),6) as exp_dau, round(avg(exp_pv)/nullif(avg(exp_uv),0),6) as pv_per_user from panel where dt between date '2023-12-04' and date '2024-01-28' and tag in ('terminal','source') and (member like '%T1%' or member like '%Z%') group by 1,2,3")
def _(t):
    p = t.panel_between(EIGHT, END).where(F.col("tag").isin("terminal", "source") & like_any("member", ["%T1%", "%Z%"]))
    return P.weekly_trend(p, END).select("tag", "member", "week_end", *[r(c).alias(c) for c in ("pay_dau", "exp_dau", "pv_per_user")])


@query("k14_scene_bag_rate", f"with {PANEL_SQL} select member, {WEEK_SQL} as week_start, round(avg(pay_pv)/nullif(avg(exp_uv),0),6) as pay_exp from panel where dt between date '2023-12-04' and date '2024-01-28' and tag='scene' and member in ('S0','S2') group by 1,2")
def _(t):
    p = t.panel_between(EIGHT, END).where((F.col("tag") == "scene") & F.col("member").isin("S0", "S2"))
    return P.weekly_trend(p, END).select("member", "week_start", r("pay_exp").alias("pay_exp"))


_mm = ("exp_pv", *P.VOLUMES)


def _mom_sql(month: str, prev: str, last: str, where: str = "true") -> str:
    avgs = ", ".join(f"avg(case when strftime(dt,'%Y-%m')='{m}' then {c} end) as {c}_{p}" for c in _mm for p, m in (("c", month), ("p", prev), ("l", last)))
    rows = [(v, *(f"{v}_{p}" for p in "cpl")) for v in P.VOLUMES] + [(k, *(f"{n}_{p}/nullif({d}_{p},0)" for p in "cpl")) for k, (n, d) in P.RATES.items()]
    union = " union all ".join(f"select tag, member, '{k}' as metric, {c} as c, {p} as p, {l} as l from g" for k, c, p, l in rows)
    return f"g as (select tag, member, {avgs} from opanel where {where} group by 1,2), mm as (select tag, member, metric, c as value, (c-p)/nullif(p,0)*100 as mom, (c-l)/nullif(l,0)*100 as yoy from ({union}) where c is not null)"


MOM = _mom_sql("1998-06", "1998-05", "1997-06")


@query("k15_mom_yoy", f"with {ORDER_PANEL_SQL}, {MOM} select tag, member, metric, round(value,6) as value, round(mom,6)+0.0 as mom, round(yoy,6)+0.0 as yoy from mm")
def _(t):
    return P.mom_yoy(t.order_panel_between(*YEAR), "1998-06").select("tag", "member", "metric", *[r(c).alias(c) for c in ("value", "mom", "yoy")])


@query("k16_kpi_month", f"with {ORDER_PANEL_SQL}, {MOM}, tg(metric, target) as (values ('pay_dau', 0.4), ('uv_all', 60.0), ('pay_pv', 25.0)) select metric, target::double as target, round(value,6) as value, round(value/target::double,6) as achieved, round(mom,6)+0.0 as mom, round(yoy,6)+0.0 as yoy from mm join tg using (metric) where tag='overall'")
def _(t):
    targets = t.spark.createDataFrame([("pay_dau", 0.4), ("uv_all", 60.0), ("pay_pv", 25.0)], "metric string, target double")
    m = P.mom_yoy(t.order_panel_between(*YEAR).where("tag = 'overall'"), "1998-06").join(targets, "metric")
    return m.select("metric", "target", r("value").alias("value"), r(F.col("value") / F.col("target")).alias("achieved"), r("mom").alias("mom"), r("yoy").alias("yoy"))


def _struct_sql(tag: str, flow: str) -> str:
    return f"""with {ORDER_PANEL_SQL}, {MOM}, w as (select tag, member, max(case when metric='{flow}' then value end) as f, max(case when metric='{flow}' then mom end) as fm, max(case when metric='uv_all' then value end) as u, max(case when metric='pay_pv' then value end) as p, max(case when metric='pay_pv' then mom end) as pm from mm group by 1,2)
   select a.member, round(a.f,6) as flow, round(a.f/o.u*100,6) as flow_share, round(a.fm,6)+0.0 as flow_mom, round(a.p,6) as orders, round(a.p/o.p*100,6) as orders_share, round(a.pm,6)+0.0 as orders_mom from w a join w o on o.tag='overall' where a.tag='{tag}'"""


def _struct_out(df):
    return df.select("member", *[r(c).alias(c) for c in ("flow", "flow_share", "flow_mom", "orders", "orders_share", "orders_mom")])


@query("k17_structure_table", _struct_sql("terminal", "uv_all"))
def _(t):
    return _struct_out(P.structure_table(t.order_panel_between(*YEAR), "terminal", "1998-06"))


@query("k17_structure_table_exposure", _struct_sql("category", "exp_uv"))
def _(t):
    return _struct_out(P.structure_table(t.order_panel_between(*YEAR), "category", "1998-06", use_exposure=True))


@query("k18_wow_row", f"with {PANEL_SQL}, w as (select tag, member, {WEEK_SQL} as week_start, avg(uv_all) as uv_all, avg(pay_pv) as pay_pv from panel where dt between date '2023-12-04' and date '2024-01-28' group by 1,2,3), l as (select *, lag(uv_all) over p as u0, lag(pay_pv) over p as p0, lead(week_start) over p is null as last from w window p as (partition by tag, member order by week_start)) select tag, member, week_start, round((uv_all-u0)/nullif(u0,0),6)+0.0 as uv_all_wow, round((pay_pv-p0)/nullif(p0,0),6)+0.0 as pay_pv_wow from l where last and u0 is not null")
def _(t):
    return P.wow_row(P.weekly_trend(t.panel_between(EIGHT, END), END), ["tag", "member"], "week_start", ["uv_all", "pay_pv"])


@query("k19_driver_stage", f"""with {PANEL_SQL}, {_wow_sql("true")}, st0 as (select tag, member, pay_dau_wow w, exp_dau_wow e, unnest([{{'s':'exp_dau','v':exp_dau_wow,'i':1}},{{'s':'detail_exp','v':detail_exp_wow,'i':2}},{{'s':'order_detail','v':order_detail_wow,'i':3}},{{'s':'pay_order','v':pay_order_wow,'i':4}}]) as st from wow),
   z as (select *, row_number() over (partition by tag, member order by coalesce(abs(st.v),0) desc, st.i) as rn from st0)
   select tag, member, case when w > 0.01 then 'up' when w < -0.01 then 'down' when w is not null then 'flat' end as direction, e < -0.03 as exposure_alert, st.s as stage, st.v as stage_wow from z where rn = 1""")
def _(t):
    return P.driver_stage(P.funnel_wow(t.panel_between(MONTH, END), END))


@query("k20_dimension_movers", f"""with {PANEL_SQL}, {_wow_sql("true")}, d as (select tag, member, pay_dau_wow as change from wow where tag<>'overall' and pay_dau_wow is not null),
   g as (select tag, count(case when change < 0 then 1 end) as n_down, count(case when change > 0 then 1 end) as n_up, max(row(change, member)) filter (where change > 0) as u, min(row(change, member)) filter (where change < 0) as w from d group by 1)
   select d.tag, d.member, round(d.change, 6)+0.0 as change, case when change > 0 then 'up' when change < 0 then 'down' else 'flat' end as direction, case when n_down = 0 then 'rising' when n_up = 0 then 'falling' else 'mixed' end as shape,
   n_up, n_down, coalesce(row(change, member) = u, false) as is_top_up, coalesce(row(change, member) = w, false) as is_top_down from d join g on d.tag = g.tag""")
def _(t):
    m = P.dimension_movers(P.funnel_wow(t.panel_between(MONTH, END), END), "pay_dau_wow")
    return m.withColumn("change", r("change"))


@query("k21_panel_qc", f"""with {PANEL_SQL}, w as (select tag, member, {WEEK_SQL} as wk, avg(uv_all) u, avg(exp_uv) e, avg(detail_uv) d, avg(pay_pv) p from panel where dt between date '2023-12-04' and date '2024-01-28' group by 1,2,3),
   l as (select *, datediff('day', lag(wk) over (partition by tag, member order by wk), wk) as gap from w), n as (select tag, member, count(*) as c, max(wk) as mx from w group by 1,2)
   select 'stage_order' as "check", count(case when not (e >= d and d >= p) then 1 end) as n_bad, count(*) as n_rows from w
   union all select 'rate_bounds', count(case when d/nullif(u,0) not between 0 and 1 or e/nullif(u,0) not between 0 and 1 then 1 end), count(*) from w
   union all select 'week_spacing', count(case when gap <> 7 then 1 end), count(*) from l
   union all select 'week_count', count(case when c <> 4 then 1 end), count(*) from n
   union all select 'same_latest_week', count(case when mx <> (select max(wk) from w) then 1 end), count(*) from n
   union all select 'month_leak', count(case when strftime(dt,'%Y-%m') > '2024-01' then 1 end), count(*) from panel""")
def _(t):
    return P.panel_qc(t.panel, END, weeks=8, expected_weeks=4, month="2024-01")
