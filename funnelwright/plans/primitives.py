"""Projections, predicates, joins, sets, sorts and scalar functions."""

from pyspark.sql import Window as W, functions as F

from funnelwright.functions import scalars as S
from funnelwright.functions.scalars import r, ratio
from funnelwright.operators import panel as P
from funnelwright.operators import relations as R
from funnelwright.plans.registry import query
from funnelwright.sources.tables import ORDER_PANEL_SQL, PANEL_SQL

RATES_SQL = """round(pay_pv/nullif(uv_all,0)::double,6) as pay_dau, round(pay_pv/nullif(detail_uv,0)::double,6) as pay_detail,
 round(detail_uv/nullif(uv_all,0)::double,6) as detail_dau, round(exp_uv/nullif(uv_all,0)::double,6) as exp_dau,
 round(detail_uv/nullif(exp_uv,0)::double,6) as detail_exp, round(order_uv/nullif(detail_uv,0)::double,6) as order_detail,
 round(pay_pv/nullif(order_uv,0)::double,6) as pay_order, round(pay_pv/nullif(exp_uv,0)::double,6) as pay_exp,
 round(exp_pv/nullif(exp_uv,0)::double,6) as pv_per_user"""
RATE_COLS = [*P.RATES, "pv_per_user"]


@query("p01_add_funnel_rates", f"with {PANEL_SQL} select tag, member, dt, {RATES_SQL} from panel")
def _(t):
    return P.add_funnel_rates(t.panel).select("tag", "member", "dt", *[r(c).alias(c) for c in RATE_COLS])


@query("p02_map_category", """with m as (select p_partkey, case when p_type in ('ECONOMY') then 'value' when p_type in ('PROMO','STANDARD') then 'core'
   when p_type like '%LARGE%' then 'large' end as category from part) select category, count(*) as n from m where category is not null group by 1""")
def _(t):
    c = S.map_category([(F.col("p_type").isin("ECONOMY"), "value"), (F.col("p_type").isin("PROMO", "STANDARD"), "core"), (F.col("p_type").like("%LARGE%"), "large")])
    return t.part.withColumn("category", c).where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query("p03_member_filters", """select p_brand, count(*) as n from part where p_brand <> 'Brand#1' and (p_name like '%ring%' or p_name like '%widget%')
   and p_type in ('ECONOMY','PROMO') group by 1""")
def _(t):
    d = t.part.where((F.col("p_brand") != "Brand#1") & S.like_any("p_name", ["%ring%", "%widget%"]) & F.col("p_type").isin("ECONOMY", "PROMO"))
    return d.groupBy("p_brand").agg(F.count("*").alias("n"))


@query("p04_bucketise", """select case when o_totalprice < 50000 then '<50k' when o_totalprice < 150000 then '50-150k' when o_totalprice < 300000 then '150-300k' else '300k+' end as bucket,
   count(*) as n from orders group by 1""")
def _(t):
    b = S.bucketise("o_totalprice", [50000, 150000, 300000], ["<50k", "50-150k", "150-300k", "300k+"])
    return t.orders.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("p05_cap_outlier", "select event_type, round(avg(least(value, 400.0)),6) as mean_capped, count(case when value > 400 then 1 end) as n_capped from events group by 1")
def _(t):
    capped, flag = R.cap_outlier("value", 400.0)
    return t.events.groupBy("event_type").agg(r(F.avg(capped)).alias("mean_capped"), F.count(F.when(flag, 1)).alias("n_capped"))


@query("p06_disjunctive_windows", """select date_trunc('month', o_orderdate)::date as m, count(*) as n from orders
   where (o_orderdate between date '1998-05-04' and date '1998-06-28') or (o_orderdate between date '1997-05-05' and date '1997-06-29') group by 1""")
def _(t):
    end = "1998-06-28"
    cond = R.two_year_windows("o_orderdate", end, 8)
    return t.raw("orders").where(cond).groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("m")).agg(F.count("*").alias("n"))


@query("p07_align_partial_month", """select strftime(o_orderdate,'%Y-%m') as month, count(*) as n from orders where o_orderdate between date '1997-01-01' and date '1998-06-19'
   and not (strftime(o_orderdate,'%Y-%m') = '1997-06' and day(o_orderdate) > 19) group by 1""")
def _(t):
    d = R.align_partial_month(t.orders_between("1997-01-01", "1998-06-19"), "o_orderdate", "1998-06-19")
    return d.groupBy(S.month_key("o_orderdate").alias("month")).agg(F.count("*").alias("n"))


@query("p08_transpose_metrics", f"""with {PANEL_SQL}, w as (select (dt - cast((dt - date '1970-01-05') % 7 as integer)) as wk, sum(uv_all)::double as uv_all, sum(pay_pv)::double as pay_pv from panel where tag='overall' group by 1)
   select 'uv_all' as metric, max(case when wk = date '2024-01-01' then uv_all end) as "2024-01-01", max(case when wk = date '2024-01-08' then uv_all end) as "2024-01-08", max(case when wk = date '2024-01-15' then uv_all end) as "2024-01-15" from w
   union all select 'pay_pv', max(case when wk = date '2024-01-01' then pay_pv end), max(case when wk = date '2024-01-08' then pay_pv end), max(case when wk = date '2024-01-15' then pay_pv end) from w""")
def _(t):
    w = t.panel.where("tag = 'overall'").groupBy(S.week_start("dt").cast("string").alias("wk")).agg(F.sum("uv_all").alias("uv_all"), F.sum("pay_pv").alias("pay_pv"))
    return R.transpose_metrics(w, "wk", ["uv_all", "pay_pv"], ["2024-01-01", "2024-01-08", "2024-01-15"])


@query("p09_to_long_lines", """select l_returnflag, 'quantity' as line, round(sum(l_quantity),2) as total, count(case when l_quantity > 25 then 1 end) as n_high from lineitem group by 1
   union all select l_returnflag, 'discount', round(sum(l_discount),2), count(case when l_discount > 0.05 then 1 end) from lineitem group by 1""")
def _(t):
    groups = {"quantity": {"v": F.col("l_quantity"), "hit": F.col("l_quantity") > 25}, "discount": {"v": F.col("l_discount"), "hit": F.col("l_discount") > 0.05}}
    d = S.stack_groups(t.lineitem, ["l_returnflag"], groups, "line")
    return d.groupBy("l_returnflag", "line").agg(r(F.sum("v"), 2).alias("total"), F.count(F.when(F.col("hit"), 1)).alias("n_high"))


@query("p10_eval_metric_expr", """with m as (select o_orderstatus, avg(o_totalprice) as aov, count(*) as orders, count(distinct o_custkey) as buyers from orders group by 1)
   select o_orderstatus, round(aov * orders, 2) as revenue, round(orders / buyers::double, 6) as frequency from m""")
def _(t):
    m = t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("aov"), F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("buyers"))
    names = ["aov", "orders", "buyers"]
    return m.select("o_orderstatus", r(S.metric_expr("aov * orders", names), 2).alias("revenue"), r(S.metric_expr("orders / buyers", names)).alias("frequency"))


@query("p11_scale_sample", "select c_mktsegment, count(*) as n, round(count(*) * 1.115, 3)::double as scaled from customer group by 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("scaled", r(R.scale_sample("n", 1.115), 3))


# --- joins -------------------------------------------------------------------

@query("j01_item_pool_join", """select p_brand, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join part on l_partkey = p_partkey
   where p_type = 'PROMO' and p_size <= 20 group by 1""")
def _(t):
    pool = t.part.where("p_type = 'PROMO' and p_size <= 20").select("p_partkey", "p_brand")
    j = R.join_dimension(t.lineitem, pool, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.count("*").alias("n"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("j02_left_join_blocks", """select c.c_mktsegment, count(*) as customers, count(o.o_custkey) as with_orders, coalesce(sum(o.n),0)::bigint as orders from customer c
   left join (select o_custkey, count(*) as n from orders where o_orderstatus='P' group by 1) o on c.c_custkey = o.o_custkey group by 1""")
def _(t):
    o = t.orders.where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = t.customer.join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.count("o_custkey").alias("with_orders"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("j03_full_outer_stages", """with v as (select user_id, count(*) n from events where event_type='view' group by 1), c as (select user_id, count(*) n from events where event_type='click' group by 1),
   s as (select user_id, count(*) n from events where event_type='signup' group by 1), p as (select user_id, count(*) n from events where event_type='purchase' group by 1)
   select user_id, coalesce(v.n,0) as exp, coalesce(c.n,0) as detail, coalesce(s.n,0) as "order", coalesce(p.n,0) as pay from v full join c using (user_id) full join s using (user_id) full join p using (user_id)""")
def _(t):
    e = t.events
    frames = {name: e.where(F.col("event_type") == et).groupBy("user_id").agg(F.count("*").alias("n")) for et, name in (("view", "exp"), ("click", "detail"), ("signup", "order"), ("purchase", "pay"))}
    return R.align_stages(frames, ["user_id"], "n")


@query("j04_attach_scalar", f"with {PANEL_SQL} select member, dt, uv_all, (select sum(uv_all) from panel where tag='overall')::bigint as overall_uv from panel where tag='source'")
def _(t):
    total = t.panel.where("tag = 'overall'").agg(F.sum("uv_all").alias("x"))
    return R.attach_scalar(t.panel.where("tag = 'source'").select("member", "dt", "uv_all"), total, "overall_uv")


@query("j05_week_key_join", f"""with {PANEL_SQL}, w as (select (dt - cast((dt - date '1970-01-05') % 7 as integer)) as week_start, tag, member, avg(uv_all) as uv from panel group by 1,2,3)
   select a.week_start, a.member, round(a.uv,6) as uv, round(b.uv,6) as overall_uv, round(a.uv/b.uv,6) as share from w a left join w b on a.week_start=b.week_start and b.tag='overall' where a.tag='terminal'""")
def _(t):
    w = t.panel.groupBy(S.week_start("dt").alias("week_start"), "tag", "member").agg(F.avg("uv_all").alias("uv"))
    o = w.where("tag = 'overall'").select("week_start", F.col("uv").alias("overall_uv"))
    j = w.where("tag = 'terminal'").join(o, "week_start", "left")
    return j.select("week_start", "member", r("uv").alias("uv"), r("overall_uv").alias("overall_uv"), r(ratio("uv", "overall_uv")).alias("share"))


@query("j06_yoy_self_join", """with d as (select cast(o_orderdate as date) as dt, count(*) as n from orders where o_orderdate between date '1997-01-01' and date '1998-12-31' group by 1)
   select a.dt, a.n, b.n as n_last, round((a.n-b.n)/b.n::double,6) as yoy from d a join d b on year(a.dt)=1998 and year(b.dt)=1997 and strftime(a.dt,'%m-%d')=strftime(b.dt,'%m-%d')""")
def _(t):
    d = t.orders_between("1997-01-01", "1998-12-31").groupBy(F.col("o_orderdate").alias("dt")).agg(F.count("*").alias("n"))
    return R.yoy_join(d, "dt", ["n"], 1998).select("dt", "n", "n_last", r(S.change("n", "n_last")).alias("yoy"))


@query("j07_interval_join", """with a as (select user_id, min(ts) as t0 from events where event_type='signup' group by 1)
   select e.event_type, count(*) as n, count(distinct e.user_id) as users from events e join a on e.user_id=a.user_id and e.ts between a.t0 and a.t0 + interval 7 day group by 1""")
def _(t):
    a = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    j = R.interval_join(t.events, a.withColumn("t1", F.col("t0") + F.expr("interval 7 days")), ["user_id"], "ts", "t0", "t1")
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("j08_anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority='1-URGENT')")
def _(t):
    return R.orphans(t.customer, t.orders.where("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey").select("c_custkey")


@query("j09_semi_join_flag", """with u as (select user_id, max(case when event_type='error' and value > 480 then 1 else 0 end) = 1 as ever, sum(value) as v from events group by 1)
   select ever, count(*) as users, round(avg(v),4) as mean_value from u group by 1""")
def _(t):
    u = R.ever_flag(t.events, "user_id", (F.col("event_type") == "error") & (F.col("value") > 480), "ever", F.sum("value").alias("v"))
    return u.groupBy("ever").agg(F.count("*").alias("users"), r(F.avg("v"), 4).alias("mean_value"))


@query("j10_set_overlap", """select count(*) as n_distinct, count(case when l_partkey in (select p_partkey from part where p_size > 25) then 1 end) as n_found,
   round(count(case when l_partkey in (select p_partkey from part where p_size > 25) then 1 end)/count(*)::double, 6) as overlap from (select distinct l_partkey from lineitem)""")
def _(t):
    return R.set_overlap(t.lineitem, "l_partkey", t.part.where("p_size > 25"), "p_partkey").select("n_distinct", "n_found", r("overlap").alias("overlap"))


@query("j11_detail_vs_summary", """with d as (select l_orderkey as k, sum(l_extendedprice) as v from lineitem group by 1) select coalesce(d.k, o.o_orderkey) as k, round(d.v,2) as detail, round(o.o_totalprice,2) as summary,
   round(d.v - o.o_totalprice,2)+0.0 as diff from d full join orders o on d.k=o.o_orderkey""")
def _(t):
    j = R.detail_vs_summary(t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v")), t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")), ["k"], "v")
    return j.select("k", r("detail", 2).alias("detail"), r("summary", 2).alias("summary"), r("diff", 2).alias("diff"))


@query("j12_pair_join", """with s as (select c_mktsegment as seg, avg(c_acctbal) as m from customer group by 1)
   select a.seg as seg_a, b.seg as seg_b, round(b.m - a.m, 4)+0.0 as diff from s a join s b on a.seg < b.seg""")
def _(t):
    s = t.customer.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.avg("c_acctbal").alias("m"))
    return R.pairs(s, "seg", ["m"]).select("seg_a", "seg_b", r(F.col("m_b") - F.col("m_a"), 4).alias("diff"))


# --- sorts, limits, top-k ------------------------------------------------------

@query("o01_order_limit", "select o_custkey, round(sum(o_totalprice),2) as total from orders group by 1 order by total desc, o_custkey limit 20")
def _(t):
    return t.orders.groupBy("o_custkey").agg(r(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey").limit(20)


@query("o02_custom_sort_key", f"""with {PANEL_SQL} select member, cast(regexp_extract(member,'[Zz]\\s*(\\d+)',1) as integer) as rank_key, sum(uv_all)::bigint as uv from panel where tag='source' group by 1,2""")
def _(t):
    return t.panel.where("tag = 'source'").groupBy("member").agg(F.sum("uv_all").alias("uv")).withColumn("rank_key", S.tier_rank("member")).orderBy("rank_key", "member")


@query("o03_topk_abs_change", """with m as (select o_orderstatus as s, o_orderpriority as p, sum(case when year(o_orderdate)=1997 then o_totalprice else 0 end) as a, sum(case when year(o_orderdate)=1998 then o_totalprice else 0 end) as b from orders group by 1,2),
   k as (select *, row_number() over (partition by s order by abs(b-a) desc, p) as rn from m) select s, p, round(b-a,2)+0.0 as change, rn from k where rn <= 2""")
def _(t):
    m = t.orders.groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).agg(
        *[F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")).otherwise(0.0)).alias(n) for n, y in (("a", 1997), ("b", 1998))])
    k = R.top_k(m.withColumn("change", F.col("b") - F.col("a")), ["s"], [F.desc(F.abs("change")), F.col("p")], 2)
    return k.select("s", "p", r("change", 2).alias("change"), F.col("rn"))


@query("o04_top_share_cut", """with e as (select o_custkey as k, sum(o_totalprice) as v from orders group by 1), x as (select *, row_number() over (order by v desc, k) as rn, count(*) over () as n, sum(v) over () as tot from e)
   select k, round(v,2) as v from x where rn <= ceil(n * 0.05)""")
def _(t):
    e = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    return R.top_share(e, "k", "v", 0.05).select("k", r("v", 2).alias("v"))


@query("o05_bounded_samples", """with x as (select o_orderpriority as p, o_orderkey as k, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders where o_totalprice > 400000)
   select p, string_agg(k::varchar, ',' order by k) as sample, (select count(*) from orders o where o.o_orderpriority = x.p and o_totalprice > 400000) as n from x where rn <= 5 group by p""")
def _(t):
    d = t.orders.where("o_totalprice > 400000").select(F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("k"))
    return R.bounded_samples(d, ["p"], "k", 5).select("p", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"), "n")


# --- sets ------------------------------------------------------------------------

@query("u01_union_all", "select 'nation' as src, n_name as name from nation union all select 'region', r_name from region")
def _(t):
    return t.nation.select(F.lit("nation").alias("src"), F.col("n_name").alias("name")).unionByName(t.region.select(F.lit("region").alias("src"), F.col("r_name").alias("name")))


@query("u02_distinct", "select distinct l_returnflag, l_linestatus from lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("u03_except_both_ways", """(select 'only_a' as side, v from (select distinct o_custkey as v from orders where o_orderstatus='F' except select distinct o_custkey from orders where o_orderstatus='P'))
   union all (select 'only_b', v from (select distinct o_custkey as v from orders where o_orderstatus='P' except select distinct o_custkey from orders where o_orderstatus='F'))""")
def _(t):
    o = t.orders.withColumnRenamed("o_custkey", "v")
    return R.set_difference(o.where("o_orderstatus = 'F'").select("v"), o.where("o_orderstatus = 'P'").select("v"), "v")


@query("u04_intersect", "select distinct month(o_orderdate) as m from orders where year(o_orderdate)=1995 intersect select distinct month(o_orderdate) from orders where year(o_orderdate)=2001")
def _(t):
    m = F.month("o_orderdate").cast("long").alias("m")
    return t.orders.where(F.year("o_orderdate") == 1995).select(m).intersect(t.orders.where(F.year("o_orderdate") == 2001).select(m))


@query("u05_dedup_events", """with d as (select * from events union all select * from events where event_id % 7 = 0) select event_type, count(*) as n, round(sum(value),2) as v from (select * from d qualify row_number() over (partition by event_id order by ts) = 1) group by 1""")
def _(t):
    d = t.events.unionByName(t.events.where("event_id % 7 = 0"))
    return R.dedup_first(d, ["event_id"], ["ts"]).groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("v"))


# --- scalar functions --------------------------------------------------------------

@query("f01_week_key", "select distinct cast(o_orderdate as date) as dt, date_trunc('week', o_orderdate)::date as week_start, (date_trunc('week', o_orderdate) + interval 6 day)::date as week_end from orders")
def _(t):
    return t.orders.select(F.col("o_orderdate").alias("dt"), S.week_start("o_orderdate").alias("week_start"), S.week_end("o_orderdate").alias("week_end")).distinct()


@query("f02_date_shift", """select distinct cast(o_orderdate as date) as dt, (o_orderdate - interval 6 day)::date as d6, (o_orderdate - interval 364 day)::date as d364, (o_orderdate - interval 1 month)::date as prev_month,
   (o_orderdate - interval 12 month)::date as last_year, datediff('day', date '1995-01-01', cast(o_orderdate as date)) as age from orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(d.alias("dt"), F.date_sub(d, 6).alias("d6"), F.date_sub(d, 364).alias("d364"), F.add_months(d, -1).alias("prev_month"), F.add_months(d, -12).alias("last_year"),
                           F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("age")).distinct()


@query("f03_date_parts", """select distinct cast(o_orderdate as date) as dt, strftime(o_orderdate,'%Y-%m') as month, day(o_orderdate) as day, isodow(o_orderdate)-1 as weekday, dayname(o_orderdate) as day_name, quarter(o_orderdate) as quarter,
   isodow(o_orderdate + interval 3 day)-1 as weekday_plus3 from orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(d.alias("dt"), S.month_key(d).alias("month"), F.day(d).cast("long").alias("day"), F.weekday(d).cast("long").alias("weekday"), F.date_format(d, "EEEE").alias("day_name"),
                           F.quarter(d).cast("long").alias("quarter"), F.weekday(F.date_add(d, 3)).cast("long").alias("weekday_plus3")).distinct()


@query("f04_portable_helpers", """select date_trunc('month', o_orderdate)::date as m, max(datediff('day', o_orderdate, date '2002-01-01')) as max_age, round(sum(o_totalprice)/nullif(count(case when o_orderstatus='P' then 1 end),0),6) as safe_div,
   string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as statuses from orders group by 1""")
def _(t):
    return t.orders.groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("m")).agg(
        F.max(F.expr("timestampdiff(DAY, o_orderdate, date'2002-01-01')")).alias("max_age"),
        r(ratio(F.sum("o_totalprice"), F.count(F.when(F.col("o_orderstatus") == "P", 1))), 6).alias("safe_div"),
        F.expr("listagg(distinct o_orderstatus, ',') within group (order by o_orderstatus)").alias("statuses"))


@query("f05_numeric", """select l_linenumber, round(avg(l_extendedprice),2) as rounded, cast(trunc(avg(l_extendedprice)) as bigint) as truncated, cast(ceil(avg(l_quantity)) as bigint) as up, round(sqrt(sum(l_quantity)),6) as root, ((l_linenumber - 9) % 7 + 7) % 7 as mod7 from lineitem group by 1""")
def _(t):
    return t.lineitem.groupBy("l_linenumber").agg(r(F.avg("l_extendedprice"), 2).alias("rounded"), F.avg("l_extendedprice").cast("long").alias("truncated"), F.ceil(F.avg("l_quantity")).alias("up"), r(F.sqrt(F.sum("l_quantity"))).alias("root")) \
        .withColumn("mod7", F.pmod(F.col("l_linenumber") - 9, F.lit(7)))


@query("f06_null_handling", """select c_mktsegment, count(nullif(c_acctbal > 0, false)) as n_pos, round(sum(coalesce(case when c_acctbal > 0 then c_acctbal end, 0)),2) as pos_total, round(sum(c_acctbal)/nullif(count(case when c_acctbal > 99999 then 1 end),0),4) as no_div from customer group by 1""")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(
        F.count(F.nullif(F.col("c_acctbal") > 0, F.lit(False))).alias("n_pos"),
        r(F.sum(F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(0.0))), 2).alias("pos_total"),
        r(ratio(F.sum("c_acctbal"), F.count(F.when(F.col("c_acctbal") > 99999, 1))), 4).alias("no_div"))


@query("f07_string", """select split_part(o_orderpriority,'-',1) as code, lower(trim(o_orderpriority)) as label, max(length(o_orderpriority)) as len, round(count(*) * 100.0 / (select count(*) from orders), 2)::varchar as pct_text from orders group by 1,2""")
def _(t):
    n = t.orders.agg(F.count("*").alias("n"))
    g = t.orders.groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code"), F.lower(F.trim("o_orderpriority")).alias("label")).agg(F.max(F.length("o_orderpriority")).cast("long").alias("len"), F.count("*").alias("c"))
    return R.attach_scalar(g, n, "n").select("code", "label", "len", F.round(F.col("c") * 100.0 / F.col("n"), 2).cast("string").alias("pct_text"))


@query("f08_parse_percent", """with x as (select event_id, value, case when event_id % 11 = 0 then '-' when event_id % 11 = 1 then printf('%.2f', value) else printf('%.2f', value) || '%' end as txt, printf('%.2f', value) || '% (WoW:' || printf('%+.2f', value - 250) || '%)' as cell from events)
   select event_id, case when txt = '-' then null when event_id % 11 = 1 then round(value, 6) else round(value / 100, 6) end as parsed, round(value,2) as cell_value, round(value - 250, 2)+0.0 as cell_change from x""")
def _(t):
    x = t.events.select("event_id", F.when(F.col("event_id") % 11 == 0, "-").when(F.col("event_id") % 11 == 1, F.format_string("%.2f", "value")).otherwise(S.fmt_percent("value")).alias("txt"),
                        F.concat(S.fmt_percent("value"), F.lit(" (WoW:"), S.fmt_signed_percent(F.col("value") - 250), F.lit(")")).alias("cell"))
    v, c = S.parse_value_change("cell")
    return x.select("event_id", r(S.parse_percent("txt")).alias("parsed"), r(v, 2).alias("cell_value"), r(c, 2).alias("cell_change"))


@query("f09_change_rate", """with m as (select year(o_orderdate) as y, sum(case when o_orderstatus='P' and month(o_orderdate) < 3 then 1 else 0 end) as n from orders group by 1)
   select a.y, round((a.n-b.n)/nullif(b.n,0)::double*100,6) as pct from m a left join m b on b.y=a.y-1""")
def _(t):
    m = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(F.when((F.col("o_orderstatus") == "P") & (F.month("o_orderdate") < 3), 1).otherwise(0)).alias("n"))
    return m.withColumn("_b", F.lag("n").over(W.orderBy("y"))).select("y", r(S.pct_change("n", "_b")).alias("pct"))


@query("f10_format_cell", """with m as (select o_orderstatus as s, count(*) as n, (count(case when year(o_orderdate)=1998 then 1 end) - count(case when year(o_orderdate)=1997 then 1 end)) * 100.0 / count(case when year(o_orderdate)=1997 then 1 end) as c from orders group by 1)
   , x as (select s, 'both' as part, n, c from m union all select s, 'no change', n, null from m union all select s, 'no value', null, c from m)
   select s, part, case when n is null then '-' when c is null then format('{:,}', n) else format('{:,}', n) || ' (' || printf('%+.2f', c) || '%)' end as cell,
     case when n is null then '-' else format('{:,}', n) || ' (' || coalesce(printf('%+.2f', c) || '%', '-') || '｜' || coalesce(printf('%+.2f', c / 2) || '%', '-') || ')' end as cell_dual from x""")
def _(t):
    y = lambda v: F.count(F.when(F.year("o_orderdate") == v, 1))
    m = t.orders.groupBy(F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"), S.pct_change(y(1998), y(1997)).alias("c"))
    part = lambda name, n, c: m.select("s", F.lit(name).alias("part"), n.cast("long").alias("n"), c.cast("double").alias("c"))
    x = part("both", F.col("n"), F.col("c")).unionAll(part("no change", F.col("n"), F.lit(None))).unionAll(part("no value", F.lit(None), F.col("c")))
    return x.select("s", "part", S.fmt_cell(S.fmt_int("n"), F.col("c")).alias("cell"), S.fmt_cell_dual(S.fmt_int("n"), F.col("c"), F.col("c") / 2).alias("cell_dual"))


@query("f11_regex_filter", """with x as (select case when o_orderkey % 5 = 0 then 'n/a' when o_orderkey % 3 = 0 then strftime(o_orderdate,'%Y-%m-%d') else strftime(o_orderdate,'%Y%m%d') end as d, 'Brand tier Z' || (o_custkey % 6) as tier from orders)
   select tier, cast(regexp_extract(tier,'[Zz]\\s*(\\d+)',1) as integer) as tier_no, count(*) as n from x where regexp_full_match(d, '\\d{8}') group by 1,2""")
def _(t):
    d = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    x = t.orders.select(d.alias("d"), F.concat(F.lit("Brand tier Z"), F.col("o_custkey") % 6).alias("tier"))
    return x.where(F.col("d").rlike(r"^\d{8}$")).groupBy("tier").agg(F.count("*").alias("n")).withColumn("tier_no", S.tier_rank("tier"))


@query("f12_lenient_date", """with x as (select 'd' as c, case when o_orderkey % 10 = 0 then 'unknown' else strftime(o_orderdate,'%Y-%m-%d') end as v from orders union all select 's', o_orderstatus from orders)
   select c as column_name, round(count(try_cast(v as date))/count(v)::double,6) as parsed_share, count(try_cast(v as date))/count(v)::double >= 0.8 as is_date from x group by 1""")
def _(t):
    x = t.orders.select(F.when(F.col("o_orderkey") % 10 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"), F.col("o_orderstatus").alias("s"))
    return R.date_parse_share(x, ["d", "s"], 0.8).select("column_name", r("parsed_share").alias("parsed_share"), "is_date")


@query("f13_alias_match", """with w as (select lower(p_name) as nm from part) select entity, round(sum(conf)::double,4) as confidence, count(*) as n from (
   select case when regexp_matches(nm, '\\bsmall ring\\b') then 'SmallRing' when regexp_matches(nm, '\\bring\\b') then 'Ring' when regexp_matches(nm, '\\bwidget\\b') then 'Widget' end as entity,
          case when regexp_matches(nm, '\\bsmall ring\\b') then 1.0 when regexp_matches(nm, '\\bring\\b') then 0.8 when regexp_matches(nm, '\\bwidget\\b') then 1.0 end as conf from w) where entity is not null group by 1""")
def _(t):
    aliases = [("small ring", "SmallRing", 1.0), ("ring", "Ring", 0.8), ("widget", "Widget", 1.0)]
    m = R.alias_matches(t.part.select("p_partkey", "p_name"), "p_name", aliases)
    return m.groupBy("entity").agg(r(F.sum("confidence"), 4).alias("confidence"), F.count("*").alias("n"))


@query("f14_close_names", """with a as (select distinct lower(p_name) as nm from part), b as (select distinct substr(lower(p_name), 1, length(p_name)-1) as q from part),
   m as (select q, nm, levenshtein(q, nm) as d, row_number() over (partition by q order by levenshtein(q, nm), nm) as rn from a join b on levenshtein(q, nm) <= 2) select q, nm as suggestion, d as distance, rn::int as rank from m where rn <= 3""")
def _(t):
    names = t.part.select(F.lower("p_name").alias("nm")).distinct()
    asked = t.part.select(F.expr("substr(lower(p_name), 1, length(p_name) - 1)").alias("q")).distinct()
    return R.close_names(asked, "q", names, "nm", max_distance=2)


@query("f15_array_map_json", """select user_id, count(*) as n, list(distinct event_type order by event_type) as types, sum(cast(json_extract(props,'$.k') as bigint))::bigint as k_sum from events group by 1""")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("types"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))
