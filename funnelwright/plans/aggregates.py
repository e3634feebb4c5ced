"""Aggregations and window functions."""

from pyspark.sql import Window as W, functions as F

from funnelwright.functions.scalars import in_period, month_key, r, ratio, change
from funnelwright.operators import aggregates as A
from funnelwright.operators import ordered as O
from funnelwright.operators import panel as P
from funnelwright.plans.registry import query
from funnelwright.sources.tables import FUNNEL_EVENTS_SQL, ORDER_PANEL_SQL, PANEL_SQL


@query("g01_conditional_ratio", f"""with {PANEL_SQL} select tag, member, round(sum(case when dt >= date '2024-01-22' then pay_pv else 0 end)/nullif(sum(case when dt >= date '2024-01-22' then uv_all else 0 end),0)::double,6) as week,
   round(sum(case when dt between date '2024-01-15' and date '2024-01-21' then pay_pv else 0 end)/nullif(sum(case when dt between date '2024-01-15' and date '2024-01-21' then uv_all else 0 end),0)::double,6) as prior from panel where dt <= date '2024-01-28' group by 1,2""")
def _(t):
    s = P.window_sums(t.panel, ["tag", "member"], ["pay_pv", "uv_all"], P.kpi_periods("2024-01-28"))
    return s.select("tag", "member", r(ratio("pay_pv_week", "uv_all_week")).alias("week"), r(ratio("pay_pv_prior", "uv_all_prior")).alias("prior"))


@query("g02_per_day_average", """select o_orderstatus, round(count(case when o_orderdate < date '1997-01-01' then 1 end)/count(distinct case when o_orderdate < date '1997-01-01' then o_orderdate end)::double,6) as per_day from orders group by 1""")
def _(t):
    return A.per_day_average(t.orders, ["o_orderstatus"], "o_orderdate", F.col("o_orderdate") < "1997-01-01").select("o_orderstatus", r("per_day").alias("per_day"))


@query("g03_ratio_of_averages", f"with {PANEL_SQL} select member, round(avg(pay_pv)/avg(uv_all),6) as ratio_of_means, round(avg(pay_pv/uv_all::double),6) as mean_of_ratios from panel where tag='source' group by 1")
def _(t):
    return t.panel.where("tag = 'source'").groupBy("member").agg(r(ratio(F.avg("pay_pv"), F.avg("uv_all"))).alias("ratio_of_means"), r(F.avg(ratio("pay_pv", "uv_all"))).alias("mean_of_ratios"))


@query("g04_distinct_users", "select cast(ts as date) as dt, count(distinct user_id) as users, count(distinct case when event_type='purchase' then event_id end) as orders from events group by 1")
def _(t):
    e = t.events
    return A.distinct_by_stage(e.select(F.to_date("ts").alias("dt"), "user_id", "event_type"), ["dt"], "user_id", F.col("event_type") == "purchase")


@query("g05_grouping_sets", """select case when grouping(p_type)=1 then 'overall' else p_type end as category, l_returnflag, count(distinct l_orderkey) as orders, round(sum(l_quantity),2) as qty
   from lineitem join part on l_partkey=p_partkey group by grouping sets ((l_returnflag, p_type), (l_returnflag))""")
def _(t):
    j = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return A.with_overall(j, ["l_returnflag"], "p_type", "category", "l_orderkey", {"qty": "l_quantity"}).select("category", "l_returnflag", F.col("n_distinct").alias("orders"), r("qty", 2).alias("qty"))


@query("g06_rollup_members", f"with {PANEL_SQL} select dt, sum(uv_all)::bigint as uv_all, sum(pay_pv)::bigint as pay_pv from panel where tag='source' and member in ('Z1','Z3') group by 1")
def _(t):
    return P.rollup_members(t.panel, "source", ["Z1", "Z3"], "Z1+Z3").select("dt", "uv_all", "pay_pv")


@query("g07_single_dimension_cube", """select case when grouping(l_returnflag)=0 then 'returnflag' when grouping(l_linestatus)=0 then 'linestatus' when grouping(l_linenumber)=0 then 'linenumber' else 'overall' end as tag,
   coalesce(l_returnflag, l_linestatus, l_linenumber::varchar, 'overall') as member, count(*) as n, round(sum(l_extendedprice),2) as amount from lineitem group by grouping sets ((), (l_returnflag), (l_linestatus), (l_linenumber))""")
def _(t):
    return A.single_dimension_cube(t.lineitem, {"returnflag": "l_returnflag", "linestatus": "l_linestatus", "linenumber": "l_linenumber"}, [F.count("*").alias("n"), r(F.sum("l_extendedprice"), 2).alias("amount")])


@query("g08_window_totals", f"with {PANEL_SQL} select member, count(distinct case when dt between date '2024-01-02' and date '2024-01-10' then dt end) as days_pre, sum(case when dt between date '2024-01-02' and date '2024-01-10' then uv_all else 0 end)::bigint as uv_all_pre, count(distinct case when dt between date '2024-01-11' and date '2024-01-22' then dt end) as days_post, sum(case when dt between date '2024-01-11' and date '2024-01-22' then uv_all else 0 end)::bigint as uv_all_post from panel where tag='scene' and dt between date '2024-01-02' and date '2024-01-22' group by 1")
def _(t):
    return P.window_sums(t.panel.where("tag = 'scene'"), ["member"], ["uv_all"], {"pre": ("2024-01-02", "2024-01-10"), "post": ("2024-01-11", "2024-01-22")})


QS = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
Q_SQL = ", ".join(f"round(quantile_cont({{c}}, {p}),6) as {n}" for n, p in QS.items())


@query("g09_quantiles", f"select l_returnflag, {Q_SQL.format(c='l_extendedprice')} from lineitem group by 1")
def _(t):
    q = O.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", QS)
    return q.select("l_returnflag", *[r(c).alias(c) for c in QS])


@query("g09_quantiles_split", f"select {Q_SQL.format(c='o_totalprice')} from orders")
def _(t):
    return O.quantiles(t.orders, [], "o_totalprice", QS, accuracy=100).select(*[r(c).alias(c) for c in QS])


@query("g10_moments", """with m as (select c_mktsegment as seg, count(*)::double as n, avg(c_acctbal) as mean, stddev_samp(c_acctbal) as sd, skewness(c_acctbal) as g1, kurtosis(c_acctbal) as g2 from customer group by 1)
   select seg, round(mean,6) as mean, round(sd,6) as sd, round(g1,6)+0.0 as skew_corrected, round(g2,6)+0.0 as kurt_corrected, round(g1*(n-2)/sqrt(n*(n-1)),6)+0.0 as skew_biased from m""")
def _(t):
    return A.moments(t.customer, ["c_mktsegment"], "c_acctbal").select(F.col("c_mktsegment").alias("seg"), *[r(c).alias(c) for c in ("mean", "sd", "skew_corrected", "kurt_corrected", "skew_biased")])


@query("g11_weighted_mean", """select coalesce(l_returnflag,'overall') as segment, round(sum(l_discount*l_quantity)/sum(l_quantity),8) as weighted, round(avg(l_discount),8) as unweighted from lineitem where l_quantity > 0 group by grouping sets ((l_returnflag),())""")
def _(t):
    return A.weighted_mean(t.lineitem, "l_discount", "l_quantity", "l_returnflag").select("segment", r("weighted", 8).alias("weighted"), r("unweighted", 8).alias("unweighted"))


@query("g12_most_common", "select p_name, count(*) as n from part group by 1 order by n desc, p_name limit 5")
def _(t):
    return A.most_common(t.part, "p_name", 5)


@query("g13_two_most_frequent", "select o_orderpriority as value, count(*) as n from orders group by 1 order by n desc, value limit 2")
def _(t):
    return A.most_common(t.orders.select(F.col("o_orderpriority").alias("value")), "value", 2)


@query("g14_contingency", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1,2")
def _(t):
    return A.contingency(t.orders, "o_orderstatus", "o_orderpriority")


@query("g15_histogram", """with b as (select min(value) as lo, max(value) as hi from events), x as (select least(cast(floor((value-lo)/((hi-lo)/20.0)) as integer), 19) as bin from events, b) select bin, count(*) as n from x group by 1""")
def _(t):
    return A.histogram(t.events, "value", 20).select("bin", "n")


# --- windows -------------------------------------------------------------------

@query("w01_share_of_partition", f"with {PANEL_SQL}, w as (select tag, member, sum(pay_pv)::double as v from panel where tag <> 'overall' group by 1,2) select tag, member, round(v/sum(v) over (partition by tag),6) as share from w")
def _(t):
    w = t.panel.where("tag <> 'overall'").groupBy("tag", "member").agg(F.sum("pay_pv").alias("v"))
    return w.select("tag", "member", r(A.share_of("v", ["tag"])).alias("share"))


MONTHLY = "m as (select o_orderstatus as s, date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as v, count(*) as n from orders group by 1,2)"


def monthly(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("s"), F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))


@query("w02_previous_change", f"with {MONTHLY} select s, m, round((v-lag(v) over w)/nullif(abs(lag(v) over w),0),6)+0.0 as chg, datediff('day', lag(m) over w, m) as gap from m window w as (partition by s order by m)")
def _(t):
    d = A.with_previous(monthly(t), ["s"], "m", ["v", "m"])
    return d.select("s", "m", r(ratio(F.col("v") - F.col("prev_v"), F.abs("prev_v"))).alias("chg"), F.datediff("m", "prev_m").cast("long").alias("gap"))


@query("w03_trailing_moving", f"""with {MONTHLY} select s, m, case when count(v) over w >= 2 then round(avg(v) over w,4) end as mean, case when count(v) over w >= 2 then round(stddev_samp(v) over w,2) end as sd from m window w as (partition by s order by m rows between 6 preceding and current row)""")
def _(t):
    return A.moving(monthly(t), "v", ["s"], "m", 7, 2).select("s", "m", r("moving_mean", 4).alias("mean"), r("moving_sd", 2).alias("sd"))


@query("w04_prior_window_z", f"""with {MONTHLY}, z as (select s, m, n, avg(n) over w as mu, stddev_samp(n) over w as sd, count(n) over w as c from m window w as (partition by s order by m rows between 7 preceding and 1 preceding))
   select s, m, case when c = 7 and sd > 0 then round((n-mu)/sd,6)+0.0 end as z from z""")
def _(t):
    return A.prior_z(monthly(t), "n", ["s"], "m", 7).select("s", "m", r("z").alias("z"))


@query("w05_running_share", """with d as (select cast(o_orderdate as date) as dt, count(*) as n from orders group by 1) select dt, sum(n) over (order by dt)::bigint as cum, round(sum(n) over (order by dt)/(select sum(n) from d)::double,6) as share from d""")
def _(t):
    d = t.orders.groupBy(F.col("o_orderdate").alias("dt")).agg(F.count("*").alias("n"))
    run = O.running(d, [], ["dt"], sums={"cum": "n"})
    return run.withColumn("total", d.agg(F.sum("n").alias("x")).scalar()).select("dt", "cum", r(ratio("cum", "total")).alias("share"))


@query("w06_rank", "with c as (select c_mktsegment as seg, c_nationkey as nk, sum(c_acctbal) as bal from customer group by 1,2) select seg, nk, rank() over (partition by seg order by bal desc) as rnk, row_number() over (partition by seg order by bal desc, nk) as rn from c")
def _(t):
    c = t.customer.groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nk")).agg(F.sum("c_acctbal").alias("bal"))
    w = W.partitionBy("seg").orderBy(F.desc("bal"))
    return c.select("seg", "nk", F.rank().over(w).cast("long").alias("rnk"), F.row_number().over(W.partitionBy("seg").orderBy(F.desc("bal"), "nk")).cast("long").alias("rn"))


@query("w07_average_rank", "with c as (select l_quantity as v, count(*) as n from lineitem group by 1) select v, n, sum(n) over (order by v) - (n-1)/2.0::double as avg_rank from c")
def _(t):
    return O.average_ranks(t.lineitem, [], "l_quantity").select("v", "n", "avg_rank")


@query("w08_run_length", f"""with {MONTHLY}, f as (select s, m, case when n > avg(n) over (partition by s) then 1 else 0 end as f from m)
   select s, m, sum(f) over (partition by s order by m rows between 2 preceding and current row)::bigint as of3, sum(f) over (partition by s order by m rows between 4 preceding and current row)::bigint as of5, sum(f) over (partition by s order by m rows between 7 preceding and current row)::bigint as of8 from f""")
def _(t):
    f = monthly(t).withColumn("f", (F.col("n") > F.avg("n").over(W.partitionBy("s"))).cast("int"))
    return A.run_length(f, "f", ["s"], "m", (3, 5, 8)).select("s", "m", "of3", "of5", "of8")


@query("w09_islands_and_gaps", """with d as (select distinct o_custkey % 40 as k, cast(o_orderdate as date) as dt from orders), g as (select k, dt, dt - cast(row_number() over (partition by k order by dt) as integer) as grp from d)
   select k, min(dt) as island_start, max(dt) as island_end, count(*) as days from g group by k, grp""")
def _(t):
    d = t.orders.select((F.col("o_custkey") % 40).alias("k"), F.col("o_orderdate").alias("dt")).distinct()
    return A.islands(d, ["k"], "dt")


@query("w10_session_position", "select event_id, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as pos, count(*) over (partition by user_id, cast(ts as date)) as size from events")
def _(t):
    return A.position_in_group(t.events.withColumn("dt", F.to_date("ts")), ["user_id", "dt"], ["ts", "event_id"]).select("event_id", "pos", "size")


@query("w11_first_value", "select user_id, arg_min(event_type, ts) as first_type, min(ts)::date as first_day, arg_max(event_type, ts) as last_type from events group by 1")
def _(t):
    return A.first_per_group(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", F.col("first_event_type").alias("first_type"), F.to_date("first_ts").alias("first_day"), F.col("last_event_type").alias("last_type"))


@query("w12_ordinal_violations", f"""with {MONTHLY}, l as (select s, m, n < lag(n) over (partition by s order by m) as bad from m) select s, count(case when bad then 1 end) as violations, min(case when bad then m end) as first_violation from l group by 1""")
def _(t):
    return A.ordinal_violations(monthly(t), ["s"], "m", "n")
