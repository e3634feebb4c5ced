"""Validation, reconciliation, paradox and root cause."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import r
from funnelwright.operators import checks as V
from funnelwright.operators import panel as P
from funnelwright.operators import rootcause as RC
from funnelwright.plans.profiling import DIRTY, dirty
from funnelwright.plans.registry import query
from funnelwright.sources.tables import ORDER_PANEL_SQL, PANEL_SQL

OUT = lambda df, keep, cols, digits=6: df.select(*keep, *[r(c, digits).alias(c) for c in cols])


def ck(df):
    return df.select("check", "subject", "ok", "severity", r("observed").alias("observed"), "n_bad")


def sql(check, subject, sev, obs, bad, frm):
    return f"""select '{check}' as "check", '{subject}' as subject, sev='PASS' as ok, sev as severity, round(obs::double,6)+0.0 as observed, bad::bigint as n_bad from (select {sev} as sev, {obs} as obs, {bad} as bad from {frm})"""


def lev(warn, block):
    return f"case when {block} then 'BLOCKER' when {warn} then 'WARNING' else 'PASS' end"


NULLRATE = "(count(*)-count({c}))/count(*)::double"


def comp(c):
    n = NULLRATE.format(c=c)
    return sql("completeness", c, lev(f"{n} >= 0.05", f"{n} > 0.2"), n, f"count(*)-count({c})", "dirty")


@query("v01_check_schema")
def _(t):
    return V.check_schema(t.raw("orders"), {"o_orderkey": "bigint", "o_custkey": "string", "o_totalprice": "decimal(10,2)", "o_region": "string"})


PK = "(select count(*) filter (where n>1 and o_custkey is not null) d, coalesce(sum(n) filter (where o_custkey is null),0) nl from (select o_orderkey, o_custkey, count(*) n from dirty group by 1,2))"


@query("v02_primary_key", f"with {DIRTY} " + sql("primary_key", "o_orderkey,o_custkey", lev("false", "d+nl>0"), "d", "d+nl", PK))
def _(t):
    return ck(V.check_primary_key(dirty(t), ["o_orderkey", "o_custkey"]))


@query("v03_duplicates", f"""with {DIRTY}, k as (select o_orderkey, count(*) n from dirty group by 1 having count(*)>1) select 'duplicates' as "check", 'o_orderkey' as subject, sum(n) is null as ok, case when sum(n)>0 then 'BLOCKER' else 'PASS' end as severity, count(*)::double as observed, coalesce(sum(n),0)::bigint as n_bad, (select string_agg(s, ';' order by s) from (select o_orderkey::varchar s from k order by o_orderkey limit 5)) as detail from k""")
def _(t):
    d = V.check_duplicates(dirty(t), ["o_orderkey"])
    return d.select("check", "subject", "ok", "severity", r("observed").alias("observed"), "n_bad", "detail")


@query("v04_completeness", f"with {DIRTY} " + " union all ".join(comp(c) for c in ("o_orderkey", "o_custkey", "shipped")))
def _(t):
    return ck(V.scan_checks(dirty(t), [V.completeness(c) for c in ("o_orderkey", "o_custkey", "shipped")]))


@query("v05_date_range", sql("date_range", "dt", lev("b>0", "false"), "w", "b", """(select (case when min(dt)<>date '1995-01-01' then 1 else 0 end)+(case when max(dt)<>date '2001-08-01' then 1 else 0 end)+count(case when g>2 then 1 end) b, max(g) w from (select dt, datediff('day', lag(dt) over (order by dt), dt) g from (select distinct cast(o_orderdate as date) dt from orders)))"""))
def _(t):
    return ck(V.check_date_range(t.orders.withColumnRenamed("o_orderdate", "dt"), "dt", "1995-01-01", "2001-08-01", 2))


@query("v06_referential", sql("referential", "l_partkey->p_partkey", lev("rt>0", "rt>0.05"), "rt", "bad", "(select count(case when p_partkey is null then 1 end)/count(*)::double rt, count(case when p_partkey is null then 1 end) bad from lineitem left join (select case when p_size >= 49 then -p_partkey else p_partkey end as p_partkey from part) p on l_partkey=p_partkey)"))
def _(t):
    return ck(V.check_referential(t.lineitem, t.part.withColumn("p_partkey", F.when(F.col("p_size") >= 49, -F.col("p_partkey")).otherwise(F.col("p_partkey"))), "l_partkey", "p_partkey"))


@query("v07_domain", f"with {DIRTY} " + sql("domain", "status", lev("seen<4", "odd>0"), "odd", "bad", "(select coalesce(sum(n) filter (where status not in ('F','O','P','R')),0) bad, count(*) filter (where status not in ('F','O','P','R')) odd, count(*) filter (where status in ('F','O','P','R')) seen from (select status, count(*) n from dirty group by 1))") + " union all " + sql("range", "price", lev("b>0", "b/n::double>0.05"), "b/n::double", "b", "(select count(case when price<0 or price>450000 then 1 end) b, count(price) n from dirty)"))
def _(t):
    d = dirty(t)
    return ck(V.suite(V.check_domain(d, "status", ["F", "O", "P", "R"]), V.scan_checks(d, [V.value_range("price", 0, 450000)])))


@query("v08_row_count", sql("row_count", "rows", lev("false", "n<100 or n>5000"), "n", "(n<100 or n>5000)::int", "(select count(*) n from orders)"))
def _(t):
    return ck(V.scan_checks(t.orders, [V.row_count(100, 5000)]))


STRUCT = " union all ".join([sql("row_count", "rows", lev("false", "n<1"), "n", "0", "(select count(*) n from dirty)"), *[comp(c) for c in ("o_orderkey", "o_custkey", "price", "status", "shipped", "kind", "dt")], sql("primary_key", "o_orderkey", lev("false", "d>0"), "d", "d", "(select count(*) d from (select o_orderkey from dirty group by 1 having count(*)>1))"),
                             sql("domain", "status", lev("seen<3", "odd>0"), "odd", "bad", "(select coalesce(sum(n) filter (where status not in ('F','O','P')),0) bad, count(*) filter (where status not in ('F','O','P')) odd, count(*) filter (where status in ('F','O','P')) seen from (select status, count(*) n from dirty group by 1))")])


# Every structural rule at once: rows, completeness, bounds, schema, keys, days, parents, domains.
STRUCT_ALL = " union all ".join([
    STRUCT,
    sql("date_bounds", "dt", lev("b>0", "false"), "round(b*100.0/n,2)", "b", "(select count(case when dt<date '1996-01-01' or dt>date '2000-12-31' then 1 end) b, count(*) n from dirty)"),
    sql("schema", "columns", "'PASS'", "7", "0", "(select 1)"),
    sql("date_range", "dt", lev("b>0", "false"), "w", "b", "(select (case when min(dt)<>date '1995-01-01' then 1 else 0 end)+count(case when g>2 then 1 end) b, max(g) w from (select dt, datediff('day', lag(dt) over (order by dt), dt) g from (select distinct dt from dirty)))"),
    sql("referential", "o_custkey->c_custkey", lev("rt>0", "rt>0.05"), "rt", "bad", "(select count(case when o_custkey is not null and c_custkey is null then 1 end)/count(*)::double rt, count(case when o_custkey is not null and c_custkey is null then 1 end) bad from dirty left join (select case when c_custkey%11=0 then -c_custkey else c_custkey end as c_custkey from customer) c on o_custkey=c_custkey)"),
])


@query("v09_run_structural", f"with {DIRTY} {STRUCT_ALL}")
def _(t):
    d = dirty(t)
    parent = t.customer.select(F.when(F.col("c_custkey") % 11 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"))
    return ck(V.run_structural(
        d, ["o_orderkey"], schema=dict(d.dtypes), dates={"dt": ("1996-01-01", "2000-12-31")}, days={"dt": ("1995-01-01", None, 2)}, parents=[("o_custkey", parent, "c_custkey")], domains={"status": ["F", "O", "P"]},
    ))


AGG = """(select abs(sum(d)-sum(m))/sum(d) t, count(case when e>0.01 then 1 end) bad, count(case when e>0.05 then 1 end) far from (select coalesce(a.s,b.s) s, d, m, case when d is null or m is null then 'inf'::double else abs(m-d)/abs(d) end e from (select o_orderstatus s, sum(o_totalprice) d from orders group by 1) a full join (select o_orderstatus s, sum(case when o_orderkey%30=0 and o_orderstatus<>'F' then 0 else o_totalprice end) m from orders group by 1) b on a.s=b.s))"""


def short_of(t):
    """Orders of which every thirtieth has lost its amount."""
    lost = (F.col("o_orderkey") % 30 == 0) & (F.col("o_orderstatus") != "F")
    return t.orders.withColumn("o_totalprice", F.when(lost, 0.0).otherwise(F.col("o_totalprice")))


@query("v10_aggregation", sql("aggregation", "o_totalprice", lev("bad>0 or t>0.01", "far>0"), "t", "bad", AGG))
def _(t):
    return ck(V.check_aggregation(t.orders, short_of(t), ["o_orderstatus"], "o_totalprice"))


@query("v11_pct_sum", sql("pct_sum", "pct", lev("w>1", "w>2"), "w", "b", "(select max(abs(s-100)) w, count(case when abs(s-100)>1 then 1 end) b from (select s0, sum(p) s from (select o_orderstatus s0, o_orderpriority, sum(case when o_orderkey%60=0 then 0 else 1 end)*100.0::double/(select count(*) from orders o2 where o2.o_orderstatus=o.o_orderstatus) p from orders o group by 1,2) group by 1))"))
def _(t):
    n = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    p = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.sum(F.when(F.col("o_orderkey") % 60 == 0, 0).otherwise(1)).alias("c")).join(n, "o_orderstatus").withColumn("pct", F.col("c") * 100.0 / F.col("n"))
    return ck(V.check_pct_sum(p, "pct", ["o_orderstatus"]))


MO = "mo as (select date_trunc('month', o_orderdate)::date m, sum(case when month(o_orderdate)=7 and o_orderkey%3<>0 then 0 else 1 end)::bigint n, sum(o_totalprice) v from orders group by 1)"


def monthly(t):
    """Per month the orders and their sum; of July only every third order counts."""
    lost = (F.month("o_orderdate") == 7) & (F.col("o_orderkey") % 3 != 0)
    return t.orders.groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.sum(F.when(lost, 0).otherwise(1)).alias("n"), F.sum("o_totalprice").alias("v"))


@query("v12_monotonic", f"with {MO} " + sql("monotonic", "n", lev("false", "b>0"), "b", "b", "(select count(case when n < p then 1 end) b from (select n, lag(n) over (order by m) p from mo))"))
def _(t):
    return ck(V.check_monotonic(monthly(t), [], "m", "n"))


@query("v13_spikes", f"with {MO} " + sql("spikes", "n", lev("b>0", "false"), "mx", "b", "(select count(case when z>2.5 then 1 end) b, max(z) mx from (select case when count(n) over w=6 and stddev_samp(n) over w>0 then abs(n-avg(n) over w)/stddev_samp(n) over w end z from mo window w as (order by m rows between 6 preceding and 1 preceding)))"))
def _(t):
    return ck(V.check_spikes(monthly(t), [], "m", "n", 6, 2.5))


@query("v14_ratio_bounds", sql("ratio_bounds", "l_extendedprice/l_quantity", lev("false", "b>0"), "mx", "b", "(select count(case when l_extendedprice/nullif(l_quantity,0) not between 900 and 5000 then 1 end) b, max(l_extendedprice/nullif(l_quantity,0)) mx from lineitem)"))
def _(t):
    return ck(V.scan_checks(t.lineitem, [V.ratio_bounds("l_extendedprice", "l_quantity", 900, 5000)]))


@query("v15_group_balance", sql("group_balance", "c_nationkey", lev("false", "s>0 or rt>100"), "rt", "s", "(select max(n)/min(n)::double rt, count(case when n<55 then 1 end) s from (select c_nationkey, count(*) n from customer group by 1))"))
def _(t):
    return ck(V.check_group_balance(t.customer, "c_nationkey", min_size=55))


@query("v16_future_dates", sql("future_dates", "ts", lev("false", "b>0"), "b", "b", "(select count(case when ts > timestamp '2024-01-29' then 1 end) b from events)"))
def _(t):
    return ck(V.scan_checks(t.events, [V.future_dates("ts", "2024-01-29")]))


CHG = "(select count(case when c>0.5 then 1 end) b, count(case when c*100>200 then 1 end) b2, max(c)*100 mx from (select abs(n-p)/abs(p)::double c from (select n, lag(n) over (order by m) p from mo)))"


@query("v17_trend_breaks", f"with {MO} " + sql("trend_breaks", "n", lev("b>0", "b>2"), "b", "b", CHG))
def _(t):
    return ck(V.check_trend_breaks(monthly(t), [], "m", "n"))


EXH = "(select coalesce(abs(sum(price) filter (where o_custkey is not null)-sum(price))/abs(sum(price)),0) df, count(*)-count(o_custkey) ms from dirty)"


@query("v18_exhaustive", f"with {DIRTY} " + sql("exhaustive", "o_custkey", lev("df>0.001", "df>0.01 or ms>0"), "df", "ms", EXH))
def _(t):
    return ck(V.scan_checks(dirty(t), [V.exhaustive("o_custkey", "price")]))


def late_thirteenth(t):
    """Orders of every thirteenth booked a day late, so the day is missing and no row is."""
    return t.orders.withColumn("o_orderdate", F.when(F.dayofmonth("o_orderdate") == 13, F.date_add("o_orderdate", 1)).otherwise(F.col("o_orderdate")))


@query("v19_temporal", sql("temporal", "dt", lev("b>0", "dup>0 or b/sp::double>0.1"), "b/sp::double", "b", """(select sp-nd+dup+zero b, sp, dup from (select datediff('day', lo, hi)+1 sp, count(*) as nd, count(case when n>1 then 1 end) dup, coalesce(sum(case when dt>lo and dt<hi then z end),0) zero from
  (select dt, count(*) n, count(case when y is null or y=0 then 1 end) z, min(dt) over () lo, max(dt) over () hi from (select cast(o_orderdate as date) + case when day(o_orderdate)=13 then 1 else 0 end dt, sum(case when o_orderkey%11=0 then 0 else 1 end) y from orders group by 1) group by 1) group by lo, hi))"""))
def _(t):
    d = late_thirteenth(t).groupBy(F.col("o_orderdate").alias("dt")).agg(F.sum(F.when(F.col("o_orderkey") % 11 == 0, 0).otherwise(1)).alias("y"))
    return ck(V.check_temporal(d, "dt", "y"))


COV = "(select (1-(e-a)/e::double)*100 c, e-a m from (select datediff('day', min(d), max(d))+1 e, count(*) a from (select distinct cast(o_orderdate as date) d from orders where day(o_orderdate)<>13)))"


@query("v20_coverage", sql("coverage", "o_orderdate", lev("m>0", "m>0 and round(c,2)<95"), "round(c,2)", "m", COV) + " union all " + sql("coverage", "o_orderdate", lev("m>0", "false"), "100.0", "m", "(select (year(max(o_orderdate))*12+month(max(o_orderdate)))-(year(min(o_orderdate))*12+month(min(o_orderdate)))+1-count(distinct date_trunc('month',o_orderdate)) m from orders)"))
def _(t):
    # A thirteenth moved to the day after would fill a fourteenth without orders of its own; without a date it fills none.
    o = t.orders.withColumn("o_orderdate", F.when(F.dayofmonth("o_orderdate") != 13, F.col("o_orderdate")))
    return ck(V.suite(V.check_coverage(o, "o_orderdate", "day"), V.check_coverage(t.orders, "o_orderdate", "month")))


@query("v21_run_logical", sql("aggregation", "o_totalprice", lev("bad>0 or t>0.01", "far>0"), "t", "bad", AGG) + " union all " + sql("exhaustive", "o_orderstatus", "'PASS'", "0", "0", "(select 1)") + " union all " + sql("group_balance", "o_orderstatus", lev("false", "s>0 or rt>100"), "rt", "s", "(select max(n)/min(n)::double rt, count(case when n<10 then 1 end) s from (select o_orderstatus, count(*) n from orders group by 1))"))
def _(t):
    return ck(V.run_logical(t.orders, short_of(t), ["o_orderstatus"], "o_totalprice", "m"))


# Every logical rule at once, on months: sums, segments, ratios, future days, steps, percents, direction and spikes.
LOGIC_CTE = """od as (select *, date_trunc('month', o_orderdate)::date as m from orders), sm as (select m, sum(case when month(o_orderdate)=7 and o_orderkey%3<>0 then 0 else o_totalprice end) as o_totalprice, sum(case when month(o_orderdate)=7 and o_orderkey%3<>0 then 0 else 1 end)::bigint as n, count(*)*100.0::double/(select count(*) from orders) as pct, year(m) as y, 'all' as g from od group by m)"""
LOGIC_ALL = " union all ".join([
    sql("aggregation", "o_totalprice", lev("bad>0 or t>0.01", "far>0"), "t", "bad", "(select abs(sum(d)-sum(o))/sum(d) t, count(case when e>0.01 then 1 end) bad, count(case when e>0.05 then 1 end) far from (select d, o, abs(o-d)/abs(d) e from (select m, sum(o_totalprice) d from od group by 1) a join (select m, o_totalprice o from sm) b using (m)))"),
    sql("exhaustive", "m", "'PASS'", "0", "0", "(select 1)"),
    sql("ratio_bounds", "o_totalprice/o_custkey", lev("false", "b>0"), "mx", "b", "(select count(case when o_totalprice/nullif(o_custkey,0)::double not between 0 and 100000 then 1 end) b, max(o_totalprice/nullif(o_custkey,0)::double) mx from orders)"),
    sql("future_dates", "o_orderdate", lev("false", "b>0"), "b", "b", "(select count(case when o_orderdate > timestamp '2000-06-30' then 1 end) b from orders)"),
    sql("trend_breaks", "o_totalprice", lev("b>0", "b>2"), "b", "b", "(select count(case when c>0.5 then 1 end) b from (select abs(v-p)/abs(p) c from (select o_totalprice v, lag(o_totalprice) over (order by m) p from sm)))"),
    sql("pct_sum", "pct", lev("w>1", "w>2"), "w", "b", "(select max(abs(s-100)) w, count(case when abs(s-100)>1 then 1 end) b from (select g, sum(pct) s from sm group by 1))"),
    sql("monotonic", "n", lev("false", "b>0"), "b", "b", "(select count(case when n < p then 1 end) b from (select n, lag(n) over (order by m) p from sm))"),
    sql("spikes", "n", lev("b>0", "false"), "mx", "b", "(select count(case when z>2.5 then 1 end) b, max(z) mx from (select case when count(n) over w=6 and stddev_samp(n) over w>0 then abs(n-avg(n) over w)/stddev_samp(n) over w end z from sm window w as (order by m rows between 6 preceding and 1 preceding)))"),
])


@query("v21_run_logical_months", f"with {LOGIC_CTE} {LOGIC_ALL}")
def _(t):
    od = t.orders.withColumn("m", F.trunc("o_orderdate", "month"))
    lost = (F.month("o_orderdate") == 7) & (F.col("o_orderkey") % 3 != 0)
    total = t.orders.agg(F.count("*").alias("x")).scalar()
    sm = od.groupBy("m").agg(F.sum(F.when(lost, 0.0).otherwise(F.col("o_totalprice"))).alias("o_totalprice"), F.sum(F.when(lost, 0).otherwise(1)).alias("n"), F.count("*").alias("c"))
    sm = sm.withColumns({"pct": F.col("c") * 100.0 / total, "g": F.lit("all")}).drop("c")
    return ck(V.run_logical(
        od, sm, ["m"], "o_totalprice", "m", percents={"pct": ["g"]}, monotonic={"n": True}, spikes={"n": (6, 2.5)}, ratios=[("o_totalprice", "o_custkey", 0.0, 100_000.0)], not_after={"o_orderdate": "2000-06-30"},
    ))


def rng(c, lo, hi, frm):
    return sql("range", c, lev("b>0", "b/n::double>0.05"), "b/n::double", "b", f"(select count(case when {c}<{lo} or {c}>{hi} then 1 end) b, count({c}) n from {frm})")


@query("v22_ranges", rng("l_discount", 0, 0.09, "lineitem") + " union all " + rng("l_quantity", 1, 49.5, "lineitem") + " union all " + rng("l_tax", 0, 1, "lineitem"))
def _(t):
    return ck(V.scan_checks(t.lineitem, [V.value_range("l_discount", 0, 0.09), V.value_range("l_quantity", 1, 49.5), V.value_range("l_tax", 0, 1)]))


@query("v23_metric_relations", sql("metric_relation", "aov * orders = revenue", lev("false", "b>0"), "mx", "b", "(select count(case when d>0.01 then 1 end) b, max(d) mx from (select abs(aov*orders-revenue)/greatest(abs(aov*orders),abs(revenue)) d from (select o_orderstatus, avg(o_totalprice) aov, count(*) orders, sum(case when o_orderkey%40=0 then 0 else o_totalprice end) revenue from orders group by 1)))"))
def _(t):
    m = t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("aov"), F.count("*").alias("orders"), F.sum(F.when(F.col("o_orderkey") % 40 == 0, 0.0).otherwise(F.col("o_totalprice"))).alias("revenue"))
    return ck(V.check_metric_relations(m, ["o_orderstatus"], [("aov * orders", "revenue", 0.01)]))


@query("v24_period_change", f"with {MO} " + sql("period_change", "n", lev("false", "b2>0"), "mx", "b2", CHG))
def _(t):
    return ck(V.check_period_change(monthly(t), [], "m", "n"))


@query("v25_segments", sql("segments", "c_mktsegment", lev("false", "b>0"), "ms", "b", "(select 3-count(distinct case when c_mktsegment in ('BUILDING','MACHINERY','GARDEN') then c_mktsegment end) ms, 3-count(distinct case when c_mktsegment in ('BUILDING','MACHINERY','GARDEN') then c_mktsegment end)+count(distinct case when c_mktsegment not in ('BUILDING','MACHINERY','GARDEN') then c_mktsegment end) b from customer)"))
def _(t):
    return ck(V.check_segments(t.customer, "c_mktsegment", ["BUILDING", "MACHINERY", "GARDEN"], allow_other=False))


@query("v26_non_negative", f"with {DIRTY} " + sql("non_negative", "price", lev("false", "b>0"), "mn", "b", "(select count(case when price<0 then 1 end) b, min(price) mn from dirty)") + " union all " + sql("non_negative", "o_orderkey", lev("false", "b>0"), "mn", "b", "(select count(case when o_orderkey<0 then 1 end) b, min(o_orderkey) mn from dirty)"))
def _(t):
    return ck(V.scan_checks(dirty(t), [V.non_negative("price"), V.non_negative("o_orderkey")]))


CARD = sql("cardinality", "c_nationkey", lev("false", "n<2 or n>20"), "n", "(n<2 or n>20)::int", "(select count(distinct c_nationkey) n from customer)") + " union all " + sql("cardinality", "c_mktsegment", lev("false", "n<2 or n>10"), "n", "(n<2 or n>10)::int", "(select count(distinct c_mktsegment) n from customer)")


@query("v27_cardinality", CARD)
def _(t):
    return ck(V.check_cardinality(t.customer, {"c_nationkey": (2, 20), "c_mktsegment": (2, 10)}))


@query("v28_rates", f"with {PANEL_SQL} " + sql("rates", "pay_pv/exp_uv", lev("o>0 or z>0", "z>0 and o/k::double>0.05"), "a", "o+z", "(select count(case when q<0 or q>1 then 1 end) o, count(case when exp_uv=0 then 1 end) z, count(q) k, avg(q) a from (select exp_uv, pay_pv/nullif(exp_uv,0)::double q from panel where tag='source'))"))
def _(t):
    return ck(V.scan_checks(t.panel.where("tag = 'source'"), [V.rates("pay_pv", "exp_uv")]))


@query("v29_yoy", f"with {MO} " + sql("yoy", "n", lev("near>0", "far>0"), "mx", "near", "(select count(case when c>0.6 then 1 end) far, count(case when c>0.3 then 1 end) near, max(c) mx from (select abs(a.n-b.n)/b.n::double c from mo a join mo b on a.m=(b.m + interval 12 month)::date))"))
def _(t):
    return ck(V.check_yoy(monthly(t), [], "m", "n", 0.6))


@query("v30_run_business", rng("c_acctbal", 0, 9000, "customer") + " union all " + sql("non_negative", "c_acctbal", lev("false", "b>0"), "mn", "b", "(select count(case when c_acctbal<0 then 1 end) b, min(c_acctbal) mn from customer)") + " union all " + CARD + " union all " + sql("segments", "c_mktsegment", lev("false", "b>0"), "b", "b", "(select 2-count(distinct c_mktsegment) b from customer where c_mktsegment in ('BUILDING','MACHINERY'))")
       + " union all " + sql("period_change", "c_acctbal", lev("false", "b>0"), "mx", "b", "(select count(case when c*100>200 then 1 end) b, max(case when c<'inf'::double then c end)*100 mx from (select case when p=0 then case when x<>0 then 'inf'::double end else abs(x-p)/abs(p) end c from (select c_acctbal x, lag(c_acctbal) over (order by c_custkey) p from customer)))")
       + " union all " + sql("metric_relation", "c_acctbal * c_nationkey = c_custkey", lev("false", "b>0"), "mx", "b", "(select count(case when d>0.01 then 1 end) b, max(d) mx from (select coalesce(abs(c_acctbal*c_nationkey-c_custkey)/nullif(greatest(abs(c_acctbal*c_nationkey),abs(c_custkey)),0),0) d from customer))"))
def _(t):
    return ck(V.run_business(
        t.customer, {"c_acctbal": (0, 9000)}, ["c_acctbal"], {"c_nationkey": (2, 20), "c_mktsegment": (2, 10)}, {"c_mktsegment": ["BUILDING", "MACHINERY"]},
        changes={"c_acctbal": ("c_custkey", 200.0)}, relations=[("c_acctbal * c_nationkey", "c_custkey", 0.01)],
    ))


@query("v31_metric_value", """with m as (select 'aov' k, avg(o_totalprice) v from orders union all select 'orders', count(*) from orders union all select 'f_share', avg((o_orderstatus='F')::int) from orders) select 'metric_value' as "check", k as subject, k<>'f_share' as ok, case when k='f_share' then 'BLOCKER' when k='orders' then 'WARNING' else 'PASS' end as severity, round(v,6) as observed, case when k='f_share' then 1 when k='orders' then 1 else 0 end::bigint as n_bad from m""")
def _(t):
    m = t.orders.agg(F.avg("o_totalprice").alias("aov"), F.count("*").cast("double").alias("orders"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("f_share")).unpivot([], ["aov", "orders", "f_share"], "metric", "value")
    defs = t.spark.createDataFrame([("aov", 1000.0, 1e6, 250000.0), ("orders", 1.0, 1e12, 1.0), ("f_share", 0.9, 1.0, None)], "metric string, min_value double, max_value double, target double")
    return ck(V.check_metric_value(m, defs))


@query("v32_join_fanout", sql("join_fanout", "o_custkey=o_custkey", lev("af<>n", "af/n::double>2"), "af/n::double", "abs(af-n)", "(select (select sum(c*c) from (select count(*) c from orders group by o_custkey))::bigint af, count(*) n from orders)") + " union all " + sql("join_fanout", "o_custkey=c_custkey", lev("af<>n", "af/n::double>2"), "af/n::double", "abs(af-n)", "(select (select count(*) from orders join customer on o_custkey=c_custkey) af, count(*) n from orders)"))
def _(t):
    return ck(V.suite(V.check_join_fanout(t.orders, t.orders, "o_custkey", "o_custkey"), V.check_join_fanout(t.orders, t.customer, "o_custkey", "c_custkey")))


@query("v33_date_bounds", sql("date_bounds", "o_orderdate", lev("b>0", "false"), "round(b*100.0/n,2)", "b", "(select count(case when o_orderdate<date '1996-01-01' or o_orderdate>date '2000-12-31' then 1 end) b, count(*) n from orders)"))
def _(t):
    return ck(V.scan_checks(t.orders, [V.date_bounds("o_orderdate", "1996-01-01", "2000-12-31")]))


def nullc(c):
    n = NULLRATE.format(c=c)
    return sql("null_concentration", c, lev(f"{n}>=0.5", f"{n}>=0.95"), n, f"count(*)-count({c})", "dirty")


@query("v34_null_concentration", f"with {DIRTY} " + " union all ".join(nullc(c) for c in ("o_custkey", "shipped", "kind")))
def _(t):
    return ck(V.scan_checks(dirty(t), [V.null_concentration(c) for c in ("o_custkey", "shipped", "kind")]))


def _side(where):
    cols = [("s_suppkey", True), ("s_name", False), ("s_nationkey", True), ("s_acctbal", True)]
    parts = [f"select 'row_count' as k, 'rows' as metric, count(*)::double as v from supplier {where}"]
    for c, num in cols:
        parts.append(f"select 'null_count', '{c}', (count(*)-count({c}))::double from supplier {where}")
        parts.append(f"select 'distinct_count', '{c}', count(distinct {c})::double from supplier {where}")
        if num:
            parts.append(f"select 'numeric_sum', '{c}', sum({c}::double) from supplier {where}")
    return " union all ".join(parts)


@query("v35_tieout", f"""with a as ({_side('')}), b as ({_side('where s_suppkey % 17 <> 0')}), j as (select a.k, a.metric, a.v l, b.v r, abs(a.v-b.v) d from a join b on a.k=b.k and a.metric=b.metric)
  select k as "check", metric, round(l,2)+0.0 as "left", round(r,2)+0.0 as "right", case when k<>'numeric_sum' then case when d=0 then 'PASS' else 'BLOCKER' end when d/abs(l)<=0.0001 then 'PASS' when d/abs(l)<=0.001 then 'WARNING' else 'BLOCKER' end as severity from j""")
def _(t):
    d = V.tieout(t.supplier, t.supplier.where("s_suppkey % 17 <> 0"))
    return d.select("check", "metric", r("left", 2).alias("left"), r("right", 2).alias("right"), "severity")


SIMP = """sx as (select o_orderstatus as cmp, o_totalprice as y, o_orderpriority as d1, year(o_orderdate)::varchar as d2, (o_custkey%4)::varchar as d3 from orders), top as (select cmp, row_number() over (order by count(*) desc, cmp) as rk from sx group by 1),
  lg as (select 'd1' as dimension, d1 as segment, cmp, y from sx union all select 'd2', d2, cmp, y from sx union all select 'd3', d3, cmp, y from sx), gs as (select dimension, segment, avg(y) filter (where rk=1) a, avg(y) filter (where rk=2) b from lg join top using (cmp) where rk<=2 group by 1,2),
  ov as (select avg(y) filter (where rk=1) oa, avg(y) filter (where rk=2) ob from sx join top using (cmp) where rk<=2), dr as (select *, case when a>b then 'positive' when a<b then 'negative' else 'neutral' end d, case when oa>ob then 'positive' when oa<ob then 'negative' else 'neutral' end od from gs, ov where a is not null and b is not null)"""


def simp(t):
    return t.orders.select(F.col("o_orderstatus").alias("cmp"), F.col("o_totalprice").alias("y"), F.col("o_orderpriority").alias("d1"), F.year("o_orderdate").cast("string").alias("d2"), (F.col("o_custkey") % 4).cast("string").alias("d3"))


@query("v36_simpson", f"with {SIMP} select segment, round(a,4) as mean_a, round(b,4) as mean_b, d as direction, od as overall_direction from dr where dimension='d1'")
def _(t):
    d = RC.simpson_segments(simp(t), "y", ["d1"], "cmp")
    return d.select("segment", r("mean_a", 4).alias("mean_a"), r("mean_b", 4).alias("mean_b"), "direction", "overall_direction")


@query("v37_simpson_scan", f"""with {SIMP}, c as (select dimension, max(od) as overall_direction, count(case when d<>'neutral' then 1 end) as segments, count(case when d<>'neutral' and d<>od then 1 end) as reversals from dr group by 1)
  select *, reversals > segments-reversals as paradox, case when reversals=0 then 'none' when reversals/segments::double<=0.25 then 'low' when reversals/segments::double<=0.5 then 'medium' else 'high' end as severity from c""")
def _(t):
    return RC.simpson(simp(t), "y", ["d1", "d2", "d3"], "cmp")


@query("v38_weighted_vs_unweighted", "with g as (select l_suppkey, avg(l_discount) m, sum(l_discount*l_extendedprice) sw, sum(l_extendedprice) w from lineitem where l_extendedprice>0 group by 1), a as (select sum(sw)/sum(w) wt, avg(m) un, count(*) n from g) select round(wt,8) as weighted, round(un,8) as unweighted, n as segments, round(wt-un,8)+0.0 as difference, abs(wt-un)>0.01*greatest(abs(wt),abs(un)) as flag from a")
def _(t):
    d = RC.weighted_vs_unweighted(t.lineitem, "l_discount", "l_extendedprice", "l_suppkey")
    return d.select(r("weighted", 8).alias("weighted"), r("unweighted", 8).alias("unweighted"), "segments", r("difference", 8).alias("difference"), "flag")


@query("v39_suggest_segments", """with l as (select 'o_orderstatus' dimension, o_orderstatus m from orders union all select 'o_orderpriority', o_orderpriority from orders union all select 'yr', year(o_orderdate)::varchar from orders union all select 'o_custkey', o_custkey::varchar from orders union all select 'day', day(o_orderdate)::varchar from orders), g as (select dimension, m, count(*) n from l group by 1,2), s as (select dimension, count(*) n_values, stddev_pop(n)/avg(n) cv from g group by 1)
  , t as (select dimension, n_values, cv, cv/(1+greatest(n_values-10,0)*0.1) as sc from s)
  select dimension, n_values, round(cv,6) as cv, round(sc,6) as score, n_values between 2 and 50 and row_number() over (order by case when n_values between 2 and 50 then 0 else 1 end, sc desc, dimension) <= 5 as suggested from t""")
def _(t):
    o = t.orders.select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("yr"), "o_custkey", F.dayofmonth("o_orderdate").alias("day"))
    return OUT(RC.suggest_segments(o, ["o_orderstatus", "o_orderpriority", "yr", "o_custkey", "day"]), ["dimension", "n_values", "suggested"], ["cv", "score"])


def scored(t):
    """Checks of the planted orders and of the clean ones, as two datasets."""
    out = None
    for name, d in (("dirty", dirty(t)), ("clean", t.orders.withColumns({"price": F.col("o_totalprice"), "status": F.col("o_orderstatus"), "dt": F.col("o_orderdate")}))):
        daily = d.groupBy("dt").agg(F.sum("price").alias("y"))
        rows = V.suite(
            V.scan_checks(d, [V.completeness("o_orderkey"), V.completeness("o_custkey"), V.row_count(1), V.exhaustive("o_custkey", "price"), V.value_range("price", 0, 1e7)]),
            V.check_primary_key(d, ["o_orderkey"]), V.check_temporal(daily, "dt", "y"),
            V.check_simpson(RC.simpson(d.withColumns({"half": F.col("o_orderkey") % 2, "month": F.month("dt")}), "price", ["status", "month"], "half", ("0", "1")), "price"),
        ).select("check", "severity", "observed", "n_bad")
        rows = rows.withColumn("dataset", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


_DS = {"dirty": ("dirty", "price", "o_custkey", "status"), "clean": ("orders", "o_totalprice", "o_custkey", "o_orderstatus")}


def _score_sql(ds):
    tbl, price, cust, status = _DS[ds]
    dt = "dt" if ds == "dirty" else "cast(o_orderdate as date)"
    return f"""select '{ds}' as dataset, (select avg(x) from (select (count(*)-count(o_orderkey))/count(*)::double x from {tbl} union all select (count(*)-count({cust}))/count(*)::double from {tbl})) nr, (select count(*) from (select o_orderkey from {tbl} group by 1 having count(*)>1)) dk,
      (select coalesce(abs(sum({price}) filter (where {cust} is not null)-sum({price}))/abs(sum({price})),0) from {tbl}) df, (select count(*)-count({cust}) from {tbl}) ms, (select count(case when {price}<0 then 1 end)/count(*)::double from {tbl}) rr, (select datediff('day', min({dt}), max({dt}))+1-count(distinct {dt}) from {tbl}) td, (select count(*) from {tbl}) n,
      (select count(*) from (select dim, count(case when dir<>0 and dir<>od then 1 end) rev, count(case when dir<>0 then 1 end) seg, max(od) od from (select dim, sign(sa/na-sb/nb) dir, sign(sum(sa) over w/sum(na) over w-sum(sb) over w/sum(nb) over w) od, na, nb from
        (select dim, m, sum(y) filter (where h=0) sa, count(*) filter (where h=0) na, sum(y) filter (where h=1) sb, count(*) filter (where h=1) nb from (select 's' dim, {status} m, o_orderkey%2 h, {price} y from {tbl} where {price} is not null union all select 'm', month({dt})::varchar, o_orderkey%2, {price} from {tbl} where {price} is not null) where m is not null group by 1,2) window w as (partition by dim)) where na>0 and nb>0 group by dim) where od<>0 and rev > seg - rev) px"""


FACTORS = """f as (select dataset, case when nr<0.01 then 15 when nr<0.05 then 12 when nr<0.1 then 9 when nr<0.2 then 5 else 2 end as data_completeness, case when dk>0 then 3 else 15 end as structural_integrity, case when df>0.01 or ms>0 then 3 when df>0.001 then 12 else 15 end as aggregation_consistency,
  case when td>5 then 5 when td>0 then 10 else 15 end as temporal_consistency, case when rr>0.05 then 5 when rr>0 then 10 else 15 end as business_plausibility, case when px=0 then 15 else 2 end as simpsons_paradox_risk, case when n>10000 then 10 when n>1000 then 8 when n>100 then 5 when n>30 then 3 else 1 end as sample_size from s),
  g as (select *, cast(round_even((data_completeness+structural_integrity+aggregation_consistency+temporal_consistency+business_plausibility+simpsons_paradox_risk+sample_size)*100.0/100, 0) as integer) as score from f)"""


@query("v40_confidence_score", f"""with {DIRTY}, s as ({_score_sql('dirty')} union all {_score_sql('clean')}), {FACTORS}
  select dataset, score, case when score>=85 then 'A' when score>=70 then 'B' when score>=55 then 'C' when score>=40 then 'D' else 'F' end as grade, 4 as layers, data_completeness, structural_integrity, aggregation_consistency, temporal_consistency, business_plausibility, simpsons_paradox_risk, sample_size from g""")
def _(t):
    return V.confidence_score(scored(t))


@query("v41_merge_confidence", f"""with {DIRTY}, s as ({_score_sql('dirty')} union all {_score_sql('clean')}), {FACTORS}, m as (select cast(round_even(avg(score),0) as integer) score, count(*) n, bool_or(score<55) bad, min(data_completeness) a, min(structural_integrity) b, min(aggregation_consistency) c, min(simpsons_paradox_risk) p from g)
  select score, n, case when score>=70 then case when bad then 'C' when score>=85 then 'A' else 'B' end when score>=55 then 'C' when score>=40 then 'D' else 'F' end as grade, a as data_completeness, b as structural_integrity, c as aggregation_consistency, p as simpsons_paradox_risk from m""")
def _(t):
    return V.merge_confidence(V.confidence_score(scored(t))).select("score", "n", "grade", "data_completeness", "structural_integrity", "aggregation_consistency", "simpsons_paradox_risk")


def gate(name, cond, obs, frm):
    return sql(name[0], name[1], lev("false", f"not ({cond})"), obs, f"(not ({cond}))::int", frm)


@query("v42_gates", " union all ".join([
    gate(("row_count", "rows"), "n>=100", "n", "(select count(*) n from orders)"), sql("referential", "o_custkey->c_custkey", lev("b>0", "false"), "b", "b", "(select count(*) b from orders where o_custkey not in (select c_custkey from customer))"),
    sql("primary_key", "o_orderkey", lev("false", "b>0"), "b", "b", "(select count(*) b from (select o_orderkey from orders group by 1 having count(*)>1))"),
    sql("coverage", "ts", lev("m>0", "m>0 and c<95"), "c", "m", "(select round((1-(e-a)/e::double)*100,2) c, e-a m from (select datediff('day', min(d), max(d))+1 e, count(*) a from (select distinct cast(ts as date) d from events)))"),
    sql("funnel_rate", "click/view", lev("false", "q not between 0.5 and 1.5"), "q", "(q not between 0.5 and 1.5)::int", "(select count(case when event_type='click' then 1 end)/count(case when event_type='view' then 1 end)::double q from events)")]))
def _(t):
    q = F.try_divide(F.count(F.when(F.col("event_type") == "click", 1)), F.count(F.when(F.col("event_type") == "view", 1)))
    bad = ~q.between(0.5, 1.5)
    return ck(V.suite(
        V.scan_checks(t.orders, [V.row_count(100)]), V.check_referential(t.orders, t.customer, "o_custkey", "c_custkey"), V.check_primary_key(t.orders, ["o_orderkey"]), V.check_coverage(t.events, "ts"),
        V.scan_checks(t.events, [V.row("funnel_rate", "click/view", V.bad_if(bad), q, 1.5, bad.cast("long"))]),
    ))


CONTRIB = """cx as (select 'status' as dimension, o_orderstatus as member, o_totalprice y, o_orderdate dt from orders union all select 'priority', o_orderpriority, o_totalprice, o_orderdate from orders union all select 'parity', (o_custkey%2)::varchar, o_totalprice, o_orderdate from orders),
  cg as (select dimension, member, sum(case when dt between date '1997-01-01' and date '1997-12-31' then y else 0 end)/365.0 as baseline, sum(case when dt between date '1998-06-01' and date '1998-06-30' then y else 0 end)/30.0 as actual from cx where dt between date '1997-01-01' and date '1997-12-31' or dt between date '1998-06-01' and date '1998-06-30' group by 1,2),
  cs as (select *, actual-baseline as change, (actual-baseline)/sum(actual-baseline) over (partition by dimension) as share from cg), cr as (select *, cast(row_number() over (partition by dimension order by share desc, member) as integer) as rank from cs)"""


def base_period():
    return F.col("o_orderdate").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")), F.col("o_orderdate").between(F.lit("1998-06-01").cast("date"), F.lit("1998-06-30").cast("date"))


def rc_input(t):
    return t.orders.select("o_orderdate", "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 2).cast("string").alias("parity"))


@query("v43_contribution", f"""with {CONTRIB} select dimension, member, round(baseline,4) as baseline, round(actual,4) as actual, round(change,4)+0.0 as change, round(share,6)+0.0 as share, rank, case when max(case when rank=1 then share end) over w > 0.5 then 'HIGH' when sum(case when rank<=2 then share end) over w > 0.7 then 'MEDIUM' else 'LOW' end as power from cr window w as (partition by dimension)""")
def _(t):
    b, p = base_period()
    d = RC.contribution(rc_input(t), ["status", "priority", "parity"], "o_totalprice", b, p, 365.0, 30.0)
    return d.select("dimension", "member", r("baseline", 4).alias("baseline"), r("actual", 4).alias("actual"), r("change", 4).alias("change"), r("share").alias("share"), "rank", "power")


@query("v44_drill_down")
def _(t):
    b, p = base_period()
    return RC.drill_down(rc_input(t), ["status", "priority", "parity"], "o_totalprice", b, p, 365.0, 30.0)


@query("v45_isolate_check", """with g as (select sum(case when o_orderdate between date '1997-01-01' and date '1997-12-31' then o_totalprice end)/365.0 ba, sum(case when o_orderdate between date '1998-06-01' and date '1998-06-30' then o_totalprice end)/30.0 aa, sum(case when o_orderdate between date '1997-01-01' and date '1997-12-31' and o_orderpriority<>'1-URGENT' then o_totalprice end)/365.0 br, sum(case when o_orderdate between date '1998-06-01' and date '1998-06-30' and o_orderpriority<>'1-URGENT' then o_totalprice end)/30.0 ar from orders)
  select round(ba,4) as base_all, round(aa,4) as actual_all, round((aa-ba)/ba,6)+0.0 as change_all, round((ar-br)/br,6)+0.0 as change_rest, abs((ar-br)/br) > 0.1 as still_anomalous from g""")
def _(t):
    b, p = base_period()
    d = RC.isolate_check(rc_input(t), F.col("priority") == "1-URGENT", "o_totalprice", b, p, 365.0, 30.0)
    return d.select(r("base_all", 4).alias("base_all"), r("actual_all", 4).alias("actual_all"), r("change_all").alias("change_all"), r("change_rest").alias("change_rest"), "still_anomalous")


@query("v46_excess", """with d as (select o_orderdate dt, sum(o_totalprice) y from orders group by 1), g as (select avg(case when dt between date '1997-01-01' and date '1997-12-31' then y end) dl, sum(case when dt between date '1998-06-01' and date '1998-06-30' then y end) a, count(case when dt between date '1998-06-01' and date '1998-06-30' then 1 end) k from d)
  select round(dl,4) as daily, round(a,2) as actual, k as days, round(dl*k,3) as expected, round(a-dl*k,3)+0.0 as excess, round(a/(dl*k),6) as ratio, round((a-dl*k)/(dl*k)*100,6)+0.0 as excess_pct from g""")
def _(t):
    b, p = base_period()
    d = RC.excess(t.orders, "o_orderdate", "o_totalprice", b, p)
    return d.select(r("daily", 4).alias("daily"), r("actual", 2).alias("actual"), "days", r("expected", 3).alias("expected"), r("excess", 3).alias("excess"), r("ratio").alias("ratio"), r("excess_pct").alias("excess_pct"))


@query("v47_mix_rate", """with g as (select o_orderpriority as member, count(case when year(o_orderdate)=1997 and o_orderstatus='F' then 1 end)::double n0, count(case when year(o_orderdate)=1997 then 1 end)::double d0, count(case when year(o_orderdate)=1998 and o_orderstatus='F' then 1 end)::double n1, count(case when year(o_orderdate)=1998 then 1 end)::double d1 from orders group by 1), s as (select *, d0/sum(d0) over () s0, d1/sum(d1) over () s1 from g)
  select member, round(s0,6) as share_pre, round(s1,6) as share_post, round(n0/d0,6) as rate_pre, round(n1/d1,6) as rate_post, round((s1-s0)*n0/d0,8)+0.0 as mix_effect, round(s1*(n1/d1-n0/d0),8)+0.0 as rate_effect from s""")
def _(t):
    d = RC.mix_rate(t.orders, "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int"), F.lit(1), F.year("o_orderdate") == 1997, F.year("o_orderdate") == 1998)
    return d.select("member", *[r(c).alias(c) for c in ("share_pre", "share_post", "rate_pre", "rate_post")], r("mix_effect", 8).alias("mix_effect"), r("rate_effect", 8).alias("rate_effect"))


@query("v48_claim_check", """with a as (select o_orderstatus as claim, sum(o_totalprice) as v from orders group by 1), c as (select claim, v, case claim when 'F' then v*1.0005 when 'O' then v*1.005 else v*1.05 end as rep from a) select 'claim' as "check", claim as subject, abs(rep-v)/v<0.001 as ok, case when abs(rep-v)/v<0.001 then 'PASS' when abs(rep-v)/v<=0.01 then 'WARNING' else 'BLOCKER' end as severity, round(v,2)::double as observed, (abs(rep-v)/v>=0.001)::int::bigint as n_bad from c""")
def _(t):
    a = t.orders.groupBy(F.col("o_orderstatus").alias("claim")).agg(F.sum("o_totalprice").alias("actual"))
    claims = a.select("claim", (F.col("actual") * F.when(F.col("claim") == "F", 1.0005).when(F.col("claim") == "O", 1.005).otherwise(1.05)).alias("reported"))
    return V.claim_check(claims, a).select("check", "subject", "ok", "severity", r("observed", 2).alias("observed"), "n_bad")


@query("v49_event_sanity", "with st as (select user_id, min(ts) as t0 from events where event_type='signup' group by 1), dd as (select cast(ts as date) d, count(*) n from events group by 1), wk as (select date_trunc('week', d) w, sum(n) n from dd group by 1 having count(*)=7) " + " union all ".join([
    sql("events_before_start", "user_id", lev("false", "b>0"), "b", "b", "(select count(case when ts<t0 then 1 end) b from events join st using (user_id))"), sql("date_bounds", "ts", lev("b>0", "false"), "round(b*100.0/n,2)", "b", "(select count(case when ts<timestamp '2024-01-01' or ts>timestamp '2024-01-20' then 1 end) b, count(*) n from events)"),
    sql("events_per_day", "ts", lev("false", "b>0"), "mn", "b", "(select count(case when n<100 then 1 end) b, min(n) mn from dd)"), sql("peak_week", "ts", lev("q>1.5", "false"), "q", "0", "(select max(n)/median(n) q from wk)")]))
def _(t):
    st = t.events.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    return ck(V.event_sanity(t.events, st, "user_id", "ts", "t0", "2024-01-01", "2024-01-20", 100))
