"""Profiling and schema."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import r, ratio
from funnelwright.operators import profile as B
from funnelwright.operators import checks as V
from funnelwright.operators.relations import dedup_first
from funnelwright.plans.registry import query
from funnelwright.sources.tables import TABLE_NAMES

OUT = lambda df, keep, cols, digits=6: df.select(*keep, *[r(c, digits).alias(c) for c in cols])
CUST = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _x(c, t):
    return f"length({c})::double" if t == "string" else f"{c}::double"


@query("b01_profile_columns", " union all ".join(
    f"""select '{c}' as column_name, '{t}' as data_type, count(*) as n_rows, count(*)-count({c}) as n_null, 0.0::double as null_pct, round(min({_x(c, t)}),6)+0.0 as stat_min, round(max({_x(c, t)}),6) as stat_max, round(avg({_x(c, t)}),6) as stat_mean, round(stddev_samp({_x(c, t)}),6) as stat_sd, count(distinct {c}) as n_unique from customer"""
    for c, t in CUST.items()))
def _(t):
    d = B.profile_columns(t.customer)
    return d.select("column_name", "data_type", "n_rows", "n_null", r("null_pct").alias("null_pct"), *[r(c).alias(c) for c in ("stat_min", "stat_max", "stat_mean", "stat_sd")], "n_unique")


@query("b01_sample_values", "select 'c_mktsegment' as column_name, list(distinct c_mktsegment order by c_mktsegment) as sample_values from customer")
def _(t):
    return B.profile_columns(t.customer, ["c_mktsegment"]).select("column_name", "sample_values")


@query("b02_profile_table", """select 'orders' as table_name, count(*) as n_rows, 7 as n_columns, 'o_orderdate,odate_text' as date_columns, min(o_orderdate)::date as date_min, max(o_orderdate)::date as date_max from orders""")
def _(t):
    o = t.raw("orders").withColumn("odate_text", F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return B.profile_table(o, "orders")


DATED = {"orders": "o_orderdate", "events": "ts", "lineitem": "l_shipdate"}
COLUMNS_SQL = lambda n: f"(select count(*)::int from (describe {n}))"


@query("b03_profile_source", " union all ".join(
    f"select '{n}' as table_name, count(*) as n_rows, {COLUMNS_SQL(n)} as n_columns, '{DATED.get(n, '')}' as date_columns, "
    + (f"min({DATED[n]})::date as date_min, max({DATED[n]})::date as date_max" if n in DATED else "null::date as date_min, null::date as date_max") + f" from {n}" for n in TABLE_NAMES))
def _(t):
    return B.profile_source({n: t.raw(n) for n in TABLE_NAMES})


DCOLS = ["l_quantity", "l_extendedprice", "l_discount"]
LONG = "long as (" + " union all ".join(f"select '{c}' as c, {c}::double as x from lineitem" for c in DCOLS) + " union all select 'skewed', exp(l_quantity/5.0) from lineitem)"


def dist_input(t):
    return t.lineitem.select(*DCOLS, F.exp(F.col("l_quantity") / 5.0).alias("skewed"))


@query("b04_profile_distributions", f"""with {LONG}, m as (select c, count(*) n, avg(x) mean, stddev_samp(x) sd, skewness(x) sk, quantile_cont(x,0.01) p1, quantile_cont(x,0.05) p5, quantile_cont(x,0.25) p25, median(x) md, quantile_cont(x,0.75) p75, quantile_cont(x,0.95) p95, quantile_cont(x,0.99) p99, count(distinct x) nu from long group by 1),
  o as (select m.c, count(case when x < p25-1.5*(p75-p25) or x > p75+1.5*(p75-p25) then 1 end) as n_outliers from long join m using (c) group by 1)
  select c as column_name, round(mean,4) as mean, round(sd,4) as sd, round(sk,5)+0.0 as skewness, round(p1,6) as p1, round(p5,6) as p5, round(p25,6) as p25, round(md,6) as median, round(p75,6) as p75, round(p95,6) as p95, round(p99,6) as p99, round(p75-p25,6) as iqr, nu as n_unique, n_outliers::bigint as n_outliers from m join o using (c)""")
def _(t):
    d = B.profile_distributions(dist_input(t), [*DCOLS, "skewed"])
    return d.select("column_name", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"), r("skew_corrected", 5).alias("skewness"), *[r(c).alias(c) for c in (*B.DIST_PROBS, "iqr")], "n_unique", "n_outliers")


@query("b04_shapes", f"""with {LONG}, m as (select c, count(*)::double n, skewness(x) sk, count(distinct x) nu, min(x) lo, max(x) hi, ((avg(x**4)-4*avg(x)*avg(x**3)+6*avg(x)**2*avg(x**2)-3*avg(x)**4)/var_pop(x)**2-3) g2 from long group by 1),
  k as (select *, (n-1)/((n-2)*(n-3))*((n+1)*g2+6) ku, least(50,nu)::int bins from m),
  h as (select l.c, least(floor((x-lo)/((hi-lo)/bins))::int, bins-1) bin, count(*) n from long l join k using (c) group by 1,2), f as (select k.c, g.bin, coalesce(h.n,0) n from k, lateral (select unnest(range(0,bins))::int as bin) g left join h on h.c=k.c and h.bin=g.bin),
  s as (select c, bin, (coalesce(lag(n) over w,0)+n+coalesce(lead(n) over w,0))/3.0::double s from f window w as (partition by c order by bin)), p as (select *, coalesce(s>lag(s) over w and s>lead(s) over w,false) pk from s window w as (partition by c order by bin)),
  t2 as (select c, min(bin) a, max(bin) z, min(s) low, count(*) k from (select *, row_number() over (partition by c order by s desc, bin) r from p where pk) where r<=2 group by 1 having count(*)=2), v as (select s.c, min(s.s) < max(low)*0.6 as bimodal from s join t2 on s.c=t2.c and bin between a and z group by 1)
  select c as column_name, case when abs(sk)<0.5 and ku < -1 then 'uniform' when ku>3 then 'heavy-tailed' when nu>10 and coalesce(bimodal,false) then 'bimodal' when sk>1 then 'right-skewed' when sk < -1 then 'left-skewed' else 'normal' end as shape, case when sk>1 and lo>0 then 'log' when sk>1 and lo>=0 then 'sqrt' end as transform from k left join v using (c)""")
def _(t):
    return B.profile_distributions(dist_input(t), [*DCOLS, "skewed"]).select("column_name", "shape", "transform")


@query("b05_profile_temporal", """with d as (select cast(o_orderdate as date) - case when day(o_orderdate) % 9 = 0 then 1 else 0 end as dt, count(*) y from orders group by 1), l as (select datediff('day', dt, lead(dt) over (order by dt))-1 g from d), i as (select y, (row_number() over (order by dt)-1)::double i from d), f as (select regr_slope(y,i) sl, regr_intercept(y,i) ic, avg(y) m, count(*) n from i), e as (select sqrt(avg((y-(ic+sl*i))**2)) rs from i, f)
  select min(dt) as date_min, max(dt) as date_max, datediff('day', min(dt), max(dt))+1 as expected, count(*) as actual, round(count(*)*100.0/(datediff('day', min(dt), max(dt))+1),6) as coverage_pct, (select count(*) from l where g>0) as n_gaps, (select max(g) from l) as longest_gap,
  (select case when rs/m>0.5 then 'volatile' when sl/m>0.01 then 'increasing' when sl/m < -0.01 then 'decreasing' else 'stable' end from f, e) as trend from d""")
def _(t):
    # Every ninth day is booked a day early: the day is missing, no row is.
    early = F.when(F.dayofmonth("o_orderdate") % 9 == 0, F.date_sub("o_orderdate", 1)).otherwise(F.col("o_orderdate"))
    o = t.orders.withColumns({"o_orderdate": early, "one": F.lit(1)})
    return B.profile_temporal(o, "o_orderdate", "one").withColumn("coverage_pct", r("coverage_pct"))


def dirty(t):
    """Orders with planted defects: missing customers, negative prices, blank statuses, repeated keys."""
    o = t.orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("o_custkey"), F.when(F.col("o_orderkey") % 97 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("shipped"), F.lit("x").alias("kind"), F.col("o_orderdate").alias("dt"),
    )
    return o.unionByName(o.where("o_orderkey % 50 = 0"))


DIRTY = """d0 as (select o_orderkey, case when o_orderkey%10<>0 then o_custkey end as o_custkey, case when o_orderkey%97=0 then -o_totalprice else o_totalprice end as price, case when o_orderkey%13=0 then ' ' else o_orderstatus end as status, case when o_orderkey%3=0 then cast(o_orderdate as date) end as shipped, 'x' as kind, cast(o_orderdate as date) as dt from orders),
  dirty as (select * from d0 union all select * from d0 where o_orderkey%50=0)"""


@query("b06_profile_completeness", f"with {DIRTY} " + " union all ".join(
    f"select '{c}' as column_name, count(*) as n_rows, count(*)-count({c}) as n_null, round((count(*)-count({c}))*100.0/count(*),2) as null_pct, case when round((count(*)-count({c}))*100.0/count(*),2)=0 then 'COMPLETE' when (count(*)-count({c}))*100.0/count(*)<5 then 'GOOD' when (count(*)-count({c}))*100.0/count(*)<50 then 'WARNING' else 'CRITICAL' end as status, {z}::bigint as n_zero, {b}::bigint as n_blank, count(distinct {c})<=1 as constant from dirty"
    for c, z, b in (("o_orderkey", "count(case when o_orderkey=0 then 1 end)", "0"), ("o_custkey", "count(case when o_custkey=0 then 1 end)", "0"), ("price", "count(case when price=0 then 1 end)", "0"), ("status", "0", "count(case when trim(status)='' then 1 end)"), ("shipped", "0", "0"), ("kind", "0", "0"), ("dt", "0", "0"))))
def _(t):
    return B.profile_completeness(dirty(t)).withColumn("null_pct", r("null_pct", 2))


@query("b07_compare_snapshots", """select 'nation' as table_name, null::varchar as column_name, 'table_removed' as change, null::varchar as old, null::varchar as "new", true as breaking union all select 'region', null, 'table_added', null, null, false
  union all select 'orders', 'o_orderpriority', 'column_removed', 'string', null, true union all select 'orders', 'note', 'column_added', null, 'string', false union all select 'orders', 'o_totalprice', 'type_changed', 'double', 'string', false
  union all select 'orders', null, 'rows_changed', (select count(*) from orders)::varchar, (select count(*) from orders where o_orderstatus='F')::varchar, false""")
def _(t):
    o = t.raw("orders")
    new = o.where("o_orderstatus = 'F'").drop("o_orderpriority").withColumns({"note": F.lit(""), "o_totalprice": F.col("o_totalprice").cast("string")})
    return B.compare_snapshots(B.snapshot({"orders": o, "nation": t.nation, "part": t.part}), B.snapshot({"orders": new, "region": t.region, "part": t.part}))


@query("b08_discover_relationships", """with o as (select count(distinct doc_id) nd, count(distinct case when doc_id in (select doc_id from documents) then doc_id end) nf from labels), k as (select count(distinct o_custkey) nd, count(distinct case when o_custkey in (select c_custkey from customer) then o_custkey end) nf from orders)
  select 'labels' as from_table, 'doc_id' as from_column, 'documents' as to_table, 'doc_id' as to_column, round(least(1.0,(0.5+round(nf/nd::double,2))/2+0.1),2)::double as confidence, 'both' as method, case when nd > (select count(distinct doc_id) from documents)*0.9 then 'one-to-one' else 'many-to-one' end as cardinality from o
  union all select 'orders','o_custkey','customer','c_custkey', round(least(1.0,(0.4+round(nf/nd::double,2))/2+0.1),2)::double, 'both', case when nd > (select count(distinct c_custkey) from customer)*0.9 then 'one-to-one' else 'many-to-one' end from k""")
def _(t):
    tables = {"labels": t.labels, "documents": t.documents.select("doc_id", "lang"), "orders": t.orders, "customer": t.customer}
    return B.discover_relationships(tables, extra=[("orders", "o_custkey", "customer", "c_custkey", 0.4)])


@query("b09_outliers_iqr", """with x as (select exp(l_quantity/8.0) v from lineitem), q as (select quantile_cont(v,0.25) a, quantile_cont(v,0.75) b from x), g as (select count(*) n, count(case when v < a-1.5*(b-a) or v > b+1.5*(b-a) then 1 end) o, max(a-1.5*(b-a)) lo, max(b+1.5*(b-a)) hi from x, q)
  select 'v' as column_name, 'iqr' as method, round(lo,6)+0.0 as lower, round(hi,6) as upper, n as n_total, o as n_outliers, round(o/n::double,4) as outlier_pct, case when round(o/n::double,4)<0.05 then 'PASS' when round(o/n::double,4)<0.15 then 'WARN' else 'FAIL' end as status from g""")
def _(t):
    return OUT(B.outliers(t.lineitem.select(F.exp(F.col("l_quantity") / 8.0).alias("v")), "v"), ["column_name", "method", "n_total", "n_outliers", "status"], ["lower", "upper", "outlier_pct"])


@query("b09_outliers_zscore", """with q as (select avg(value) m, stddev_samp(value) s from events), g as (select count(*) n, count(case when abs(value-m) > 1.7*s then 1 end) o, max(m-1.7*s) lo, max(m+1.7*s) hi from events, q)
  select 'value' as column_name, 'zscore' as method, round(lo,6)+0.0 as lower, round(hi,6) as upper, n as n_total, o as n_outliers, round(o/n::double,4) as outlier_pct, case when round(o/n::double,4)<0.05 then 'PASS' when round(o/n::double,4)<0.15 then 'WARN' else 'FAIL' end as status from g""")
def _(t):
    return OUT(B.outliers(t.events, "value", "zscore", z=1.7), ["column_name", "method", "n_total", "n_outliers", "status"], ["lower", "upper", "outlier_pct"])


QS = """s as (select (1-(count(*)-count(o_custkey))/count(*)::double)*100 as completeness, count(distinct o_orderkey)/count(*)::double*100 as uniqueness, count(case when status in ('F','O','P') then 1 end)/count(*)::double*100 as validity, count(case when shipped is null or shipped=dt then 1 end)/count(*)::double*100 as consistency, count(case when dt >= date '1996-01-01' then 1 end)/count(*)::double*100 as timeliness, count(case when price>=0 then 1 end)/count(*)::double*100 as accuracy from dirty)"""
_dims = {"completeness": 0.25, "uniqueness": 0.2, "validity": 0.2, "consistency": 0.15, "timeliness": 0.1, "accuracy": 0.1}
_total = "+".join(f"{k}*{w}::double" for k, w in _dims.items())


@query("b10_quality_score", f"with {DIRTY}, {QS} " + " union all ".join(f"select '{k}' as dimension, round({k},6) as score, {w}::double as weight, round({_total},6) as total from s" for k, w in _dims.items()))
def _(t):
    d = dirty(t)
    share = lambda c: ratio(F.count(F.when(c, 1)), F.count("*")) * 100
    unique = d.groupBy("o_orderkey").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n"))
    g = d.agg(share(F.col("o_custkey").isNotNull()).alias("completeness"), share(F.col("status").isin("F", "O", "P")).alias("validity"), share(F.expr("shipped is null or shipped = dt")).alias("consistency"),
              share(F.col("dt") >= F.lit("1996-01-01").cast("date")).alias("timeliness"), share(F.col("price") >= 0).alias("accuracy"), F.count("*").alias("_n"))
    g = g.withColumn("uniqueness", ratio(unique.scalar(), "_n") * 100).drop("_n")
    return OUT(B.quality_score(g.unpivot([], list(_dims), "dimension", "score")), ["dimension", "weight"], ["score", "total"])


@query("b11_clean", f"""with {DIRTY}, c as (select * from (select o_orderkey, o_custkey, abs(price) as price, case when trim(status)='' then 'U' else trim(status) end as status from dirty where o_custkey is not null) qualify row_number() over (partition by o_orderkey)=1)
  select status, count(*) as n, round(sum(price),2) as total from c group by 1""")
def _(t):
    c = B.clean(dirty(t), ["o_orderkey"], ["o_custkey"], {}, {"price": F.abs("price"), "status": F.when(F.trim("status") == "", "U").otherwise(F.trim("status"))})
    return c.groupBy("status").agg(F.count("*").alias("n"), r(F.sum("price"), 2).alias("total"))


@query("b11_clean_report", f"with {DIRTY} select count(*) as rows_before, count(distinct case when o_custkey is not null then o_orderkey end) as rows_after, count(*)-count(distinct case when o_custkey is not null then o_orderkey end) as removed from dirty")
def _(t):
    d = dirty(t)
    return B.clean_report(d, B.clean(d, ["o_orderkey"], ["o_custkey"], {}, {}))


@query("b12_top_values", """with l as (select 'p_type' as column_name, p_type as value from part union all select 'p_brand', p_brand from part union all select 'p_name', p_name from part), g as (select column_name, value, count(*) n from l group by 1,2), k as (select *, row_number() over (partition by column_name order by n desc, value) as rank, sum(n) over (partition by column_name) t from g)
  select column_name, value, n, rank::int as rank, round(n/t::double,6) as share, n > 0.5*t as dominant from k where rank <= 3""")
def _(t):
    return B.top_values(t.part, ["p_type", "p_brand", "p_name"], 3).withColumn("share", r("share"))


@query("b13_requirement_coverage", "select unnest(['o_orderkey','o_custkey','shipped','price','refund']) as field, unnest(['AVAILABLE','PARTIAL','PARTIAL','AVAILABLE','MISSING']) as coverage")
def _(t):
    needs = t.spark.createDataFrame([("o_orderkey",), ("o_custkey",), ("shipped",), ("price",), ("refund",)], "field string")
    return B.requirement_coverage(B.profile_completeness(dirty(t)), needs)
