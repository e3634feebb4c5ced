"""Time series."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import r
from funnelwright.operators import series as Q
from funnelwright.plans.registry import query

OUT = lambda df, keep, cols, digits=6: df.select(*keep, *[r(c, digits).alias(c) for c in cols])
MS = "ms as (select o_orderstatus as s, date_trunc('month', o_orderdate)::date as m, count(*) as n, sum(o_totalprice) as v from orders group by 1,2)"


def monthly(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("s"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"))


DS = "ds as (select event_type as s, cast(ts as date) as d, count(*) as n, sum(value) as v from events group by 1,2)"


def daily(t):
    return t.events.groupBy(F.col("event_type").alias("s"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query("q01_resample", "select o_orderstatus as s, date_trunc('quarter', o_orderdate)::date as period, sum(o_totalprice > 200000)::bigint as big, count(*) as n, round(sum(o_totalprice > 200000)/count(*)::double,6) as share from orders group by 1,2")
def _(t):
    o = t.orders.select(F.col("o_orderstatus").alias("s"), "o_orderdate", F.lit(1).alias("n"), (F.col("o_totalprice") > 200000).cast("int").alias("big"))
    return Q.resample(o, "o_orderdate", ["s"], ["big", "n"], {"share": ("big", "n")}).withColumn("share", r("share"))


@query("q01_resample_daily", f"with {DS} select s, d as period, n from ds")
def _(t):
    e = t.events.select(F.col("event_type").alias("s"), F.to_date("ts").alias("d"), F.lit(1).alias("n"))
    return Q.resample(e, "d", ["s"], ["n"], {})


@query("q02_pop_changes", f"""with {MS} select s, m, n, n-lag(n) over w as abs_change, round((n-lag(n) over w)/nullif(lag(n) over w,0)::double*100,6)+0.0 as pct_change, coalesce(lag(n) over w = 0 and n<>0, false) as is_new, round((n-lag(n,12) over w)/nullif(lag(n,12) over w,0)::double*100,6)+0.0 as yoy_pct,
  round(avg(n) over (partition by s order by m rows 2 preceding),6) as rolling_mean, (sum(n) over w)::bigint as cumulative from ms window w as (partition by s order by m)""")
def _(t):
    d = Q.pop_changes(monthly(t), ["s"], "m", "n", 3, 12)
    return d.select("s", "m", "n", "abs_change", r("pct_change").alias("pct_change"), "is_new", r("yoy_pct").alias("yoy_pct"), r("rolling_mean").alias("rolling_mean"), "cumulative")


def _cc_sql(frame: str, mincount: str) -> str:
    return f"""with {MS}, c as (select s, m, n, {'avg(n) over f' if not frame else 'case when count(n) over f >= 2 then avg(n) over f end'} as center, {'stddev_samp(n) over f' if not frame else 'case when count(n) over f >= 2 then stddev_samp(n) over f end'} as sd from ms window f as (partition by s {frame})),
  z as (select *, case when sd is null then null when sd>0 then (n-center)/sd else 0 end as z from c),
  k as (select *, count(z) over w3=3 and (count(case when z>2 then 1 end) over w3 >= 2 or count(case when z<-2 then 1 end) over w3 >= 2) as r2, count(z) over w5=5 and (count(case when z>1 then 1 end) over w5 >= 4 or count(case when z<-1 then 1 end) over w5 >= 4) as r3,
    count(z) over w8=8 and (count(case when n>center then 1 end) over w8 = 8 or count(case when n<center then 1 end) over w8 = 8) as r4 from z window w3 as (partition by s order by m rows 2 preceding), w5 as (partition by s order by m rows 4 preceding), w8 as (partition by s order by m rows 7 preceding))
  select s, m, round(center,6) as center, round(center+2*sd,6) as ucl, round(center-2*sd,6)+0.0 as lcl, coalesce(abs(z)>2,false) as rule1, r2 as rule2, r3 as rule3, r4 as rule4 from k"""


@query("q03_control_chart", _cc_sql("", ""))
def _(t):
    d = Q.control_chart(monthly(t), ["s"], "m", "n", sigma=2.0)
    return d.select("s", "m", r("center").alias("center"), r("ucl").alias("ucl"), r("lcl").alias("lcl"), "rule1", "rule2", "rule3", "rule4")


@query("q03_control_chart_rolling", _cc_sql("order by m rows 11 preceding", ""))
def _(t):
    d = Q.control_chart(monthly(t), ["s"], "m", "n", sigma=2.0, window=12)
    return d.select("s", "m", r("center").alias("center"), r("ucl").alias("ucl"), r("lcl").alias("lcl"), "rule1", "rule2", "rule3", "rule4")


@query("q04_rate_of_change", f"with {MS}, c as (select s, m, n-lag(n) over (partition by s order by m) as change from ms), a as (select *, avg(abs(change)) over (partition by s) as ma from c) select s, m, change, round(ma,6) as mean_abs_change from a where abs(change) > 2*ma")
def _(t):
    return Q.rate_of_change_anomaly(monthly(t), ["s"], "m", "n").select("s", "m", "change", r("mean_abs_change").alias("mean_abs_change"))


@query("q05_structural_break", f"""with {MS}, i as (select *, row_number() over (partition by s order by m)-1 as i, count(*) over (partition by s) as c from ms), h as (select *, case when i < floor(c/2) then 1 else 2 end as h from i),
  g as (select s, avg(n) filter (where h=1) m1, avg(n) filter (where h=2) m2, var_samp(n) filter (where h=1) v1, var_samp(n) filter (where h=2) v2, regr_slope(n,i) filter (where h=1) s1, regr_slope(n,i) filter (where h=2) s2, count(*) filter (where h=1) n1, count(*) filter (where h=2) n2 from h group by 1)
  select s, round(m1,6) as mean_1, round(m2,6) as mean_2, round(v1,6) as var_1, round(v2,6) as var_2, round(s1,6)+0.0 as slope_1, round(s2,6)+0.0 as slope_2, round((m2-m1)/sqrt(v1/n1+v2/n2),6)+0.0 as t, abs((m2-m1)/sqrt(v1/n1+v2/n2))>2 or greatest(v1,v2)>4*least(v1,v2) or sign(s1)*sign(s2)<0 as structural_break from g""")
def _(t):
    return OUT(Q.structural_break(monthly(t), ["s"], "m", "n"), ["s", "structural_break"], ["mean_1", "mean_2", "var_1", "var_2", "slope_1", "slope_2", "t"])


@query("q06_linear_trend", f"""with {MS}, i as (select *, (row_number() over (partition by s order by m)-1)::double as i from ms), g as (select s, count(*) n, avg(n) mean, regr_slope(n,i) sl, regr_intercept(n,i) ic from i group by 1), e as (select g.s, sqrt(avg((i.n-(ic+sl*i))**2)) rs from i join g using (s) group by 1)
  select s, g.n as n, round(sl,6)+0.0 as slope, round(ic,6) as intercept, round(rs/abs(mean),6) as cv_resid, case when g.n<5 then 'unknown' when mean=0 then 'stable' when rs/abs(mean)>0.5 then 'volatile' when sl/abs(mean)>0.01 then 'increasing' when sl/abs(mean)<-0.01 then 'decreasing' else 'stable' end as trend from g join e using (s)""")
def _(t):
    return OUT(Q.linear_trend(monthly(t), ["s"], "m", "n"), ["s", "n", "trend"], ["slope", "intercept", "cv_resid"])


ACF = f"""{MS}, i as (select *, row_number() over (partition by s order by m) as i, count(*) over (partition by s) as c, n - avg(n) over (partition by s) as x, var_pop(n) over (partition by s) as vp from ms),
  acf as (select a.s, b.i-a.i as lag, avg(a.x*b.x)/max(a.vp) as acf, max(a.c) as n from i a join i b on a.s=b.s and b.i > a.i and b.i-a.i <= least(24, floor(a.c/2)) group by 1,2),
  pk as (select *, lag(acf) over w as l, lead(acf) over w as r from acf window w as (partition by s order by lag))"""


@query("q07_autocorrelation", f"with {ACF} select s, lag::int as lag, round(acf,6)+0.0 as acf, n from acf")
def _(t):
    return Q.autocorrelation(monthly(t), ["s"], "m", "n", 24).select("s", "lag", r("acf").alias("acf"), "n")


@query("q07_seasonality", f"""with {ACF}, b as (select s, count(*) as n_peaks, arg_max(lag, acf) as lag, max(acf) as acf from pk where acf>l and acf>r and acf>2/sqrt(n) group by 1), x as (select distinct s, n from acf)
  select x.s, x.n, coalesce(n_peaks,0) as n_peaks, lag::int as dominant_period, round(coalesce(acf,0),6) as strength, case when acf is null then 'none' when acf>0.5 then 'strong' when acf>0.3 then 'moderate' else 'weak' end as label from x left join b using (s)""")
def _(t):
    d = Q.seasonality(monthly(t), ["s"], "m", "n", 24)
    return d.select("s", "n", "n_peaks", "dominant_period", r("strength").alias("strength"), "label")


@query("q08_naive_forecast", f"""with {MS}, x as (select *, row_number() over (partition by s order by m desc) as r, count(*) over (partition by s) as c from ms), g as (select s, max(c) c, max(case when r=1 then n end)::double l, max(case when r=c then n end)::double f, avg(case when r<=7 then n end) mn, list(n::double order by m) filter (where r<=12) cy from x group by 1)
  select s, h::int as h, round(l,6) as last, round(mn,6) as mean, round(l+(l-f)/(c-1)*h,6)+0.0 as drift, round(cy[((h-1)%12+1)::bigint],6) as seasonal_naive from g, (select unnest(range(1,15)) as h)""")
def _(t):
    return OUT(Q.naive_forecast(monthly(t), ["s"], "m", "n", 14, window=7, cycle=12), ["s", "h"], ["last", "mean", "drift", "seasonal_naive"])


@query("q09_exp_smoothing")
def _(t):
    return Q.exp_smoothing(monthly(t), ["s"], "m", "n", beta=0.1, period=12, fit_on="one_step")


@query("q09_simple_smoothing", f"""with recursive {MS}, x as (select s, m, n::double as n, row_number() over (partition by s order by m) as i from ms), rec as (select s, m, i, n, n as f from x where i=1 union all select x.s, x.m, x.i, x.n, 0.3::double*x.n+(1-0.3::double)*rec.f from rec join x on x.s=rec.s and x.i=rec.i+1) select s, m, round(f,4) as filtered from rec""")
def _(t):
    return Q.exp_smoothing(monthly(t), ["s"], "m", "n", alpha=0.3).select("s", "m", r("filtered", 4).alias("filtered"))


@query("q10_prepare_series", f"with {MS}, x as (select s, m, case when month(m)%4<>1 and m > date '1995-03-01' then n end as n from ms), f as (select s, m, last_value(n ignore nulls) over (partition by s order by m) as n from x) select * from f where n is not null")
def _(t):
    x = monthly(t).select("s", "m", F.when((F.month("m") % 4 != 1) & (F.col("m") > F.lit("1995-03-01").cast("date")), F.col("n")).alias("n"))
    return Q.prepare_series(x, ["s"], "m", "n")


@query("q11_calendar_patterns", "with d as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1) select 'weekday' as pattern, dayname(d) as slot, round(avg(n),6) as mean from d group by 2 union all select 'month', strftime(d,'%b'), round(avg(n),6) from d group by 2")
def _(t):
    d = t.orders.groupBy(F.col("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return Q.calendar_patterns(d, "d", "n").withColumn("mean", r("mean"))


@query("q11_monthly_seasonality", "with d as (select cast(o_orderdate as date) as d, count(*) as n from orders group by 1), m as (select month(d) mm, avg(n) as mean from d group by 1) select count(*) as months, round(stddev_pop(mean)/abs(avg(mean)),6) as cv, count(*)>=3 and stddev_pop(mean)/abs(avg(mean)) > 0.2 as seasonal from m")
def _(t):
    d = t.orders.groupBy(F.col("o_orderdate").alias("d")).agg(F.count("*").alias("n"))
    return Q.monthly_seasonality(Q.calendar_patterns(d, "d", "n")).withColumn("cv", r("cv"))


@query("q12_series_anomalies", f"""with {DS}, l as (select s, d, 'n' as metric, n::double as value from ds union all select s, d, 'v', v from ds), b as (select *, count(value) over w as c, avg(value) over w as mean, stddev_samp(value) over w as sd from l window w as (partition by s, metric order by d rows 6 preceding)),
  k as (select *, case when value > mean+1.8*sd then 'spike' when value < mean-1.8*sd then 'drop' end as kind from b where c >= 3) select s, d, metric, kind, round(value,2) as value, round(abs(value-mean)/abs(mean)*100,6) as pct_distance from k where kind is not null and mean <> 0""")
def _(t):
    d = Q.series_anomalies(daily(t), ["s"], "d", ["n", "v"], 7, 1.8)
    return d.select("s", "d", "metric", "kind", r("value", 2).alias("value"), r("pct_distance").alias("pct_distance"))


@query("q13_seasonal_residual", f"""with {MS}, i as (select *, (row_number() over (partition by s order by m)-1) as i from ms), f as (select s, regr_slope(n,i) sl, regr_intercept(n,i) ic from i group by 1), d as (select i.*, n-(ic+sl*i) as dt from i join f using (s)), e as (select *, avg(dt) over (partition by s, i%12) as season from d)
  select s, m, round(dt,6)+0.0 as detrended, round(season,6)+0.0 as season, round(dt-season,6)+0.0 as residual from e""")
def _(t):
    return OUT(Q.seasonal_residual(monthly(t), ["s"], "m", "n", 12), ["s", "m"], ["detrended", "season", "residual"])


@query("q14_segment_divergence", f"""with {MS}, i as (select *, row_number() over (partition by s order by m) as i from ms), g as (select s, regr_slope(v,i) sl from i group by 1), tt as (select m, sum(v) v from ms group by 1), ti as (select v, row_number() over (order by m) as i from tt), ts as (select regr_slope(v,i) as t from ti)
  select s, round(sl,4)+0.0 as slope, round(t,4)+0.0 as total_slope, sign(sl)*sign(t)<0 as diverges from g, ts""")
def _(t):
    return OUT(Q.segment_divergence(monthly(t), "s", "m", "v"), ["s", "diverges"], ["slope", "total_slope"], 4)
