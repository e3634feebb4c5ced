"""Streaming queries drained from the given files."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import r
from funnelwright.operators import checks as V
from funnelwright.plans.registry import query
from funnelwright.streaming import streams as R


def source(t):
    return R.read_events(t.spark, t.dir)


# What a watermark of a day closes: windows that end no later than the last event less that day.
CLOSED = "(select max(ts) - interval 1 day from events)"


@query("r01_stream_funnel_panel", f"""select cast(ts as date) as dt, count(distinct user_id) as uv_all, count(case when event_type='view' then 1 end) as exp_pv, count(case when event_type='click' then 1 end) as detail_pv, count(case when event_type='signup' then 1 end) as order_pv, count(case when event_type='purchase' then 1 end) as pay_pv
  from events where date_trunc('day', ts) + interval 1 day <= {CLOSED} group by 1""")
def _(t):
    return R.run_available(R.stream_funnel_panel(source(t))).drop("batch_id")


@query("r01_stream_stage_counts", "select cast(ts as date) as dt, count(case when event_type='view' then 1 end) as exp_pv, count(case when event_type='click' then 1 end) as detail_pv, count(case when event_type='signup' then 1 end) as order_pv, count(case when event_type='purchase' then 1 end) as pay_pv from events group by 1")
def _(t):
    return R.run_to_end(source(t), R.stream_funnel_panel).drop("uv_all", "batch_id")


SESSIONS = """p as (select *, lag(ts) over (partition by user_id order by ts, event_id) as p from events), n as (select *, sum(case when p is null or epoch_us(ts)-epoch_us(p) >= 43200000000 then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from p)"""


@query("r02_stream_sessions", f"""with {SESSIONS}
  select user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as session_start, count(*) as events from n group by user_id, k""")
def _(t):
    d = R.run_to_end(source(t), lambda e: R.stream_sessions(e, "12 hours"))
    return d.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query("r02_stream_visits", f"""with {SESSIONS}
  select user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') as visit_start, strftime(max(ts),'%Y-%m-%d %H:%M:%S') as visit_end, count(*) as events, max(case event_type when 'view' then 1 when 'click' then 2 when 'signup' then 3 when 'purchase' then 4 else 0 end)::int as furthest from n group by user_id, k having epoch_ms(max(ts)) + 43200000 <= (select epoch_ms(max(ts)) - 3600000 from events)""")
def _(t):
    own = R.with_keyed_state(t.spark)
    d = R.run_available(R.stream_visits(R.read_events(own, t.dir), 43_200))
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return d.select("user_id", f("visit_start"), f("visit_end"), "events", "furthest")


@query("r03_stream_dedup", "select event_type, count(*) as n, round(sum(value),2) as total from events group by 1")
def _(t):
    # Both copies of an id come in the same batch; a watermark of two hours holds the ids of two hours only.
    copies = source(t).unionByName(source(t))
    d = R.run_available(R.stream_dedup(copies, "2 hours"))
    return d.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query("r04_stream_checks", """select 'range' as "check", 'value' as subject, case when count(case when value>450 then 1 end)/count(value)::double>0.05 then 'BLOCKER' when count(case when value>450 then 1 end)>0 then 'WARNING' else 'PASS' end as severity, count(case when value>450 then 1 end) as n_bad from events
  union all select 'completeness', 'user_id', 'PASS', 0 from events having count(*)>0 union all select 'row_count', 'rows', 'PASS', 0 from events having count(*)>0""")
def _(t):
    rules = lambda b: V.scan_checks(b, [V.value_range("value", 0, 450), V.completeness("user_id"), V.row_count(1)])
    return R.run_available(source(t), rules).select("check", "subject", "severity", "n_bad")


@query("r05_stream_rate", """with d as (select cast(ts as date) as d, 'k' || (user_id%4) as kind from events where event_type='error'), s as (select d - i as week_start, kind from d, (select unnest(range(0,7))::int as i)) select week_start, kind, count(*) as n, round(count(*)/7.0::double,6) as per_day from s group by 1,2""")
def _(t):
    log = source(t).where("event_type = 'error'").withColumn("kind", F.concat(F.lit("k"), F.col("user_id") % 4))
    return R.run_to_end(log, lambda e: R.stream_rate(e, "kind")).withColumn("per_day", r("per_day")).drop("batch_id")
