"""The given parquet tables and the analytic inputs derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from funnelwright.operators import panel
from funnelwright.sources.io import range_scan

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Stage of each event type in the funnel built from ``events``.
EVENT_STAGES = {"view": "exp", "click": "detail", "signup": "order", "purchase": "pay"}
# Stage of each priority in the multi-year funnel built from ``orders``.
PRIORITY_STAGES = {"5-LOW": "exp", "4-NOT SPECIFIED": "detail", "3-MEDIUM": "order", "2-HIGH": "pay", "1-URGENT": "pay"}


class Tables:
    """Lazy readers; zone-less timestamps become UTC timestamps so windows and watermarks accept them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.raw(name)
        raise AttributeError(name)

    def _scan(self, name: str, dt: str, lo: str | None, hi: str | None, to: str) -> DataFrame:
        """Bound the raw column first, so the filter reaches the parquet scan, then convert it."""
        df = self.raw(name) if lo is None else range_scan(self.raw(name), dt, lo, hi)
        return df.withColumn(dt, F.col(dt).cast(to))

    def events_between(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        return self._scan("events", "ts", lo, hi, "timestamp")

    def orders_between(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        return self._scan("orders", "o_orderdate", lo, hi, "date")

    def lineitem_between(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        return self._scan("lineitem", "l_shipdate", lo, hi, "date")

    @property
    def events(self) -> DataFrame:
        return self.events_between()

    @property
    def orders(self) -> DataFrame:
        return self.orders_between()

    @property
    def lineitem(self) -> DataFrame:
        return self.lineitem_between()

    def panel_between(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """Panel from ``events``: dimensions are fixed splits of the user or event id."""
        e = self.events_between(lo, hi).select(
            F.to_date("ts").alias("dt"),
            "user_id",
            panel.stage_of(F.col("event_type"), EVENT_STAGES).alias("stage"),
            F.concat(F.lit("T"), F.col("user_id") % 3).alias("terminal"),
            F.concat(F.lit("S"), F.col("event_id") % 4).alias("scene"),
            F.concat(F.lit("Z"), F.col("user_id") % 5).alias("source"),
        )
        return panel.funnel_panel(e, ["terminal", "scene", "source"])

    def order_panel_between(self, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """Multi-year panel from ``orders``: members are order status and a split of the customer id."""
        o = self.orders_between(lo, hi).select(
            F.col("o_orderdate").alias("dt"),
            F.col("o_custkey").alias("user_id"),
            panel.stage_of(F.col("o_orderpriority"), PRIORITY_STAGES).alias("stage"),
            F.concat(F.lit("B"), F.col("o_orderstatus")).alias("category"),
            F.concat(F.lit("T"), F.col("o_custkey") % 3).alias("terminal"),
        )
        return panel.funnel_panel(o, ["category", "terminal"])

    @property
    def panel(self) -> DataFrame:
        return self.panel_between()

    @property
    def order_panel(self) -> DataFrame:
        return self.order_panel_between()

    @cached_property
    def behaviour(self) -> DataFrame:
        """One row per user and active day: actions of the day, payments in the next seven days, history.

        Windows run over user-days, so a user holds at most one row per calendar day.
        """
        hi = F.col("value") > 250
        cnt = lambda et, cond=None: F.count(F.when((F.col("event_type") == et) & (F.lit(True) if cond is None else cond), 1))
        d = self.events.groupBy("user_id", F.to_date("ts").alias("dt")).agg(
            cnt("view").alias("sx_all"), cnt("view", hi).alias("sx_hi"), cnt("view", ~hi).alias("sx_lo"),
            cnt("click").alias("xd_all"), cnt("signup").alias("sc_all"), cnt("error").alias("jg_all"),
            cnt("purchase").alias("ord_0"), cnt("purchase", hi).alias("ord_hi_0"), cnt("purchase", ~hi).alias("ord_lo_0"),
        ).withColumn("_d", F.unix_date("dt"))
        u = W.partitionBy("user_id").orderBy("_d")
        week = u.rangeBetween(0, 6)
        before = u.rangeBetween(W.unboundedPreceding, -1)
        return d.withColumns({
            "source": F.concat(F.lit("G"), F.col("user_id") % 4),
            "ord_7": F.sum("ord_0").over(week), "ord_hi_7": F.sum("ord_hi_0").over(week), "ord_lo_7": F.sum("ord_lo_0").over(week),
            "register_gap": F.col("_d") - F.min("_d").over(W.partitionBy("user_id")),
            "act_30": F.count("*").over(u.rangeBetween(-29, 0)),
            "pay_gap": F.coalesce(F.col("_d") - F.max(F.when(F.col("ord_0") > 0, F.col("_d"))).over(before), F.lit(9999)),
            "ord_t": F.coalesce(F.sum("ord_0").over(before), F.lit(0)),
        }).drop("_d")


# The same inputs for DuckDB, as common table expressions.
FUNNEL_EVENTS_SQL = """fe as (
  select cast(ts as date) as dt, user_id,
         case event_type when 'view' then 'exp' when 'click' then 'detail' when 'signup' then 'order' when 'purchase' then 'pay' end as stage,
         'T' || (user_id % 3) as terminal, 'S' || (event_id % 4) as scene, 'Z' || (user_id % 5) as source
  from events)"""

_COUNTS_SQL = """count(distinct user_id) as uv_all,
  count(distinct case when stage='exp' then user_id end) as exp_uv, count(case when stage='exp' then 1 end) as exp_pv,
  count(distinct case when stage='detail' then user_id end) as detail_uv, count(case when stage='detail' then 1 end) as detail_pv,
  count(distinct case when stage='order' then user_id end) as order_uv, count(case when stage='order' then 1 end) as order_pv,
  count(distinct case when stage='pay' then user_id end) as pay_uv, count(case when stage='pay' then 1 end) as pay_pv"""

PANEL_SQL = FUNNEL_EVENTS_SQL + f""", panel as (
  select 'overall' as tag, 'overall' as member, dt, {_COUNTS_SQL} from fe group by dt
  union all select 'terminal', terminal, dt, {_COUNTS_SQL} from fe group by terminal, dt
  union all select 'scene', scene, dt, {_COUNTS_SQL} from fe group by scene, dt
  union all select 'source', source, dt, {_COUNTS_SQL} from fe group by source, dt)"""

ORDER_PANEL_SQL = f"""oe as (
  select cast(o_orderdate as date) as dt, o_custkey as user_id,
         case o_orderpriority when '5-LOW' then 'exp' when '4-NOT SPECIFIED' then 'detail' when '3-MEDIUM' then 'order'
              when '2-HIGH' then 'pay' when '1-URGENT' then 'pay' end as stage,
         'B' || o_orderstatus as category, 'T' || (o_custkey % 3) as terminal
  from orders), opanel as (
  select 'overall' as tag, 'overall' as member, dt, {_COUNTS_SQL} from oe group by dt
  union all select 'category', category, dt, {_COUNTS_SQL} from oe group by category, dt
  union all select 'terminal', terminal, dt, {_COUNTS_SQL} from oe group by terminal, dt)"""

BEHAVIOUR_SQL = """ud as (select user_id, cast(ts as date) as dt,
  count(case when event_type='view' then 1 end) as sx_all, count(case when event_type='view' and value > 250 then 1 end) as sx_hi, count(case when event_type='view' and value <= 250 then 1 end) as sx_lo,
  count(case when event_type='click' then 1 end) as xd_all, count(case when event_type='signup' then 1 end) as sc_all, count(case when event_type='error' then 1 end) as jg_all,
  count(case when event_type='purchase' then 1 end) as ord_0, count(case when event_type='purchase' and value > 250 then 1 end) as ord_hi_0, count(case when event_type='purchase' and value <= 250 then 1 end) as ord_lo_0
  from events group by 1,2), beh as (select *, 'G' || (user_id % 4) as source,
  sum(ord_0) over w7 as ord_7, sum(ord_hi_0) over w7 as ord_hi_7, sum(ord_lo_0) over w7 as ord_lo_7,
  datediff('day', min(dt) over (partition by user_id), dt) as register_gap,
  count(*) over (partition by user_id order by dt range between interval 29 day preceding and current row) as act_30,
  coalesce(datediff('day', max(case when ord_0 > 0 then dt end) over (partition by user_id order by dt range between unbounded preceding and interval 1 day preceding), dt), 9999) as pay_gap,
  coalesce(sum(ord_0) over (partition by user_id order by dt range between unbounded preceding and interval 1 day preceding), 0) as ord_t
  from ud window w7 as (partition by user_id order by dt range between current row and interval 6 day following))"""
