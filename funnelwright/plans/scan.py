"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from funnelwright.functions.scalars import r
from funnelwright.plans.registry import query
from funnelwright.sources import io
from funnelwright.sources.tables import TABLE_NAMES
from funnelwright.streaming.streams import work_folder


@query("s01_read_source", "select n_nationkey, n_name, n_regionkey from nation")
def _(t):
    return io.read_source(t.spark, t.path("nation"))


ROWS_SQL = " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in TABLE_NAMES)


@query("s02_read_tables", ROWS_SQL)
def _(t):
    io.read_tables(t.spark, t.dir, TABLE_NAMES)
    return t.spark.sql(ROWS_SQL)


@query("s03_list_tables", f"select table_name, 'TEMPORARY' as table_type, true as is_temporary, n_rows from ({ROWS_SQL})")
def _(t):
    io.read_tables(t.spark, t.dir, TABLE_NAMES)
    return io.list_tables(t.spark).join(t.spark.sql(ROWS_SQL), "table_name")


@query("s03_table_schemas", " union all ".join(f"select '{n}' as table_name, count(*) as n_rows, (select count(*) from (describe {n})) as n_columns from {n}" for n in TABLE_NAMES))
def _(t):
    views = io.read_tables(t.spark, t.dir, TABLE_NAMES)
    columns = io.table_schemas(t.spark, views).groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return t.spark.sql(ROWS_SQL).join(columns, "table_name")


@query("s04_latest_partition", "select max(cast(ts as date)) as latest, max(ts) is not null as ready from events where ts >= timestamp '2024-01-15'")
def _(t):
    return io.latest_partition(t.raw("events"), "ts", "2024-01-15")


@query("s05_range_scan", """select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders
  where o_orderdate >= date '1997-02-01' and o_orderdate < date '1997-03-01' group by 1""")
def _(t):
    d = io.range_scan(t.raw("orders"), "o_orderdate", "1997-02-01", "1997-02-28")
    return d.groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("s06_run_template", """select event_type, count(*) as n from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-17' and value > 100 group by 1""")
def _(t):
    return io.run_template(
        t.spark,
        "select event_type, count(*) as n from {src} where ts >= cast(:lo as timestamp_ntz) and ts < cast(:hi as timestamp_ntz) and value > :floor group by 1",
        {"lo": "2024-01-10", "hi": "2024-01-17", "floor": 100.0}, {"src": t.raw("events")},
    )


@query("s07_sample_fraction", "select count(*) as n, count(distinct o_custkey) as customers from orders where o_custkey % 10 < 3")
def _(t):
    return io.sample_fraction(t.orders, "o_custkey", 10, 3).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("s07_sample_rows")
def _(t):
    return io.sample_rows(t.orders, 100, "o_orderkey")


@query("s08_write_roundtrip", "select 'csv' as format, o_orderstatus, count(*) as n, round(sum(o_totalprice),2) as total from orders group by 2 union all select 'parquet', o_orderstatus, count(*), round(sum(o_totalprice),2) from orders group by 2")
def _(t):
    folder = work_folder(t.spark)
    io.write_csv(t.orders, f"{folder}/orders.csv")
    io.write_parquet(t.orders, f"{folder}/orders.parquet", ["o_orderstatus"])
    total = lambda df, f: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total")).select(F.lit(f).alias("format"), "o_orderstatus", "n", "total")
    return total(io.read_source(t.spark, f"{folder}/orders.csv", t.orders.schema), "csv").unionByName(total(io.read_source(t.spark, f"{folder}/orders.parquet"), "parquet"))


@query("s09_event_json", "select cast(json_extract(props, '$.k') as integer) as k, count(*) as n from events group by 1")
def _(t):
    k = F.from_json("props", "k int")["k"]
    return t.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("s09_read_jsonl_log", "select event_type as miss_type, count(*) as n, min(strftime(ts, '%Y-%m-%d')) as first_day, count(distinct user_id) as users from events group by 1")
def _(t):
    path = f"{work_folder(t.spark)}/log.jsonl"
    t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("user_id").cast("string").alias("query"), F.col("event_type").alias("miss_type"), F.col("props").alias("details")).write.json(path)
    log = io.read_jsonl_log(t.spark, path)
    return log.groupBy("miss_type").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_day"), F.count_distinct("query").alias("users"))


@query("s10_normalise_columns", "select trim(c_mktsegment) as segment, count(*) as n from customer group by 1")
def _(t):
    dirty = t.customer.select(F.concat(F.lit("﻿ "), "c_mktsegment", F.lit(" ")).alias("﻿segment "))
    return io.normalise_columns(dirty).groupBy("segment").agg(F.count("*").alias("n"))


@query("s11_coalesce_source", "select 'fallback' as source_used, count(*) as n from supplier")
def _(t):
    return io.coalesce_source(t.supplier.where("s_suppkey < 0"), t.supplier).groupBy("source_used").agg(F.count("*").alias("n"))
