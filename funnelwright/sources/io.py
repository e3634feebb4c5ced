"""Reading and writing tables, catalog listing, templates and sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc"}
MISS_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("miss_type", T.StringType()), T.StructField("details", T.StringType()),
])


def read_source(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on the suffix; without a schema only CSV is inferred by a pass over the data."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for {suffix or path}")
    reader = spark.read.schema(schema) if schema else spark.read
    fmt = FORMATS[suffix]
    if fmt == "csv":
        reader = reader.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",").option("enforceSchema", False)
        if not schema:
            reader = reader.option("inferSchema", True)
    return reader.format(fmt).load(path)


def read_tables(spark: SparkSession, directory: str, names: Sequence[str], suffix: str = ".parquet") -> dict[str, DataFrame]:
    """Each file or folder ``directory/name.suffix`` becomes a temporary view of that name."""
    out = {}
    for n in names:
        out[n] = read_source(spark, f"{directory.rstrip('/')}/{n}{suffix}")
        out[n].createOrReplaceTempView(n)
    return out


def list_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.name, t.tableType, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_name string, table_type string, is_temporary boolean")


def table_schemas(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, nullable) from metadata alone; no data is read."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def latest_partition(df: DataFrame, dt: str, floor: str) -> DataFrame:
    """Newest day at or after ``floor`` and whether there is one."""
    return df.where(F.col(dt) >= F.lit(floor).cast(dict(df.dtypes)[dt])).agg(F.to_date(F.max(dt)).alias("latest")).withColumn("ready", F.col("latest").isNotNull())


def range_scan(df: DataFrame, dt: str, lo: str, hi: str) -> DataFrame:
    """Half-open upper day bound on the raw column, so the filter reaches the file scan."""
    t = dict(df.dtypes)[dt]
    return df.where((F.col(dt) >= F.lit(lo).cast(t)) & (F.col(dt) < F.date_add(F.lit(hi).cast("date"), 1).cast(t)))


def run_template(spark: SparkSession, sql: str, args: Mapping[str, object], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Parameterised SQL: values are named parameters, tables are passed as DataFrames."""
    return spark.sql(sql, args=dict(args), **dict(tables or {}))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def sample_fraction(df: DataFrame, key: str, modulus: int, keep: int) -> DataFrame:
    """Keep the keys whose remainder is below ``keep``: whole keys stay together across tables."""
    return df.where(F.pmod(F.col(key), F.lit(modulus)) < keep)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_jsonl_log(spark: SparkSession, path: str, schema: T.StructType | str = MISS_LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Strip byte-order marks and blanks from headers and string values."""
    clean = [c.replace("﻿", "").strip() for c in df.columns]
    out = df.toDF(*clean)
    fixes = {c: F.trim(F.regexp_replace(c, "﻿", "")) for c, t in out.dtypes if t == "string"}
    return out.withColumns(fixes) if fixes else out


def coalesce_source(primary: DataFrame | None, fallback: DataFrame, names: tuple[str, str] = ("primary", "fallback")) -> DataFrame:
    """The primary table unless it is missing or empty; only one row is looked at to decide."""
    use_primary = primary is not None and not primary.isEmpty()
    chosen = primary if use_primary else fallback
    return chosen.withColumn("source_used", F.lit(names[0] if use_primary else names[1]))
