"""Run a registered query on Spark and its SQL on DuckDB and compare whole results."""

from __future__ import annotations

import math

import duckdb

from funnelwright.sources.tables import TABLE_NAMES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _type_ok(spark_type: str, duck_type: str) -> bool:
    if spark_type.startswith("array<"):
        return duck_type == TYPES.get(spark_type[6:-1], "?") + "[]"
    if spark_type.startswith("map<"):
        return duck_type.startswith("MAP")
    if spark_type.startswith("decimal"):
        return duck_type.startswith("DECIMAL")
    return TYPES.get(spark_type) == duck_type


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dict):
        return sorted((k, _norm(x)) for k, x in v.items())
    if isinstance(v, list):
        return [_norm(x) for x in v]
    if hasattr(v, "tzinfo") and getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def compare(df, sql: str, con) -> tuple[list[str], int]:
    """Problems (none when schema and every row agree exactly) and the number of rows on Spark."""
    problems = []
    rel = con.sql(sql)
    dcols = dict(zip(rel.columns, [str(t) for t in rel.types]))
    scols = dict(df.dtypes)
    if sorted(dcols) != sorted(scols):
        return [f"columns differ: spark {sorted(scols)} / sql {sorted(dcols)}"], 0
    for c in scols:
        if not _type_ok(scols[c], dcols[c]):
            problems.append(f"type of {c}: spark {scols[c]} / sql {dcols[c]}")
    cols = sorted(scols)
    got = df.select(*[f"`{c}`" for c in cols]).collect()
    q = ", ".join(f'"{c}"' for c in cols)
    want = con.execute(f"select {q} from ({sql.rstrip().rstrip(';')}) q").fetchall()
    if len(got) != len(want):
        problems.append(f"rows: spark {len(got)} / sql {len(want)}")
    def rows(rs):
        return sorted((repr(tuple(_norm(v) for v in r)) for r in rs))
    a, b = rows([tuple(r) for r in got]), rows(want)
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"values: only spark {[x for x in a if x not in sb][:3]} / only sql {[x for x in b if x not in sa][:3]} ({len(sa - sb)}/{len(sb - sa)} rows), cols {cols}")
    return problems, len(got)


def differences(df, sql: str, con) -> list[str]:
    return compare(df, sql, con)[0]
