"""Column helpers shared by every operator; all stay inside generated code."""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def ratio(num: str | Column, den: str | Column) -> Column:
    """Null when the divisor is zero or missing."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def change(cur: str | Column, base: str | Column, scale: float = 1.0) -> Column:
    """Relative change, null when the base is zero or missing."""
    return F.try_divide(col(cur).cast("double") - col(base).cast("double"), col(base).cast("double")) * scale


def pct_change(cur: str | Column, base: str | Column) -> Column:
    return change(cur, base, 100.0)


# --- dates -----------------------------------------------------------------

def week_start(dt: str | Column) -> Column:
    """Monday of the week of ``dt``."""
    d = col(dt)
    return F.date_sub(d, F.pmod(F.datediff(d, F.lit("1970-01-05").cast("date")), F.lit(7)))


def week_end(dt: str | Column) -> Column:
    return F.date_add(week_start(dt), 6)


def month_key(dt: str | Column) -> Column:
    return F.date_format(col(dt), "yyyy-MM")


def month_index(dt: str | Column) -> Column:
    """Whole months since year 0; differences are month offsets."""
    return F.year(col(dt)) * 12 + F.month(col(dt)) - 1


def in_period(dt: str | Column, lo, hi) -> Column:
    """Closed date interval on the bare column, so partitions prune."""
    return col(dt).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))


def shift(day: str, days: int) -> str:
    from datetime import date, timedelta

    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


# --- buckets and labels ------------------------------------------------------

def bucketise(c: str | Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = False) -> Column:
    """Label of the interval holding ``c``: len(labels) == len(edges) + 1, edges ascending."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, lab in zip(edges, labels):
        out = out.when(x <= e if right_closed else x < e, F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


def bucket_index(c: str | Column, edges: Sequence[float], right_closed: bool = False) -> Column:
    """Position of the interval holding ``c`` (0-based), for ordering labels."""
    x = col(c)
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, e in enumerate(edges):
        out = out.when(x <= e if right_closed else x < e, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def map_category(rules: Sequence[tuple[Column, str]]) -> Column:
    """First matching label; unmatched rows give null and are filtered by the caller."""
    out = None
    for cond, lab in rules:
        out = F.when(cond, lab) if out is None else out.when(cond, lab)
    return out.otherwise(F.lit(None).cast("string"))


def like_any(c: str | Column, patterns: Sequence[str]) -> Column:
    x, out = col(c), F.lit(False)
    for p in patterns:
        out = out | x.like(p)
    return out


def tier_rank(c: str | Column) -> Column:
    """Number after Z in a tier label, 999 when there is none."""
    n = F.regexp_extract(col(c), r"[Zz]\s*(\d+)", 1)
    return F.when(n == "", F.lit(999)).otherwise(n.try_cast("int"))


# --- text forms of numbers ---------------------------------------------------

def parse_percent(c: str | Column) -> Column:
    """'1.129%' -> 0.01129, a plain number as it is; '-', blank and null -> null."""
    x = F.regexp_replace(F.trim(col(c)), r"[,\s]", "")
    number = F.regexp_extract(x, r"^([+-]?\d+(?:\.\d+)?)%?$", 1).try_cast("double")
    return F.when(x.endswith("%"), number / 100.0).otherwise(number)


def parse_value_change(c: str | Column) -> tuple[Column, Column]:
    """'0.903% (WoW:-6.07%)' -> (0.903, -6.07) in percent units."""
    x = col(c)
    value = F.regexp_extract(x, r"^\s*([+-]?[\d,]+(?:\.\d+)?)", 1)
    chg = F.regexp_extract(x, r"\([^)]*?([+-]?\d+(?:\.\d+)?)%\s*\)", 1)
    return F.regexp_replace(value, ",", "").try_cast("double"), chg.try_cast("double")


def fmt_percent(c: str | Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", col(c)), F.lit("%"))


def fmt_signed_percent(c: str | Column, digits: int = 2) -> Column:
    return F.coalesce(F.when(col(c).isNotNull(), F.concat(F.format_string(f"%+.{digits}f", col(c)), F.lit("%"))), F.lit("-"))


def fmt_int(c: str | Column) -> Column:
    return F.coalesce(F.format_number(F.round(col(c)), 0), F.lit("-"))


def _missing(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("", "-")


def fmt_cell(value: Column, chg: Column) -> Column:
    """'1,234 (+5.60%)'; without a change the value alone, without a value '-'."""
    return F.when(_missing(value), "-").when(chg.isNull(), value).otherwise(F.concat(value, F.lit(" ("), fmt_signed_percent(chg), F.lit(")")))


def fmt_cell_dual(value: Column, mom: Column, yoy: Column) -> Column:
    """'1,234 (+5.60%｜+1.20%)'; a missing change is '-', without a value the cell is '-'."""
    return F.when(_missing(value), "-").otherwise(F.concat(value, F.lit(" ("), fmt_signed_percent(mom), F.lit("｜"), fmt_signed_percent(yoy), F.lit(")")))


# --- metric expressions --------------------------------------------------------

def metric_expr(expr: str, metrics: Sequence[str]) -> Column:
    """Arithmetic over named metric columns as a Column; every division gives null where the divisor is zero."""

    def of(node: ast.AST) -> Column:
        match node:
            case ast.Name(id=name):
                if name not in metrics:
                    raise ValueError(f"unknown metric {name}")
                return F.col(name)
            case ast.Constant(value=value) if type(value) in (int, float):
                return F.lit(value)
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -of(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return of(x)
            case ast.BinOp(op=op, left=x, right=y) if type(op) in BINARY:
                return BINARY[type(op)](of(x), of(y))
        raise ValueError(f"only arithmetic is allowed: {expr}")

    try:
        tree = ast.parse(expr.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"only arithmetic is allowed: {expr}") from e
    return of(tree.body)


BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


# --- shape ---------------------------------------------------------------------

def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "metric", value: str = "value", dtype: str = "double") -> DataFrame:
    """One row per (ids, column)."""
    return df.unpivot(list(ids), [col(c).cast(dtype).alias(c) for c in cols], name, value)


def stack_groups(df: DataFrame, ids: Sequence[str], groups: Mapping[str, Mapping[str, Column]], name: str) -> DataFrame:
    """One row per (ids, group) holding that group's columns under shared names."""
    structs = [F.struct(F.lit(g).alias(name), *[c.alias(k) for k, c in cols.items()]) for g, cols in groups.items()]
    return df.select(*ids, F.explode(F.array(*structs)).alias("_g")).select(*ids, "_g.*")


def members(df: DataFrame, dims: Sequence[str], keep: Sequence[str | Column], overall: bool = True, tag: str = "tag", member: str = "member") -> DataFrame:
    """Each row once per dimension (and once as 'overall'), for one aggregation over all dimensions."""
    pairs = [F.struct(F.lit("overall").alias(tag), F.lit("overall").alias(member))] if overall else []
    pairs += [F.struct(F.lit(d).alias(tag), F.col(d).cast("string").alias(member)) for d in dims]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_m")).select(*[c for c in _names(df, keep)], "_m.*")


def _names(df: DataFrame, keep) -> list[str]:
    return df.select(*keep).columns
