"""Operator 2: personal data by candidate gradient boosting, in DataFrame functions only.

Base spans of four kinds follow fixed patterns and checks. Looser generators propose further spans, which may overlap
each other and base spans. Each candidate gets format and context features with few values each. Boosted trees are
fitted to whether a candidate is also a base span, without seeing the checks themselves, from the counts of every
feature vector: Spark groups all candidates by vector, so the fit reads a table whose size the product of the
features' values bounds, whatever the corpus. The trees are compiled into column expressions. A threshold per kind,
calibrated on the same counts, is the lowest score at which the share of true spans stays at or above ``precision``.
Candidates over it that touch no base span are added; of overlapping ones the better stays, then the earlier.

Positions are counted in code points, end exclusive.

Defined results: null and empty texts have no spans; repeated rows and equal or null ids are rows of their own; without
candidates no tree is grown and the base spans stay; empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import stored, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The base patterns. Possessive repeats match what the plain ones do, in one pass: a match starts where a run of its
# letters starts (or where the last match ended), and what follows a repeat is never one of its own letters.
# Of the card pattern only whole runs of 14 to 19 digits are taken, since others never pass.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Looser forms: written-out separators, groups inside longer runs, national numbers.
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:@| ?[\[(]at[\])] ?){HOST}++(?:(?:\.| ?[\[(]dot[\])] ?){HOST}++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.| ?[\[(]dot[\])] ?)[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])",
}
# What a text must hold for a pattern to match at all; spares most texts the pattern.
NEEDS = {"email": r"@|at[\])]", "ip": r"[0-9](?:\.| ?[\[(]dot)", "card": r"[0-9][ .-]?[0-9][ .-]?[0-9][ .-]?[0-9]", "phone": r"[0-9][ .-]?[0-9][ .-]?[0-9]"}
# Base phones may hold any run of separators between digits; all they are sure to have is their start.
BASE_NEEDS = NEEDS | {"phone": r"\+[0-9]"}
FEATURES = ("kind", "digits", "grouping", "before", "after", "lead", "host", "cue")


def _matches(text: Column, pattern: str, needed: str) -> Column:
    """Array of (start, end, value) of the leftmost matches that do not overlap: what lies between them gives the places."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["value"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], one)).alias("out"))

    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(needed), found).otherwise(none)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: counted from the right, every second digit doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _features(kind: int, text: Column, m: Column) -> Column:
    """Format and context of a candidate, each with few values; none of them is a base check."""
    one = lambda x, otherwise: F.when(x == "", 0).when(x.rlike(r"[\s]"), 1).when(x.rlike(r"[.,;:!?)\]\"']"), 2).when(x.rlike(r"[0-9]"), 3).otherwise(otherwise)
    value, n = m["value"], F.length(_digits(m["value"]))
    before = text.substr(m["start"], F.lit(1))
    after = text.substr(m["end"] + 1, F.lit(1))
    around = F.lower(text.substr(F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))))
    grouping = (
        F.when(value.rlike(r"\[|\(at|\(dot"), 5).when(value.rlike(r"^\+.*\("), 4).when(value.rlike(r"^\+"), 3).when(value.rlike(r"\("), 2)
        .when(value.rlike(r"[0-9][ -][0-9]"), 1).otherwise(0)
    )
    return F.struct(
        F.lit(kind).alias("kind"), F.when(n == 0, 0).when(n < 4, 1).when(n < 10, 2).when(n < 11, 3).when(n < 12, 4).when(n < 14, 5).when(n < 16, 6).otherwise(7).alias("digits"),
        grouping.alias("grouping"), F.when(m["start"] == 0, 0).otherwise(one(before, 4)).alias("before"), one(after, 4).alias("after"),
        F.when(value.rlike(r"^\+?0"), 0).when(value.rlike(r"^\+?[1-3]"), 1).when(value.rlike(r"^\+?[4-6]"), 2).when(value.rlike(r"^\+?[7-9]"), 3).otherwise(4).alias("lead"),
        F.when(value.rlike(r"@.*\.[A-Za-z]{2,}$"), 2).when(value.rlike(r"@.*\."), 1).otherwise(0).alias("host"),
        around.rlike(r"mail|tel|phone|call|mobil|fax|\bip\b|server|host|addr|card|visa|account|contact").cast("int").alias("cue"),
    )


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``base`` spans (start, kind, end) and ``candidates`` (span, whether it is a base span, features)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    text = F.col("text")
    df = df.withColumns({f"_b{k}": _matches(text, BASE[kind], BASE_NEEDS[kind]) for k, kind in enumerate(KINDS)} | {f"_l{k}": _matches(text, LOOSE[kind], NEEDS[kind]) for k, kind in enumerate(KINDS)})

    def base(k: int, kind: str) -> Column:
        kept = F.filter(F.col(f"_b{k}"), lambda m: _passes(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end")))

    def loose(k: int) -> Column:
        return F.transform(F.col(f"_l{k}"), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), _features(k, text, m).alias("x")))

    df = df.withColumn("base", F.array_sort(F.flatten(F.array(*[base(k, kind) for k, kind in enumerate(KINDS)]))))
    is_base = lambda c: F.array_contains(F.col("base"), F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    every = F.flatten(F.array(*[loose(k) for k in range(len(KINDS))]))
    df = df.withColumn("_c", every)
    candidates = F.transform("_c", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), is_base(c).alias("is_base"), c["x"].alias("x")))
    return df.select("doc_id", "base", candidates.alias("candidates"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


@dataclass
class Boosted:
    """Trees over feature values, as nested (feature, limit, left, right) with numbers as leaves, and thresholds per kind."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def margin(self, x: dict) -> float:
        def leaf(t):
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            return t

        return self.bias + sum(leaf(t) for t in self.trees)

    def column(self, x: Column) -> Column:
        def of(t) -> Column:
            return F.when(x[t[0]] <= t[1], of(t[2])).otherwise(of(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(self.bias)
        for t in self.trees:
            total = total + of(t)
        return 1.0 / (1.0 + F.exp(-total))


def _tree(rows: list, depth: int, penalty: float = 1.0):
    """A regression tree on gradients and hessians; ``rows`` are (features, count, gradient, hessian)."""
    g, h = sum(r[2] for r in rows), sum(r[3] for r in rows)
    best = None
    if depth:
        for f in FEATURES:
            sums: dict[int, list[float]] = {}
            for x, _, a, b in rows:
                s = sums.setdefault(x[f], [0.0, 0.0])
                s[0], s[1] = s[0] + a, s[1] + b
            gl = hl = 0.0
            for v in sorted(sums)[:-1]:
                gl, hl = gl + sums[v][0], hl + sums[v][1]
                gain = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = (gain, f, v)
    if best is None:
        return 0.3 * -g / (h + penalty)
    _, f, v = best
    return f, v, _tree([r for r in rows if r[0][f] <= v], depth - 1, penalty), _tree([r for r in rows if r[0][f] > v], depth - 1, penalty)


def boost(counts: list[tuple[dict, int, int]], rounds: int = 40, depth: int = 3, precision: float = 0.9) -> Boosted:
    """Fit to (features, candidates, base spans among them) with the logistic loss, then calibrate the thresholds."""
    n, p = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not n or not p:
        return Boosted()
    model = Boosted(math.log((p + 0.5) / (n - p + 0.5)))
    margins = [model.bias] * len(counts)
    for _ in range(rounds):
        rows = []
        for (x, m, q), z in zip(counts, margins):
            s = 1 / (1 + math.exp(-z))
            rows.append((x, m, m * s - q, m * s * (1 - s) + 1e-9))
        t = _tree(rows, depth)
        model.trees.append(t)
        one = Boosted(0.0, [t])
        margins = [z + one.margin(x) for z, (x, _, _) in zip(margins, counts)]
    for k in range(len(KINDS)):
        own = sorted(((1 / (1 + math.exp(-z)), m, q) for (x, m, q), z in zip(counts, margins) if x["kind"] == k), reverse=True)
        m = q = 0
        for j, (s, a, b) in enumerate(own):
            m, q = m + a, q + b
            if (j + 1 == len(own) or own[j + 1][0] < s) and q >= precision * m:
                model.thresholds[k] = s - 1e-9
    return model


def fit(found: DataFrame, precision: float = 0.9) -> Boosted:
    """A model from all candidates, grouped by feature vector; the vectors number at most a product of small counts."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.x").agg(F.count("*").alias("n"), F.sum(F.col("c.is_base").cast("long")).alias("p")).collect()
    counts = sorted(((r.x.asDict(), r.n, r.p) for r in rows), key=lambda r: tuple(r[0].values()))
    return boost(counts, precision=precision)


def with_spans(found: DataFrame, model: Boosted) -> DataFrame:
    """Adds ``spans``: the base spans and the candidates that the model adds, by start, kind and end."""
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def wanted(c: Column, score: Column) -> Column:
        out = F.lit(False)
        for k, t in model.thresholds.items():
            out = out | ((c["kind"] == k) & (score >= t))
        return out

    fresh = F.filter("candidates", lambda c: ~c["is_base"] & ~F.exists("base", lambda b: touches(b, c)))
    rated = F.transform(fresh, lambda c: F.struct((-model.column(c["x"])).alias("rank"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    good = F.array_sort(F.filter(rated, lambda c: wanted(c, -c["rank"])))
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # From the best down: a candidate stays unless it touches one that stayed.
    added = F.aggregate(good, none, lambda acc, c: F.when(F.exists(acc, lambda a: touches(a, c)), acc).otherwise(F.array_append(acc, plain(c))))
    found = found.withColumn("_added", F.when(F.size("candidates") == 0, none).otherwise(added))
    return found.withColumn("spans", F.array_sort(F.concat("base", "_added"))).drop("_added")


def redacted(docs: DataFrame, model: Boosted) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; a text without spans stays as it is.

    Spans of different kinds may overlap; what overlaps becomes one mark, of the kind that starts first.
    """
    names = docs.columns
    found = with_spans(find(docs, tuple(c for c in names if c != "doc_id") if "doc_id" in names else tuple(names)), model)
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"] + 1)
        fresh = s["start"] >= acc["at"]
        gap = text.substr(acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, name)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("spans") == 0, text).otherwise(clean)).select(*names)


def spans_of(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` of every document, with a model fitted to all of them."""
    found = stored(find(docs), "personal-data")
    return with_spans(found, fit(found, precision)).select("doc_id", "base", "spans")


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
