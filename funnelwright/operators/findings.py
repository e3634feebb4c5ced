"""Findings and lineage as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.lexicons import DIMENSION_WORDS, THEMES
from funnelwright.functions.scalars import ratio
from funnelwright.operators.ordered import running
from funnelwright.session import cut_lineage


def score_findings(df: DataFrame) -> DataFrame:
    """Magnitude, breadth, actionability and confidence, 0–25 each, and the total."""
    base, value = F.col("baseline_value"), F.col("metric_value")
    pct = F.abs(value - base) / F.abs(base)
    magnitude = F.when(base == 0, F.when(value != 0, 15).otherwise(5)).when(pct > 0.5, 25).when(pct > 0.2, 20).when(pct > 0.1, 15).when(pct > 0.05, 10).otherwise(5)
    a = F.coalesce(F.col("affected_pct"), F.lit(0.0))
    breadth = F.when(a > 0.5, 25).when(a > 0.3, 20).when(a > 0.1, 15).when(a > 0.05, 10).otherwise(5)
    act = F.when(F.col("actionable"), 25).otherwise(5)
    act = F.when(F.col("effect_size") > 0.5, F.least(act + 5, F.lit(25))).otherwise(act)
    conf = F.bround(F.coalesce(F.col("confidence"), F.lit(0.0)) * 25).cast("int")
    conf = F.when(F.col("p_value") < 0.05, F.least(conf + 5, F.lit(25))).otherwise(conf)
    d = df.withColumns({"magnitude": magnitude, "breadth": breadth, "actionability": act, "conf_score": F.greatest(F.lit(0), F.least(F.lit(25), conf))})
    return d.withColumn("score", F.col("magnitude") + F.col("breadth") + F.col("actionability") + F.col("conf_score"))


def rank_findings(scored: DataFrame, key: str) -> DataFrame:
    """Rank by score, ties by key; numbered piece by piece, so bulk findings do not meet in one task."""
    return running(scored.withColumn("_neg", -F.col("score")), [], ["_neg", key], row_number="rank").drop("_neg")


def theme_of(description: Column, category: Column) -> Column:
    out = F.when(category != "", F.initcap(category))
    text = F.lower(description)
    for theme, words in THEMES.items():
        out = out.when(text.rlike("|".join(re.escape(w) for w in words)), theme)
    return out.otherwise("Other")


def theme_findings(scored: DataFrame) -> DataFrame:
    """Themes ordered by their best score with size and leading finding."""
    t = scored.withColumn("theme", theme_of(F.col("description"), F.coalesce(F.col("category"), F.lit(""))))
    g = t.groupBy("theme").agg(F.count("*").alias("n"), F.count(F.when(F.col("actionable"), 1)).alias("n_actionable"), F.max("score").alias("best"), F.max_by("description", F.struct("score", "finding_id")).alias("leader"), F.count(F.when(F.col("score") >= 60, 1)).alias("n_high"))
    return g.orderBy(F.desc("best"), "theme")


def contradictions(df: DataFrame, metric: str = "metric_name", large: float = 0.2, sure: float = 0.8) -> DataFrame:
    """For every finding with a direction, how many others contradict it under each rule.

    Rule 1: same metric, opposite direction. Rule 2: an upward finding against a decline covering more than
    ``large`` of the users. Rule 3: both confident and opposite. A pair counts under the first rule it meets.
    Counts come from totals per (metric, direction): pairs are never formed, so a metric holding a third of all
    findings costs no more than its rows.
    """
    d = df.where(F.col("direction").isin("up", "down")).withColumn("_m", F.lower(metric))
    big, conf = F.col("affected_pct") > large, F.col("confidence") >= sure
    n = lambda c: F.count(F.when(c, 1))
    kinds = {"n": F.lit(True), "big": big, "conf": conf, "conf_small": conf & ~big}
    up, down = F.col("direction") == "up", F.col("direction") == "down"
    aggs = [n(s & c).alias(f"{side}_{k}") for side, s in (("up", up), ("down", down)) for k, c in kinds.items()]
    per = d.groupBy("_m").agg(*aggs)
    total = per.agg(F.struct(*[F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in ("up", "down") for k in kinds]).alias("t"))
    j = d.join(per, "_m").withColumn("_t", total.scalar())
    other = lambda s, k: F.col(f"_t.{s}_{k}") - F.col(f"{s}_{k}")
    rule1 = F.when(up, F.col("down_n")).otherwise(F.col("up_n"))
    rule2 = F.when(up, other("down", "big")).when(big, other("up", "n")).otherwise(0)
    rule3 = F.when(~conf, 0).when(up, other("down", "conf_small")).when(big, 0).otherwise(other("up", "conf"))
    return j.select("finding_id", metric, "direction", rule1.alias("same_metric"), rule2.alias("large_decline"), rule3.alias("both_confident"))


def meta_patterns(df: DataFrame, themes: DataFrame | None = None) -> DataFrame:
    """Dimension words in at least two findings, whether directions agree and, with the ``themes`` of
    :func:`theme_findings`, themes that hold two or more high scores."""
    words = F.array(*[F.lit(w) for w in DIMENSION_WORDS])
    hit = F.filter(words, lambda w: F.contains(F.lower(F.col("description")), w))
    w = df.select(F.explode(hit).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("dimension").alias("pattern"), "name", "n")
    up, down = F.count(F.when(F.col("direction") == "up", 1)), F.count(F.when(F.col("direction") == "down", 1))
    total = F.count(F.when(F.col("direction") != "", 1))
    kind = F.when((total >= 2) & (up == total), "all up").when((total >= 2) & (down == total), "all down").when((up >= 2) & (down >= 2), "mixed")
    a = df.agg(kind.alias("name"), total.alias("n")).where("name is not null").select(F.lit("direction").alias("pattern"), "name", "n")
    both = w.unionByName(a)
    if themes is None:
        return both
    return both.unionByName(themes.where("n_high >= 2").select(F.lit("theme").alias("pattern"), F.col("theme").alias("name"), F.col("n_high").alias("n")))


# --- merging findings of several sources -------------------------------------------

def normalise_text(c: Column) -> Column:
    """Lower case without punctuation, numbers and repeated blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+", " "))


def union_merge(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dedup_merge(df: DataFrame, category: str, issue: str, source: str) -> DataFrame:
    """One row per (category, normalised text): first source and how many others repeat it."""
    g = df.groupBy(category, normalise_text(F.col(issue)).alias("issue_key")).agg(F.min(source).alias("first_source"), F.count("*").alias("n"))
    s = df.groupBy(category, normalise_text(F.col(issue)).alias("issue_key"), source).agg(F.lit(1).alias("one")).groupBy(category, "issue_key").agg(F.count("one").alias("sources"))
    return g.join(s, [category, "issue_key"])


def consensus_merge(df: DataFrame, category: str, issue: str, source: str, n_sources: int) -> DataFrame:
    """Two or more sources confirm a finding, a single one leaves it tentative."""
    s = df.groupBy(category, normalise_text(F.col(issue)).alias("issue_key"), source).agg(F.lit(1).alias("one")).groupBy(category, "issue_key").agg(F.count("one").alias("votes"))
    return s.withColumns({"status": F.when(F.col("votes") >= 2, "confirmed").otherwise("tentative"), "confidence": F.col("votes") / F.lit(float(n_sources))})


def scored_merge(df: DataFrame, item: str, dimension: str, score: str) -> DataFrame:
    """Mean score per dimension and the mean over dimensions per item."""
    g = df.groupBy(item, dimension).agg(F.avg(score).alias("mean_score"))
    return g.withColumn("total", F.avg("mean_score").over(W.partitionBy(item)))


# --- lineage --------------------------------------------------------------------------

def lineage_edges(log: DataFrame) -> DataFrame:
    """(child, parent): a step reads what another step wrote; ``log(step, inputs[], outputs[])``."""
    i = log.select(F.col("step").alias("child"), F.explode("inputs").alias("table"))
    o = log.select(F.col("step").alias("parent"), F.explode("outputs").alias("table"))
    return i.join(o, "table").where("child <> parent").select("child", "parent", "table").distinct()


def lineage_ancestors(log: DataFrame, start: DataFrame) -> DataFrame:
    """(step, depth): every step upstream of the start steps in ``log(step, inputs[], outputs[])`` or in edges
    ``(child, parent)``, level by level until nothing new appears, however deep the lineage is.

    The frontier alternates between the two sides of the graph: from steps to the tables they read that were not met
    before, from those to the steps that write them. So each read and each write is followed once, and pairs of steps
    are never formed, whatever number of them shares a table. Reached sets and frontier are checkpointed each round,
    so the plan stays flat and a lost executor costs one round.
    """
    if "parent" in log.columns:
        reads, writes = log.select(F.col("child").alias("step"), F.col("parent").alias("table")), log.select(F.col("parent").alias("step"), F.col("parent").alias("table"))
    else:
        reads, writes = log.select("step", F.explode("inputs").alias("table")), log.select("step", F.explode("outputs").alias("table"))
    reads, writes = cut_lineage(reads.distinct()), cut_lineage(writes.distinct())
    frontier = start.select("step").distinct()
    seen = cut_lineage(frontier.withColumn("depth", F.lit(0)))
    met = None
    for depth in count(1):
        tables = reads.join(frontier, "step", "left_semi").select("table").distinct()
        tables = cut_lineage(tables.join(met, "table", "left_anti") if met is not None else tables)
        frontier = cut_lineage(writes.join(tables, "table", "left_semi").select("step").distinct().join(seen, "step", "left_anti"))
        if frontier.isEmpty():
            break
        met = cut_lineage(met.unionByName(tables)) if met is not None else tables
        seen = cut_lineage(seen.unionByName(frontier.withColumn("depth", F.lit(depth))))
    return seen


def miss_summary(log: DataFrame, kind: str, ts: str, end: str, days: int) -> DataFrame:
    """Totals by type, share, and per-day rate inside the last ``days`` days."""
    recent = (F.col(ts) > F.lit(end).cast("timestamp") - F.expr(f"interval {days} days")) & (F.col(ts) <= F.lit(end).cast("timestamp"))
    g = log.groupBy(kind).agg(F.count("*").alias("n"), F.count(F.when(recent, 1)).alias("recent"))
    return g.withColumns({"share": ratio("n", F.sum("n").over(W.partitionBy())), "per_day": F.col("recent") / F.lit(float(days))})  # one row per type
