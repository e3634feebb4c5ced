"""Phrase and punctuation patterns over a document table; whole texts, counted inside the engine."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.functions.scalars import ratio


def _escape(phrase: str) -> str:
    return re.escape(phrase).replace("\\ ", " ").replace("\\-", "-")


def _longest_first(phrases: Sequence[str]) -> list[str]:
    return sorted(phrases, key=lambda p: (-len(p), p))


def _by_first_letter(phrases: Sequence[str]) -> str:
    """Alternation branching on the first letter, so a position is compared with few phrases."""
    letters: dict[str, list[str]] = {}
    for p in _longest_first(phrases):
        letters.setdefault(p[0], []).append(p[1:])
    return "|".join(f"{_escape(c)}(?:{'|'.join(_escape(x) for x in tails)})" for c, tails in sorted(letters.items()))


def _starts(phrase: str, words: bool) -> list[int]:
    """Positions inside a phrase where another phrase could begin."""
    return [i for i in range(1, len(phrase)) if not words or re.match(r"\b\w", phrase[i:]) and not (phrase[i - 1].isalnum() or phrase[i - 1] == "_")]


def self_overlaps(phrases: Sequence[str], words: bool) -> bool:
    """Whether a phrase can begin inside another of the group, so that counting starts would count twice."""
    return any(q.startswith(p[i:]) or p[i:].startswith(q) for p in phrases for i in _starts(p, words) for q in phrases)


# Punctuation and markup marks.
MARKS = {
    "dashes": "[–—]",
    "curly_quotes": "[‘’“”]",
    "emoji": "[\U0001F300-\U0001FAFF☀-➿]",
    "bold": r"\*\*[^*\n]+\*\*",
}

# Contrast and triple-list forms.
CONTRASTS = {
    "not_x_its_y": r"(?i)\bnot (just |only |merely )?[^.,;!?]+[,;] (it's|it is|they're|but)\b",
    "not_only": r"(?i)\bnot only\b[^.!?]+\bbut\b",
    "triple": r"(?i)\b\w+, \w+,? and \w+\b",
    "the_real_is": r"(?i)\bthe real \w+ is\b",
    "tailing_no": r"(?i), no \w+(?: \w+)?[.!?]",
    "zh_not_only": "不仅[^。！？]+[更而]",
    "zh_not_but": "不是[^。！？]+而是",
    "zh_both": "既[^。！？]+又",
    "zh_triple": r"[\x{4e00}-\x{9fff}]{2,4}、[\x{4e00}-\x{9fff}]{2,4}、[\x{4e00}-\x{9fff}]{2,4}",
}

# Chinese signal words and fillers with a gap, which ends at the sentence mark.
PATTERNS_ZH = {
    "foundation": "奠定了[^。！？]*基础",
    "role": "发挥了(?:关键|核心|重要)作用",
    "milestone": "是[^。！？]*的重要里程碑",
    "development": "推动了[^。！？]*的发展",
    "chapter": "开启了[^。！？]*的新篇章",
    "wave": "在[^。！？]*浪潮中",
    "in_order_to": "为了能够实现[^。！？]*这一目标",
    "because_of": "由于[^。！？]*的原因",
    "able_to": "具备[^。！？]*的能力",
    "effect_of": "起到了[^。！？]*的作用",
}


def pattern_counts(docs: DataFrame, text: str, patterns: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """One count column per pattern in a single projection."""
    return docs.select(*keep, *[F.regexp_count(F.col(text), F.lit(p)).alias(k) for k, p in patterns.items()])


def phrase_hits(docs: DataFrame, text: str, lexicon: Mapping[str, Sequence[str]], keep: Sequence[str | Column], words: bool = True) -> DataFrame:
    """Hits per phrase group, all groups from one pass over each text.

    A zero-width pattern reports the longest phrase of the whole lexicon at every start; a group is hit there
    exactly when one of its phrases is a prefix of that phrase. Groups whose phrases can overlap each other
    are counted by a pattern of their own.
    """
    single = {g: p for g, p in lexicon.items() if not self_overlaps(p, words)}
    every = sorted({p for ps in single.values() for p in ps})
    letters = "".join(sorted({_escape(p[0]) for p in every}))
    start = f"(?=[{letters}])\\b" if words else ""
    names = docs.select(*keep).columns
    d = docs.select(*keep, (F.lower(text) if words else F.col(text)).alias("_t"))
    found = F.regexp_extract_all("_t", F.lit(f"{start}(?=({_by_first_letter(every)}))"), F.lit(1)) if every else F.array().cast("array<string>")
    own = {g: F.regexp_count("_t", F.lit((r"\b" if words else "") + "(" + "|".join(_escape(x) for x in _longest_first(p)) + ")")) for g, p in lexicon.items() if g not in single}
    d = d.select(*names, found.alias("_f"), *[c.alias(g) for g, c in own.items()])

    def among(hits: list[str]) -> Column:
        return F.size(F.filter("_f", lambda m: m.isin(hits)))

    counts = [among([m for m in every if any(m.startswith(p) for p in ps)]).alias(g) if g in single else F.col(g) for g, ps in lexicon.items()]
    return d.select(*names, *counts)


def punctuation_tells(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return pattern_counts(docs, text, MARKS, keep)


def contrast_patterns(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return pattern_counts(docs, text, CONTRASTS, keep)


def zh_patterns(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return pattern_counts(docs, text, PATTERNS_ZH, keep)


def rhythm(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences, mean and spread of their length in words, and runs of three equal lengths, per document.

    Sentences stay inside their document's row as an array, so nothing is shuffled.
    """
    sentences = F.filter(F.transform(F.split(F.col(text), r"[.!?]+"), lambda s: F.trim(s)), lambda s: s != "")
    d = docs.select(key, F.transform(sentences, lambda s: F.size(F.split(s, r"\s+"))).alias("n"))
    k = F.size("n")
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    same = F.filter(F.sequence(F.lit(1), k - 2), lambda i: (F.get("n", i - 1) == F.get("n", i)) & (F.get("n", i) == F.get("n", i + 1)))
    return d.select(key, k.cast("long").alias("sentences"), ratio(total, k).alias("mean_words"), F.array_max("n").cast("long").alias("longest"), F.when(k >= 3, F.size(same)).otherwise(0).cast("long").alias("equal_runs"))


def text_score(docs: DataFrame, text: str, lexicon: Mapping[str, Sequence[str]], keep: Sequence[str], words: bool = True) -> DataFrame:
    """Hits of all groups per 1,000 characters."""
    h = phrase_hits(docs, text, lexicon, [*keep, F.length(text).alias("chars")], words)
    hits = sum((F.col(g) for g in lexicon), F.lit(0))
    return h.select(*keep, "chars", hits.cast("long").alias("hits")).withColumn("density", F.coalesce(F.try_divide(F.col("hits") * 1000.0, F.col("chars")), F.lit(0.0)))


def score_summary(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents, hits and pooled density per group."""
    g = scores.groupBy(*by).agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"), F.sum("chars").alias("chars"), F.count(F.when(F.col("hits") > 0, 1)).alias("docs_with_hits"))
    return g.withColumn("density", F.coalesce(F.try_divide(F.col("hits") * 1000.0, F.col("chars")), F.lit(0.0)))
