"""Operator 8: quality by a sparse rule ensemble.

Byte and word statistics of every text are computed in Arrow batches. A random forest of shallow trees is grown on a
bounded sample of the labelled rows that may be learnt from; every path from a root is a rule, a conjunction of
limits on statistics. A logistic regression with an L1 penalty weighs the rules, most get no weight, and the rest are
compiled into one Spark column: the sigmoid of the weights of the rules that hold.

Defined results: null and empty texts have statistics of zero and get a score like any other; repeated rows and equal
or null ids are scored each; with no labels to learn from the score is 0.5, with one class only it is that class;
empty tables give empty ones; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import held_out, stored, texts

STATS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "exclaim", "symbol", "bar", "stop", "comma", "line_end", "beyond_ascii", "space", "control",
    "distinct_words", "repeated_words", "top_word", "distinct_lines", "short_words", "capital_words",
)
# Rows a fit may use: a bounded sample by hash of the id, enough for rules of three conditions.
FIT_ROWS = 20_000


def _class_shares(data: bytes) -> list[float]:
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / max(1, len(data))
    at = lambda s: float(h[list(s)].sum())
    return [
        float(h[65:91].sum()), float(h[48:58].sum()), at(b"!"), at(b"*#$%&@^~=<>{}[]_+\\"), at(b"|"), at(b".?"), at(b",;:"), at(b"\n"), float(h[128:].sum()), at(b" \t"),
        float(h[:9].sum() + h[14:32].sum() + h[127]),
    ]


def statistics_of(text: str) -> list[float]:
    """One number for each name in ``STATS``, from the whole text."""
    data = text.encode()
    w = data.split()
    n = max(1, len(w))
    counts = Counter(w)
    lines = [x for x in data.split(b"\n") if x]
    repeated = sum(a == b for a, b in zip(w, w[1:]))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(w))), sum(map(len, w)) / n, *_class_shares(data),
        len(counts) / n, repeated / n, max(counts.values(), default=0) / n, len(set(lines)) / max(1, len(lines)),
        sum(c for x, c in counts.items() if len(x) <= 3) / n, sum(c for x, c in counts.items() if len(x) > 1 and x.isupper()) / n,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every text, stored once."""

    def run(batches):
        for batch in batches:
            rows = np.array([statistics_of(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(STATS)))], ["doc_id", *STATS])

    return stored(texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS)), "statistics")


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of every text as one more column, the struct ``_stats``, without a join."""

    @F.pandas_udf("struct<" + ", ".join(f"{s}: double" for s in STATS) + ">")
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in text], columns=list(STATS), dtype="float64")

    return docs.withColumn("_stats", of(F.coalesce("text", F.lit(""))))


@dataclass
class Rules:
    """A bias and weighted conjunctions of (statistic, whether above, limit)."""

    bias: float
    rules: list[tuple[float, tuple[tuple[str, bool, float], ...]]]

    def score(self, at: str = "") -> Column:
        """The score as a column; ``at`` stands before the names of the statistics."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            total = total + F.when(holds(conditions, at), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def holds(conditions: tuple, at: str = "") -> Column:
    parts = [F.col(at + s) > limit if above else F.col(at + s) <= limit for s, above, limit in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def paths(forest) -> list[tuple]:
    """Every distinct path from a root of the forest, with the limits on each statistic drawn together."""
    found: dict[tuple, None] = {}

    def walk(node, limits: dict) -> None:
        if limits:
            found[tuple(sorted((s, above, v) for (s, above), v in limits.items()))] = None
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, v = STATS[split.featureIndex()], split.threshold()
        walk(node.leftChild(), {**limits, (name, False): min(v, limits.get((name, False), v))})
        walk(node.rightChild(), {**limits, (name, True): max(v, limits.get((name, True), v))})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, trees: int = 20, depth: int = 3, penalty: float = 0.001) -> Rules:
    """Rules learnt from at most ``rows`` labelled rows outside the held-out third, chosen by a hash of the id."""
    own = labels.select("doc_id", F.col(label).cast("double").alias("label")).where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    first = stats.groupBy("doc_id").agg(*[F.min(s).alias(s) for s in STATS])
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = stored(first.join(chosen, "doc_id").repartition(6, "doc_id"), "training").persist()
    found = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        train.unpersist()
        return Rules(0.0 if not found else 20.0 if 1.0 in found else -20.0, [])
    vector = train.select("label", array_to_vector(F.array(*STATS)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="onethird", minInstancesPerNode=20, maxMemoryInMB=64).fit(vector)
    rules = paths(forest)
    held = train.select("label", array_to_vector(F.array(*[holds(c).cast("double") for c in rules])).alias("features")).persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(held)
    held.unpersist()
    train.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return Rules(float(lasso.intercept), [(w, c) for w, c in zip(weights, rules) if w != 0.0])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    stats = statistics(docs)
    return stats.select("doc_id", fit(stats, labels).score().alias("score"))


def digests(found: DataFrame, at: float = 0.5) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
