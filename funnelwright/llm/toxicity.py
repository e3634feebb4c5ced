"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has the probability that its words give; the document's is their
noisy-or, one minus the product of what is left. Only documents have labels, and the weights are fitted to those
through the noisy-or, so the sentences that make a document toxic are found without sentence labels.

Features are words and the first four and five letters of longer words, so that stems with unseen endings count.
Those that go with the label are chosen by document counts over the training rows (a Spark aggregation); the fit runs
on the chosen features of a bounded sample of labelled rows. Scoring reads whole texts and needs no shuffle.

Defined results: null and empty texts have no sentence and score 0; repeated rows and equal or null ids are scored
each; with no labels, or no feature chosen, every score is that of a document without evidence; empty tables give
empty ones; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelwright.llm.common import held_out, stored, texts

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
# Rows a fit may use: a bounded sample by hash of the id.
FIT_ROWS = 20_000
SCORED = "doc_id long, score double, sentences array<struct<first: int, after: int, score: double>>"


def features_of(word: str) -> tuple[str, ...]:
    return ("=" + word, *(word[:k] for k in (4, 5) if len(word) > k))


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def _chosen(train: DataFrame, least_chi2: float, least_docs: int) -> dict[str, float]:
    """Features at least twice as frequent in labelled documents, with a chi-square of at least ``least_chi2``, and the log of how much more frequent they are."""

    def count(batches):
        pos, neg = {}, {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                own, into = set(), pos if label else neg
                for w in set(WORD.findall(text.lower())):
                    own.update(features_of(w))
                for f in own:
                    into[f] = into.get(f, 0) + 1
        names = list({**pos, **neg})
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "pos": pa.array([pos.get(f, 0) for f in names], pa.int64()), "neg": pa.array([neg.get(f, 0) for f in names], pa.int64())})

    size = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {}
    found = train.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    p, q, n = F.col("p").cast("double"), F.col("q").cast("double"), float(n0 + n1)
    diff = p * (n0 - q) - q * (n1 - p)
    chi2 = n * diff * diff / ((p + q) * F.greatest(F.lit(n) - p - q, F.lit(1.0)) * float(n0) * float(n1))
    ratio = F.log((p + 0.5) / (n1 + 1.0) / ((q + 0.5) / (n0 + 1.0))).alias("ratio")
    own = found.where((p >= least_docs) & (p / n1 > 2 * q / n0) & (chi2 >= least_chi2)).select("feature", ratio)
    return {r.feature: r.ratio for r in own.orderBy("feature").collect()}


def _bags(train: DataFrame, names: list[str]) -> DataFrame:
    """For each training row: its label, its sentences without a chosen feature, and the features of the others."""
    known = {f: k for k, f in enumerate(names)}

    def run(batches):
        for batch in batches:
            labels, clean, bags = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                bag, none = [], 0
                for s in SENTENCE.findall(text):
                    own = sorted({known[f] for w in WORD.findall(s.lower()) for f in features_of(w) if f in known})
                    if own:
                        bag.append(own)
                    else:
                        none += 1
                labels.append(label)
                clean.append(none)
                bags.append(bag)
            yield pa.RecordBatch.from_pydict({"label": pa.array(labels, pa.int32()), "clean": pa.array(clean, pa.int64()), "bag": pa.array(bags, pa.list_(pa.list_(pa.int32())))})

    return train.mapInArrow(run, "label int, clean long, bag array<array<int>>")


def _fit_noisy_or(labels: np.ndarray, clean: np.ndarray, bags: list, first: np.ndarray, steps: int = 1500, rate: float = 0.1, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """Bias and weights, starting from ``first``, by gradient steps on the log-likelihood of the labels under the noisy-or."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    sent = np.array([k for k, s in enumerate(s for bag in bags for s in bag) for _ in s], np.int64)
    feat = np.array([f for bag in bags for s in bag for f in s], np.int64)
    n_sent, n = len(doc), len(labels)
    size = len(first)
    w = np.append(first, -6.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        p0 = sigmoid(w[-1])
        ps = sigmoid(w[-1] + np.bincount(sent, w[feat], n_sent))
        left = clean * math.log1p(-p0) + np.bincount(doc, np.log1p(-np.minimum(ps, 1 - 1e-12)), n)
        none = np.exp(left)
        # d loss / d log(product of what is left): 1 for clean documents, -none / (1 - none) for toxic ones.
        pull = np.where(labels == 1, none / np.maximum(1 - none, 1e-9), -1.0)
        g = np.zeros_like(w)
        by_sent = -pull[doc] * ps
        g[:-1] = np.bincount(feat, by_sent[sent], size)
        g[-1] = by_sent.sum() - (pull * clean).sum() * p0
        g = g / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        # The floor keeps a weight that hardly matters to any document near where it started.
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w[:-1] *= 1 - rate * decay
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, least_chi2: float = 30.0, least_docs: int = 5) -> Model:
    """A model from at most ``rows`` labelled rows outside the held-out third, chosen by a hash of the id."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = stored(texts(docs).join(chosen, "doc_id").select("text", "label").repartition(12), "labelled-texts")
    names = _chosen(train, least_chi2, least_docs)
    if not names:
        return Model(-6.0, {})
    # The sample is bounded, and only chosen features of its sentences come to the driver.
    bags = _bags(train, list(names)).collect()
    bias, weights = _fit_noisy_or(np.array([b.label for b in bags]), np.array([b.clean for b in bags], float), [b.bag for b in bags], np.array(list(names.values())))
    return Model(bias, {f: float(x) for f, x in zip(names, weights)})


def scored(docs: DataFrame, model: Model, sentence_at: float = 0.5) -> DataFrame:
    """Score of every document, and the places (code points) of its sentences that score at least ``sentence_at``."""
    weights, bias = model.weights, model.bias

    def run(batches):
        seen: dict[str, tuple] = {}
        for batch in batches:
            if len(seen) > 500_000:
                seen.clear()
            scores, places = [], []
            for text in batch.column(1).to_pylist():
                left, found, clean = 0.0, [], 0
                for s in SENTENCE.finditer(text):
                    own = set()
                    for w in WORD.findall(s[0].lower()):
                        got = seen.get(w)
                        if got is None:
                            got = seen[w] = tuple(f for f in features_of(w) if f in weights)
                        if got:
                            own.update(got)
                    if not own:
                        clean += 1
                        continue
                    z = bias + sum(weights[f] for f in sorted(own))
                    left -= math.log1p(math.exp(min(z, 700.0)))
                    p = 1 / (1 + math.exp(-max(min(z, 700.0), -700.0)))
                    if p >= sentence_at:
                        found.append({"first": s.start(), "after": s.end(), "score": p})
                scores.append(-math.expm1(left - clean * math.log1p(math.exp(bias))))
                places.append(found)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(places, kind)], ["doc_id", "score", "sentences"])

    return texts(docs).mapInArrow(run, SCORED)


def digests(found: DataFrame, at: float = 0.7) -> DataFrame:
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "sentences")
