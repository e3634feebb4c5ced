"""Operator 9: SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits, each the majority over the XXH64 values of its word shingles. Correlated bits,
measured on a bounded sample of fingerprints, are grouped into parts; a dynamic programme gives each part its own
threshold so that the thresholds plus one sum to the radius plus one, at the least estimated number of probes and
candidates. Two fingerprints within the radius then agree within the threshold on at least one part: every distinct
fingerprint is indexed under its value in each part, probes all values within the part's threshold, and candidates
are verified on all bits.

Buckets of more than ``bucket`` fingerprints are not paired. Every fingerprint that lies in or probes such a bucket
gives itself and its 64 one-bit neighbours as points instead; two fingerprints are within two bits exactly when they
share a point, and those that share one are linked to the smallest of them. So no group emits its square, and no link
is lost. Other radii would need other points: ``links`` takes radii 0 to 2.

Defined results: null and empty texts, and those of white space only, have fingerprint zero and link like any other;
rows with equal ids or a null id are rows of their own, and a component whose ids are all null has a null id; an empty
table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import stored, texts
from funnelwright.llm.graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SAMPLE = 4096


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words, repeats included; shorter texts are one shingle."""
    from xxhash import xxh64_intdigest as h

    w = text.encode().translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= width:
        return np.array([h(b" ".join(w), 42)], np.uint64)
    n = len(w) - width + 1
    return np.fromiter((h(b" ".join(s), 42) for s in zip(*(w[k : n + k] for k in range(width)))), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed number) of every document, stored once."""

    def run(batches):
        for batch in batches:
            fps = [majority(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return stored(texts(docs).mapInArrow(run, "doc_id long, fp long"), "fingerprints")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Group bit positions into parts of nearly equal size, each grown by the bit most correlated with it."""
    with np.errstate(all="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(64)
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [free.pop(0)]
        while len(own) < size:
            gain = corr[np.ix_(free, own)].sum(1)
            own.append(free.pop(int(np.argmax(gain))))
        out.append(sorted(own))
    return out


def allocate(cost: list[list[float]], radius: int) -> list[int]:
    """Thresholds per part (-1: the part is not probed) with sum(threshold + 1) = radius + 1 at the least total cost.

    ``cost[i][t]`` is the estimated cost of threshold ``t - 1`` in part ``i``.
    """
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(np.inf, [])] * (radius + 1)
    for own in cost:
        best = [min(((best[s - t][0] + own[t], [*best[s - t][1], t - 1]) for t in range(min(s, len(own) - 1) + 1)), key=lambda x: x[0]) for s in range(radius + 2)]
    return best[radius + 1][1]


def plan(sample: np.ndarray, total: int, radius: int = 2) -> list[tuple[list[int], int]]:
    """Parts and thresholds with the least estimated work for ``total`` fingerprints, from a sample of them."""
    bits = np.unpackbits(sample.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(sample) else np.zeros((0, 64), np.uint8)
    best = None
    for m in range(2, radius + 3):
        parts, cost = correlated_parts(bits, m), []
        for own in parts:
            w = len(own)
            probes = np.cumsum([1, w, w * (w - 1) // 2])[: radius + 1]
            value = bits[:1024, own].astype(np.float32)
            near = value @ (1 - value.T)
            distance = near + near.T
            pairs = max(1, len(value) * (len(value) - 1))
            # Candidates of one probe set: the sample's share of pairs, at least what chance gives.
            share = [max((float((distance <= t).sum()) - len(value)) / pairs, probes[t] / 2.0**w) for t in range(radius + 1)]
            cost.append([0.0] + [total * float(probes[t]) + total * total * share[t] for t in range(radius + 1)])
        taus = allocate(cost, radius)
        price = sum(c[t + 1] for c, t in zip(cost, taus)) + total * m
        if best is None or price < best[0]:
            best = (price, list(zip(parts, taus)))
    return [(own, t) for own, t in best[1] if t >= 0]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _around(flips: Column, value: Column, of) -> Column:
    """``of`` each value that one of the flips makes."""
    return F.transform(flips, lambda x: of(value.bitwiseXOR(x)))


def links(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct fingerprints ``fp`` such that what they connect is what the radius connects."""
    if not 0 <= radius <= 2:
        raise ValueError("the radius may be 0, 1 or 2")
    total = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    parts = plan(sample, total, radius)
    key = lambda k, col: F.struct(F.lit(k).alias("part"), col.alias("value"))
    fp = F.col("fp")
    indexed, probed = [], []
    for k, (own, tau) in enumerate(parts):
        mask = sum(1 << b for b in own)
        value = fp.bitwiseAND(F.lit(signed(mask)))
        flips = [signed(sum(1 << b for b in c)) for t in range(tau + 1) for c in combinations(own, t)]
        indexed.append(key(k, value))
        # The flips of a part are a fixed list: 1, its width, or half its square.
        probed.append(_around(F.array(*[F.lit(f).cast("long") for f in flips]), value, lambda v, k=k: key(k, v)))
    index = fps.select("fp", F.explode(F.array(*indexed)).alias("k")).select("fp", "k.part", "k.value")
    probes = fps.select(F.col("fp").alias("q"), F.explode(F.flatten(F.array(*probed))).alias("k")).select("q", "k.part", "k.value")
    sizes = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > bucket).select("part", "value"), "large-buckets")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius
    cold = index.join(large, ["part", "value"], "left_anti")
    pairs = probes.join(cold, ["part", "value"]).where(F.col("q") < F.col("fp")).where(near).select(F.col("q").alias("a"), F.col("fp").alias("b"))
    # In or beside a large bucket: points instead of pairs. Equal fingerprints are one, so at most 65 share a point.
    dense = probes.join(large, ["part", "value"], "left_semi").select(F.col("q").alias("fp")).distinct()
    flips = F.array(*[F.lit(signed(x)).cast("long") for x in ([0] + [1 << b for b in range(64)] * (radius > 0))])
    points = dense.select("fp", F.explode(F.transform(flips, lambda x: fp.bitwiseXOR(x))).alias("point"))
    around = points.groupBy("point").agg(F.collect_set("fp").alias("own")).where(F.size("own") > 1)
    shared = around.select(F.array_min("own").alias("a"), F.explode("own").alias("b")).where("a <> b")
    if radius == 1:
        shared = shared.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return pairs.unionAll(shared).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, bucket: int = 64) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id that links of at most ``radius`` bits reach."""
    marked = fingerprints(docs, width)
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), radius, bucket)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(ids, "fp")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
