"""Operator 6: context-triggered piecewise hashing.

A rolling hash of eight bytes runs over the UTF-8 text. Where its low ``k`` bits are all set a piece ends; ``k`` is the
smallest that leaves at most 64 ends, so the block size follows from the text itself. Each piece gives one of 64
letters. The fingerprint is ``k:letters:letters of k + 1``; an end for ``k + 1`` is one for ``k``, so fingerprints of
neighbouring block sizes can be compared. The likeness is one minus the edit distance over the longer length, of the
parts with equal block size, and zero where they share no run of four letters.

Defined results: a null or empty text has the fingerprint ``0::`` and likeness 1 to another such and 0 to all else;
documents are ordered by id and then text, null ids lowest; a single document is its own next; repeated rows are rows
of their own; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.llm.common import shuffle_width, stored, texts

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ENDS = 64
MARKED = "part int, role int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def rolling(data: np.ndarray) -> np.ndarray:
    """A well mixed hash of the eight bytes up to each place."""
    h, m = data.astype(np.uint32), np.uint32(0x01000193)
    for step in (1, 2, 4):
        if len(h) > step:
            h[step:] += h[:-step] * m
        m = np.uint32(int(m) * int(m) & 0xFFFFFFFF)
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    if not len(data):
        return "0::"
    h = rolling(data)
    ends_at = lambda k: np.flatnonzero((h & np.uint32((1 << k) - 1)) == np.uint32((1 << k) - 1))
    k = max(0, (len(data) // ENDS).bit_length() - 1)
    ends = ends_at(k)
    while len(ends) > ENDS and k < 32:
        k, ends = k + 1, ends_at(k + 1)
    while k and len(finer := ends_at(k - 1)) <= ENDS:
        k, ends = k - 1, finer
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])

    def letters(ends: np.ndarray) -> str:
        cuts = np.concatenate(([0], ends + 1, [len(data)] if not len(ends) or ends[-1] + 1 < len(data) else [])).astype(np.int64)
        piece = np.diff(total[cuts]) * np.uint64(0x9E3779B97F4A7C15)
        return LETTERS[(piece >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return f"{k}:{letters(ends)}:{letters(ends_at(k + 1) if k < 32 else ends[:0])}"


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _marked(batch_rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*batch_rows))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 4]
    names = ["part", "role", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _pair(text: str, own: str, following: str, next_fp: str) -> tuple:
    e = edited(text, following)
    return len(text), hashlib.sha256(e.encode()).hexdigest(), own, own if e == text else fingerprint(e), next_fp


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, its edited text and the next document in descending order of id.

    One range shuffle brings neighbours together; each partition streams through in order. The lowest document of a
    partition needs the highest of the one before: both leave the partition as marked rows, two per partition, and
    meet in a join on the partition's number.
    """

    def run(batches):
        part, last, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = last[2] if last and last[1] == text else fingerprint(text)
                if first:
                    out.append((part, 1, doc, text, len(text), None, own, None, None))
                    first = False
                else:
                    out.append((part, 0, doc, None, *_pair(text, own, last[1], last[2])))
                last = (doc, text, own)
                if len(out) == 1000:
                    yield _marked(out)
                    out = []
            if out:
                yield _marked(out)
        if last:
            yield _marked([(part, 2, last[0], last[1], None, None, last[2], None, None)])

    def finish(batches):
        for batch in batches:
            r = batch.to_pydict()
            rows = [(p, 0, d, None, *_pair(t, f, nt, nf)) for p, d, t, f, nt, nf in zip(*(r[c] for c in ("part", "doc_id", "text", "fingerprint", "next_text", "next_fp")))]
            if rows:
                yield _marked(rows)

    ordered = texts(docs).repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = stored(ordered.mapInArrow(run, MARKED), "fuzzy")
    tails = rows.where("role = 2").select(F.col("part").alias("before"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    # One number per partition that has rows, whatever the number of documents.
    parts = rows.where("role = 1").select("part")
    order = parts.select("part", F.coalesce(F.lag("part").over(W.orderBy("part")), F.max("part").over(W.partitionBy())).alias("before"))
    edges = rows.where("role = 1").select("part", "doc_id", "text", "fingerprint").join(order, "part").join(tails, "before")
    return rows.where("role = 0").unionByName(edges.mapInArrow(finish, MARKED)).drop("part", "role", "text")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1, from native string functions."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    part = lambda p, k: F.element_at(p, k)
    size = lambda p: part(p, 1).cast("int")

    def grams(x: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(x) - width + 1), lambda i: x.substr(i, width))

    def of(x: Column, y: Column) -> Column:
        longer, width = F.greatest(F.length(x), F.length(y)), F.least(F.lit(4), F.length(x), F.length(y))
        score = 1.0 - F.levenshtein(x, y) / longer
        return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).when(F.arrays_overlap(grams(x, width), grams(y, width)), score).otherwise(0.0)

    diff = size(pa_) - size(pb)
    return (
        F.when(a == b, 1.0)
        .when(diff == 0, F.greatest(of(part(pa_, 2), part(pb, 2)), of(part(pa_, 3), part(pb, 3))))
        .when(diff == 1, of(part(pa_, 2), part(pb, 3)))
        .when(diff == -1, of(part(pa_, 3), part(pb, 2)))
        .otherwise(0.0)
    )


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
