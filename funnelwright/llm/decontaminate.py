"""Operator 4: benchmark decontamination by a distributed positional inverted index.

Scan tasks cut the training texts into words and write the index in segments of about ``segment_words`` words: for each
(segment, term) the sorted positions of the term, for each segment the documents' ids, starts and lengths. Documents
of a segment lie one after the other in one number line, ``GAP`` apart, so a posting is one 32-bit number.

A search takes the terms of each test window from the rarest (by corpus frequency, counted over all segments) to the
most common, shifts each list by the term's offset in the window and intersects, until nothing is left or all terms
agree; ``slop`` lets every term stand up to so many words from its place (proximity). Lists of common terms are only
looked up at the few places that are left.

The terms of the test set bound what is indexed while it has at most ``block_words`` words; a larger test set is
searched in blocks, each against the same index, which then holds all terms. Neither case drops anything.

Defined results: null and empty texts, on either side, have no words, no windows and no matches; an item shorter than
the window is one window of its own length; repeated rows and equal ids are rows of their own; null item ids count as
an item whose id is left out of lists of ids; empty tables give empty or match-free results; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import shared_folder, stored, texts

GAP = 64
SEGMENT = "segment string, term binary, n long, postings binary, doc_ids array<long>, starts array<long>, lengths array<long>, hashes array<long>"
MATCH = "segment string, ordinal int, item string, first long, last long"

# Lower-cases A-Z and turns every byte that is not a letter, a digit or part of a character beyond ASCII into a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORDS).split()


class Segment:
    """Words of some documents by position, and their inverted lists."""

    def __init__(self):
        self.docs, self.hashes, self.starts, self.lengths, self.terms, self.at, self.next = [], [], [], [], [], [], 0

    def add(self, doc_id, hashed: int, terms: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.hashes.append(hashed - (hashed >> 63 << 64))
        self.starts.append(self.next)
        self.lengths.append(len(terms))
        keep = np.flatnonzero(terms >= 0)
        self.terms.append(terms[keep])
        self.at.append(keep + self.next)
        self.next += len(terms) + GAP

    def rows(self, name: str, names: list[bytes]) -> pa.RecordBatch:
        terms, at = np.concatenate(self.terms), np.concatenate(self.at).astype("<u4" if self.next < 1 << 32 else "<u8")
        order = np.argsort(terms, kind="stable")
        terms, at = terms[order], at[order]
        cuts = np.flatnonzero(np.diff(terms)) + 1
        lists = np.split(at, cuts) if len(terms) else []
        own = [names[t] for t in terms[np.concatenate(([0], cuts))]] if len(terms) else []
        k = len(own)
        return pa.RecordBatch.from_arrays([
            pa.array([name] * (k + 1)), pa.array([*own, None], pa.binary()), pa.array([*map(len, lists), len(self.docs)], pa.int64()),
            pa.array([*(x.tobytes() for x in lists), b"8" if at.dtype.itemsize == 8 else b"4"], pa.binary()),
            *(pa.array([*[None] * k, x], pa.list_(pa.int64())) for x in (self.docs, self.starts, self.lengths, self.hashes)),
        ], ["segment", "term", "n", "postings", "doc_ids", "starts", "lengths", "hashes"])


def build_index(docs: DataFrame, vocabulary: list[bytes] | None = None, segment_words: int = 2_000_000) -> DataFrame:
    """The stored positional index of all documents: of the given terms only, or of every term."""
    from xxhash import xxh64_intdigest

    given = vocabulary and {t: k for k, t in enumerate(vocabulary)}

    def run(batches):
        part, count = f"{TaskContext.get().partitionId():06d}", 0
        seg, local = Segment(), {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                if given is not None:
                    terms = np.fromiter(map(given.get, w, [-1] * len(w)), np.int64, len(w))
                else:
                    terms = np.fromiter((local.setdefault(x, len(local)) for x in w), np.int64, len(w))
                seg.add(doc, xxh64_intdigest(text.encode(), 42), terms)
                if seg.next >= segment_words:
                    yield seg.rows(f"{part}-{count}", vocabulary if given is not None else list(local))
                    seg, local, count = Segment(), {}, count + 1
        if seg.docs:
            yield seg.rows(f"{part}-{count}", vocabulary if given is not None else list(local))

    if vocabulary is not None and not vocabulary:
        given, vocabulary = {}, []
    return stored(texts(docs).mapInArrow(run, SEGMENT), "postings")


def windows_of(items: list[tuple], window: int) -> dict[tuple[bytes, ...], list]:
    """Distinct windows and the items they come from."""
    out: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            own = out.setdefault(tuple(w[i : i + window]), [])
            if item not in own:
                own.append(item)
    return out


def near(at: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
    """Which of the places have a posting within ``slop`` words."""
    k = np.searchsorted(at, places - slop)
    return (k < len(at)) & (at[np.minimum(k, len(at) - 1)] <= places + slop)


def search(index: DataFrame, items: list[tuple], window: int = 10, slop: int = 0, own_index: bool = False) -> DataFrame:
    """Merged places (segment, document ordinal, item, first and last word) where windows of the items occur.

    One task searches one segment, whose size ``segment_words`` bounds; the items are the test set or a block of it.
    ``own_index`` says that the index holds these items' terms and no other, so that nothing has to be picked from it.
    """
    if 2 * slop >= GAP:
        raise ValueError(f"documents lie {GAP} words apart, so the slop must be under {GAP // 2}")
    wanted = windows_of(items, window)
    terms = sorted({t for w in wanted for t in w})
    spark = index.sparkSession
    if not terms:
        return spark.createDataFrame([], MATCH)
    # One number per test term, whatever the size of the corpus.
    asked = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
    lists = index.where(F.col("term").isNotNull()) if own_index else index.join(asked, "term", "left_semi")
    frequency = {bytes(r.term): r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    plans = []
    for w, own in wanted.items():
        if all(t in frequency for t in w):
            plans.append((sorted(range(len(w)), key=lambda k: (frequency[w[k]], k)), w, own))
    plans.sort(key=lambda p: p[1])

    def run(key, rows):
        head = rows[rows["term"].isna()].iloc[0]
        wide = "<u8" if bytes(head["postings"]) == b"8" else "<u4"
        starts, lengths = np.asarray(head["starts"], np.int64), np.asarray(head["lengths"], np.int64)
        held = rows[rows["term"].notna()]
        at = {bytes(t): np.frombuffer(p, wide).astype(np.int64) for t, p in zip(held["term"], held["postings"])}
        found = {}
        for order, w, own in plans:
            if not all(t in at for t in w):
                continue
            places = at[w[order[0]]] - order[0]
            for k in order[1:]:
                if not len(places):
                    break
                places = places[near(at[w[k]], places + k, slop)]
            if len(places):
                doc = np.searchsorted(starts, places + (len(w) - 1), side="right") - 1
                ok = (doc >= 0) & (places >= starts[doc]) & (places + len(w) <= starts[doc] + lengths[doc]) if not slop else doc >= 0
                for d, p in zip(doc[ok].tolist(), (places - starts[doc])[ok].tolist()):
                    for item in own:
                        found.setdefault((d, item), []).append((max(p, 0), min(p + len(w), int(lengths[d])) - 1))
        out = []
        for (d, item), spans in found.items():
            spans.sort()
            first, last = spans[0]
            for a, b in spans[1:]:
                if a > last + 1:
                    out.append((key[0], d, item, first, last))
                    first, last = a, b
                else:
                    last = max(last, b)
            out.append((key[0], d, item, first, last))
        return pd.DataFrame(out, columns=["segment", "ordinal", "item", "first", "last"])

    needed = index if own_index else lists.select(*index.columns).unionByName(index.where(F.col("term").isNull()))
    return needed.groupBy("segment").applyInPandas(run, MATCH)


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_hash() -> Column:
    """What tells rows with one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, block_words: int = 2_000_000) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``text_hash`` (``text_hash()`` of its row) and ``matches``, the
    merged places of each item found in it.

    The test set is read in blocks of at most about ``block_words`` words (by a hash of the item), so what the driver
    and each task hold of it is bounded; one block, the usual case, lets the index leave out terms it never asks for.
    """
    items = benchmark_items(benchmark)
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-size // (6 * block_words)))
    block_of = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    take = lambda k: [(r.item, r.text) for r in items.where(block_of == k).collect()]
    if blocks == 1:
        own = take(0)
        index = build_index(docs, sorted({w for _, t in own for w in words_of(t)}))
        found = search(index, own, window, slop, own_index=True)
    else:
        index = build_index(docs)
        found = None
        for k in range(blocks):
            hits = search(index, take(k), window, slop)
            found = hits if found is None else found.unionByName(hits)
    heads = index.where(F.col("term").isNull()).select("segment", F.posexplode(F.arrays_zip("doc_ids", "lengths", "hashes")).alias("ordinal", "d"))
    # A document's places number at most its words times the items that share them.
    places = found.groupBy("segment", "ordinal").agg(F.sort_array(F.collect_list(F.struct("first", "last", "item"))).alias("matches"))
    return heads.join(places, ["segment", "ordinal"], "left").select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_words"), F.col("d.hashes").alias("text_hash"),
        F.coalesce("matches", F.array().cast("array<struct<first:bigint,last:bigint,item:string>>")).alias("matches"),
    )


def digests(found: DataFrame) -> DataFrame:
    """Words hit, items found and their digest, from the places."""
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, m: F.struct(
        F.greatest(acc["end"], m["last"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0).cast("long"), m["last"] - F.greatest(acc["end"], m["first"] - 1))).alias("n"),
    )
    n_hit = F.aggregate("matches", start, step, lambda acc: acc["n"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
