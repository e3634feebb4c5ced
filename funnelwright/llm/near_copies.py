"""Near copies by the similarity of word shingles, for the pipeline's SimHash stage.

Two texts are near copies when the Jaccard similarity of their sets of five-word shingles is at least 0.8. SimHash
fingerprints within two bits give part of those pairs only: at a similarity of 0.8 fingerprints of 64 bits differ in
about nine bits. So texts are gathered in buckets of two kinds: what the fingerprints' links connect (operator 9), and
equal keys in one of ``BANDS`` bands of minimum hashes over the same shingle hashes. Then, over distinct texts:

1. Each text is compared with ``CENTRES`` texts at most: of its buckets' centres (the text whose buckets hold the most)
   those it shares most buckets with. So pairs grow with the texts, whatever the size of a bucket.
2. Buckets that hang together after that are done. The texts of all others go through an exact join: shingles are
   ordered by rarity, and of two texts with similarity 0.8 the shorter has among its rarest ninth, the longer among its
   rarest fifth a shared shingle, so far to the front that what follows can still make up the overlap. Only pairs that
   are not connected yet and meet these bounds become candidates. Nothing is capped, divided or sampled: within the
   buckets' texts every pair of the wanted similarity is found or already connected.
3. Every candidate is checked on the shingles themselves, and what is similar is united.

A pair is missed only if it shares no bucket at all: 7 in 100,000 at a similarity of exactly 0.8, far fewer above.

Defined results: equal texts are one node; null counts as empty, and all texts without words are copies of each other.
Of what hangs together the row with the smallest doc_id stays (a null id only if there is no other; then the smallest
text digest); of rows equal in id and text the one whose other columns have the smallest hash stays. All columns come
back as they were, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import give_back, stored
from funnelwright.llm.graph import components
from funnelwright.llm.simhash import links, majority, shingle_hashes

# 24 bands of 5 minimum hashes: of pairs with similarity 0.8 all but 7 in 100,000 share a band, of 0.9 practically all.
BANDS, ROWS = 24, 5
CENTRES = 2
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key per band from the distinct shingle hashes of a text, and one bit of every minimum hash in two numbers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(h), 2048):
        x = h[lo : lo + 2048, None] * _A + _B
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(0), out=low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32)
    for k in range(ROWS):
        keys = (keys ^ low[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    bits = np.packbits(np.pad((low & np.uint64(1)).astype(bool), (0, 128 - BANDS * ROWS)), bitorder="little").view("<i8")
    return keys.view(np.int64), bits


def digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """Identity, digest of the text, fingerprint, band keys and bits of the minimum hashes of every row."""

    def run(batches):
        for batch in batches:
            fps, bands, low, high, size = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingle_hashes(t, width)
                own = np.unique(h)
                keys, bits = band_keys(own)
                fps.append(majority(h))
                # Texts without words are one bucket of their own: the key that no minimum hashes give.
                bands.append(keys if len(h) else np.array([-1]))
                low.append(int(bits[0]))
                high.append(int(bits[1]))
                size.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(size, pa.int64())],
                ["doc_id", "tid", "fp", "bands", "low", "high", "size"],
            )
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, tid string, fp long, bands array<long>, low long, high long, size long"), "shingles")


def _nodes(marked: DataFrame) -> DataFrame:
    """One row per distinct text with a number of its own; equal texts have equal fingerprints and bands."""
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("least")
    each = marked.groupBy("tid").agg(least, *[F.first(c).alias(c) for c in ("fp", "bands", "low", "high", "size")])
    # Numbers are given once, by the job that writes them.
    return stored(each.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")


def _buckets(nodes: DataFrame, radius: int) -> DataFrame:
    """``bucket`` and ``node`` for every bucket of two texts or more."""
    close = components(links(nodes.select("fp").distinct(), radius)).withColumnRenamed("node", "fp")
    linked = nodes.select("node", "fp").join(close, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit("fingerprint")).alias("bucket"), "node")
    every = nodes.select(F.explode("bands").alias("bucket"), "node").unionAll(linked)
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return stored(every.join(shared, "bucket"), "buckets")


def _to_centre(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
    """At most ``CENTRES`` pairs per text: the text and those of its buckets' centres that it shares most buckets with."""
    crowd = buckets.groupBy("node").agg(F.sum("n").alias("crowd"))
    marks = nodes.select("node", "low", "high")
    own = buckets.select("bucket", "node").join(crowd.join(marks, "node"), "node")
    centres = own.groupBy("bucket").agg(F.max(F.struct("crowd", "node", "low", "high")).alias("c"))
    away = F.bit_count(F.col("low").bitwiseXOR(F.col("c.low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("c.high")))
    near = own.join(centres, "bucket").where("node <> c.node").groupBy("node", F.col("c.node").alias("b")).agg(F.count("*").alias("shared"), F.first(away).alias("away"))
    # Unlikely to be similar (agreeing bits of 120 four deviations below those of similarity 0.8): left to the exact join.
    best = near.where("away <= 26").groupBy("node").agg(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("s"), "away", "b"))).alias("c"))
    pair = best.select("node", F.explode(F.slice("c", 1, CENTRES)).alias("c"))
    return pair.select(F.least("node", "c.b").alias("a"), F.greatest("node", "c.b").alias("b")).distinct()


def _texts_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``text`` of the wanted nodes, stored. Copies of a text become one row per task before they meet."""
    named = wanted.join(nodes.select("node", "tid"), "node")
    own = docs.select(digest().alias("tid"), F.coalesce("text", F.lit("")).alias("text")).groupBy("tid").agg(F.first("text").alias("text"))
    return stored(own.join(named, "tid").select("node", "text"), "bucket-texts")


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs of nodes whose texts' shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep, last, b = [], None, None
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                # Pairs lie by their second text, so its shingles are hashed once.
                if y != last:
                    last, b = y, np.unique(shingle_hashes(y, width))
                a = np.unique(shingle_hashes(x, width))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    named = lambda c, t: texts.select(F.col("node").alias(c), F.col("text").alias(t))
    both = pairs.join(named("a", "ta"), "a").join(named("b", "tb"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _rare_pairs(nodes: DataFrame, roots: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs of the nodes that have ``roots`` that are not connected and can be similar: prefix, length and position filter."""

    def run(batches):
        for batch in batches:
            own = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], ["node", "shingles"])
        give_back()

    sets = stored(texts.join(roots, "node", "left_semi").mapInArrow(run, "node long, shingles array<long>"), "shingle-sets")
    each = sets.select("node", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # Only shingles of several texts travel on; the others come first in every order, so their number is their place.
    several = each.join(often, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("own"))
    sized = several.join(nodes.select("node", "size"), "node").join(roots, "node").withColumn("alone", F.col("size") - F.size("own"))
    # Exact bounds in whole numbers; the small term keeps rounding on the safe side.
    least = lambda part: F.ceil(part - 1e-9)
    probe = F.col("size") - least(similarity * F.col("size")) + 1
    index = F.col("size") - least(2 * similarity / (1 + similarity) * F.col("size")) + 1
    front = sized.select("node", "root", "size", "alone", "own", probe.alias("probe"), index.alias("index"))
    front = front.select("node", "root", "size", "alone", "index", F.expr("slice(own, 1, int(greatest(0, probe - alone)))").alias("own"))
    spread = front.select("node", "root", "size", "alone", "index", F.posexplode("own").alias("k", "x"))
    placed = stored(spread.select("node", "root", "size", "index", F.col("x.s").alias("s"), (F.col("k") + F.col("alone")).alias("place")), "rare-shingles")
    x = placed.select("s", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "place")])
    y = placed.where("place < index").select("s", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "size", "place")])
    # y is the shorter; what stands behind the shared shingle must be able to make up the overlap.
    enough = F.lit(similarity / (1 + similarity)) * (F.col("x_size") + F.col("y_size")) - 1e-9
    fits = (F.col("y_size") >= F.lit(similarity) * F.col("x_size") - 1e-9) & (F.least(F.col("x_size") - F.col("x_place"), F.col("y_size") - F.col("y_place")) >= enough)
    ordered = (F.col("y_size") < F.col("x_size")) | ((F.col("y_size") == F.col("x_size")) & (F.col("y_node") < F.col("x_node")))
    found = x.join(y, "s").where((F.col("x_root") != F.col("y_root")) & ordered & fits)
    return found.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def keepers(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``doc_id`` and ``tid`` of the row that stays of each group."""
    nodes = _nodes(_marked(docs, width))
    buckets = _buckets(nodes, radius)
    texts = _texts_of(buckets.select("node").distinct(), nodes, docs)
    first = stored(_similar(stored(_to_centre(buckets, nodes), "candidates"), texts, width, similarity), "similar")
    roots = components(first)
    named = buckets.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = named.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    rest = stored(named.join(open_, "bucket", "left_semi").select("node", "root").distinct(), "open-texts")
    more = _similar(stored(_rare_pairs(nodes, rest, texts, width, similarity), "candidates"), texts, width, similarity)
    roots = components(first.unionAll(more))
    own = nodes.select("node", "tid", "least").join(roots, "node", "left")
    grouped = own.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("least", "tid")).alias("k"))
    return grouped.select(F.col("k.least.doc_id").alias("doc_id"), F.col("k.tid").alias("tid"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that are copies or near copies of a row that stays."""
    stay = stored(keepers(docs, width, similarity), "keepers")
    # The row travels as one value, so that no name of it can meet one of these.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), digest().alias("tid"), F.xxhash64("*").alias("mark"))
    kept = own.join(stay.select(F.col("doc_id").alias("own_id"), F.col("tid").alias("own_tid")), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("tid") == F.col("own_tid")), "left_semi")
    return kept.groupBy("doc_id", "tid").agg(F.min_by("row", "mark").alias("row")).select("row.*")
