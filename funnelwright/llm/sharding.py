"""Operator 3: shards by balanced label propagation.

Documents are linked through keys: rows with the same key (here, the same text) are neighbours. They start in shards
of equal size dealt by a hash. In each round every key's most common shard is its target, and a document elsewhere
asks to move there. Quotas for each pair of shards are set from the counts of requests so that every shard gives
away exactly as many documents as it gets, with documents that have no neighbours moving against the stream; so the
counts stay at most one apart throughout (law ``rows``). Rounds end when no request is granted.

What travels is one small row per document; requests are ranked in pieces of bounded size (by key and, for large
groups, by document), whose quotas follow from running totals over piece counts. The driver sees counts per pair of
shards only. A group larger than a shard fills shards as far as the quotas go and is split.

Defined results: null texts have size 1 and link with each other and with empty ones; repeated rows and equal or null
ids are rows of their own; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from funnelwright.llm.common import stored
from funnelwright.session import cut_lineage

# Documents that one window ranks.
PIECE = 50_000
# A document without neighbours, one in its key's most common shard, one that asks to move.
FREE, AT_HOME, ASKS = 0, 1, 2


def _numbered(df: DataFrame, within: list[str], spread: Column, order: list[str], pieces: int, name: str, ahead: Column | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each group, by ``ahead`` and then in the order of pieces; no window holds
    more than a piece."""
    df = df.withColumn("_piece", F.struct((F.lit(0) if ahead is None else ahead).alias("ahead"), F.pmod(spread, F.lit(pieces)).alias("piece")))
    sizes = df.groupBy(*within, "_piece").agg(F.count("*").alias("_n"))
    # One row per piece and group: a running total over counts, not over documents.
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy(*within).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(W.partitionBy(*within, "_piece").orderBy(*order))
    return df.withColumn("_rank", rank).join(base, [*within, "_piece"]).withColumn(name, F.col("_base") + F.col("_rank") - 1).drop("_piece", "_rank", "_base")


def quotas(asked: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Granted moves and balancing moves per pair of shards: each shard gives as many as it gets.

    ``free`` documents can leave a shard at no loss. Requests into a shard that could not give enough away are cut
    back in proportion, which is repeated until every shard can balance.
    """
    k = len(free)
    grant = {p: n for p, n in asked.items() if n}
    while True:
        into = [sum(n for (a, b), n in grant.items() if b == s) for s in range(k)]
        out = [sum(n for (a, b), n in grant.items() if a == s) for s in range(k)]
        worst = max(range(k), key=lambda s: into[s] - out[s] - free[s])
        over = into[worst] - out[worst] - free[worst]
        if over <= 0:
            break
        own = sorted(p for p in grant if p[1] == worst)
        left, total = over, into[worst]
        for p in own:
            cut = min(grant[p], -(-grant[p] * over // total), left)
            grant[p] -= cut
            left -= cut
    surplus = [[s, into[s] - out[s]] for s in range(k) if into[s] > out[s]]
    lack = [[s, out[s] - into[s]] for s in range(k) if out[s] > into[s]]
    back: dict[tuple[int, int], int] = {}
    while surplus and lack:
        n = min(surplus[0][1], lack[0][1])
        back[surplus[0][0], lack[0][0]] = n
        surplus[0][1] -= n
        lack[0][1] -= n
        surplus, lack = [x for x in surplus if x[1]], [x for x in lack if x[1]]
    return grant, back


def propagate(nodes: DataFrame, shards: int, rounds: int = 12) -> DataFrame:
    """``nodes`` (``row``, ``key`` and what else they carry) with ``shard``; rows of one key are neighbours.

    ``row`` is a number that spreads the rows; equal numbers are allowed. ``rounds`` bounds the work on graphs that
    keep exchanging documents; a round that grants nothing ends it earlier.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    pieces = max(1, -(-total // PIECE))
    other = [c for c in nodes.columns if c not in ("row", "key")]
    state = _numbered(nodes, [], F.col("row"), ["row", "key", *other], pieces, "_at") if total else nodes.withColumn("_at", F.lit(0))
    state = cut_lineage(state.withColumn("shard", (F.col("_at") % shards).cast("int")).drop("_at"))
    for _ in range(rounds if total else 0):
        by_shard = state.groupBy("key", "shard").agg(F.count("*").alias("_n"))
        # The tie between shards falls by a hash of key and shard, so that targets spread.
        best = F.max(F.struct("_n", F.xxhash64("key", "shard").alias("h"), F.col("shard").alias("target")))
        keys = by_shard.groupBy("key").agg(F.sum("_n").alias("_size"), best.alias("_b")).select("key", "_size", F.col("_b.target").alias("_target"))
        kind = F.when(F.col("_size") == 1, FREE).when(F.col("_target") == F.col("shard"), AT_HOME).otherwise(ASKS)
        ask = cut_lineage(state.join(keys, "key").withColumn("_kind", kind))
        lane = F.when(F.col("_kind") == ASKS, F.col("_target")).otherwise(-1)
        counts = ask.where(F.col("_kind") != AT_HOME).groupBy("shard", "_kind", lane.alias("_lane")).agg(F.count("*").alias("_n"))
        free, asked = [0] * shards, {}
        for r in counts.collect():
            if r["_kind"] == ASKS:
                asked[r["shard"], r["_lane"]] = r["_n"]
            else:
                free[r["shard"]] = r["_n"]
        grant, back = quotas(asked, free)
        if not any(grant.values()):
            break
        limits = [(a, b, b, 0, n) for (a, b), n in grant.items() if n]
        first = [0] * shards
        for (a, b), n in sorted(back.items()):
            limits.append((a, -1, b, first[a], first[a] + n))
            first[a] += n
        quota = spark.createDataFrame(limits, "_qs int, _ql int, _to int, _lo long, _hi long")
        # Whole groups are ranked together unless they are large, so that a quota cuts few of them.
        spread = F.when(F.col("_size") <= PIECE // 10, F.xxhash64("key")).otherwise(F.xxhash64("key", "row"))
        # Small groups go first: a quota then cuts the groups that have to be split anyway.
        small_first = F.floor(F.log2(F.col("_size").cast("double"))).cast("int")
        ranked = _numbered(ask.where(F.col("_kind") != AT_HOME).withColumn("_lane", lane), ["shard", "_lane"], spread, ["key", "row", *other], pieces, "_place", small_first)
        granted = (F.col("shard") == F.col("_qs")) & (F.col("_lane") == F.col("_ql")) & (F.col("_place") >= F.col("_lo")) & (F.col("_place") < F.col("_hi"))
        moved = ranked.join(quota, granted, "left").select("row", "key", *other, F.coalesce("_to", "shard").alias("shard"))
        state = cut_lineage(moved.unionByName(ask.where(F.col("_kind") == AT_HOME).select("row", "key", *other, "shard")))
    return state


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every document; equal texts are neighbours."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # The key is a 64-bit hash of the text; two texts that share one would only be drawn to the same shard.
    nodes = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", text).alias("row"), F.xxhash64(text, F.length(text)).alias("key"),
    ), "shard-nodes")
    placed = propagate(nodes, shards)
    pieces = max(1, -(-nodes.count() // PIECE))
    spread = F.xxhash64("row", F.lit(1))
    return _numbered(placed, ["shard"], spread, ["key", "row", "doc_id"], pieces, "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def digests(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
