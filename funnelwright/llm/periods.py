"""Operator 11: maximal periodic runs of words by descending-LCP Kruskal.

All suffixes of a text that share their first L words form a class. Classes are united in the order of falling longest
common prefix (LCP) of neighbours in the suffix array, by union-find whose sets are ordered sets of positions. Two
positions i < j that become neighbours in a set when it is made at LCP L, at a distance d <= L, seed a run of period d:
words i to j + L repeat with period d and cannot go on to the right. The seed is the run itself where nothing
extends it to the left. Each run is found this way, since between its first word and the one a period later no other
member of their class can lie. A multiple of a run's period can seed the same stretch; the smallest period stays.

Only LCPs from ``least_lcp`` on can make a run that is long enough. So texts without two equal stretches of that many
words (64-bit rolling hashes, sorted once; a collision only adds work) are never indexed, and the others are indexed
by prefix doubling, many texts at a time.

Defined results: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; rows
are treated one by one, so repeated rows and ids give repeated results; a null id stays null; an empty table gives an
empty result; columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import texts

RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
SPACE = "[\\x20\\x09-\\x0D]+"
CHUNK_BYTES = 8 << 20  # text worked on at once; a longer text is worked on alone
INDEX_WORDS = 1 << 20  # words indexed at once; a longer text is indexed alone


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The smallest LCP a run of at least ``max(min_length, min_exponent * period)`` words can have."""
    return min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 2))


class Positions:
    """An ordered set of positions in blocks, so that an insertion moves few of them however large the set is."""

    def __init__(self, x: int, wide: int = 1024):
        self.blocks, self.tops, self.size, self.wide = [[x]], [x], 1, wide

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Insert ``x``; returns its neighbours below and above."""
        k = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        block = self.blocks[k]
        at = bisect_left(block, x)
        below = block[at - 1] if at else (self.blocks[k - 1][-1] if k else None)
        above = block[at] if at < len(block) else (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None)
        block.insert(at, x)
        self.size += 1
        if len(block) > 2 * self.wide:
            self.blocks[k : k + 1] = [block[: self.wide], block[self.wide :]]
            self.tops[k : k + 1] = [block[self.wide - 1], block[-1]]
        else:
            self.tops[k] = block[-1]
        return below, above


def suffix_neighbours(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours (i, j) of the suffix arrays of many texts and their LCPs.

    ``codes`` are the words of all texts in a row, equal only within a text; ``ends`` is the end of each word's text.
    """
    n, place = len(codes), np.arange(len(codes))
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while True:
        now = ranks[-1]
        after = place + width
        inside = after < ends
        key = now * (n + 1) + np.where(inside, now[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        nxt = np.empty(n, np.int64)
        nxt[order] = fresh
        if fresh[-1] == n - 1:
            break
        ranks.append(nxt)
        width *= 2
    i, j = order[:-1], order[1:]
    one = ends[i] == ends[j]
    i, j = i[one], j[one]
    lcp, stop = np.zeros(len(i), np.int64), ends[i]
    for level in range(len(ranks) - 1, -1, -1):
        a, b = i + lcp, j + lcp
        same = (np.maximum(a, b) < stop) & (ranks[level][np.minimum(a, n - 1)] == ranks[level][np.minimum(b, n - 1)])
        lcp += same.astype(np.int64) << level
    return i, j, lcp


def seeds(i: list[int], j: list[int], lcp: list[int]) -> list[tuple[int, int, int]]:
    """(first position, distance, LCP) of positions that become neighbours at a distance within their LCP.

    The pairs come by falling LCP. Sets are merged into the larger; a position's set is that of its root.
    """
    root: dict[int, int] = {}
    sets: dict[int, Positions] = {}
    out = []

    def find(x: int) -> int:
        if x not in root:
            root[x], sets[x] = x, Positions(x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, own in zip(i, j, lcp):
        a, b = find(a), find(b)
        if sets[a].size < sets[b].size:
            a, b = b, a
        large, small, last = sets[a], sets.pop(b), None
        root[b] = a
        for x in small:
            below, above = large.add(x)
            # Two of the smaller set have met before.
            if below is not None and below != last and x - below <= own:
                out.append((below, x - below, own))
            if above is not None and above - x <= own:
                out.append((x, above - x, own))
            last = x
    return out


def runs_of(codes: np.ndarray, offsets: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of every run, by text, start and period; text k is ``codes[offsets[k]:offsets[k + 1]]``."""
    least = least_lcp(min_length, min_exponent)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(codes)
    if n <= least:
        return []
    # Hashes of the next `least` words of each text, the text's number mixed in.
    with np.errstate(over="ignore"):
        mix = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
        h, width, step, todo, at = np.zeros(n, np.uint64), 1, np.uint64(0xD6E8FEB86659FD93), least, 0
        power = mix
        while todo:
            if todo & 1:
                h = h * step + np.concatenate([power[at:], np.zeros(min(at, n), np.uint64)])
                at += width
            power = power * step + np.concatenate([power[width:], np.zeros(min(width, n), np.uint64)])
            step, width, todo = step * step + np.uint64(2), width * 2, todo >> 1
        h = (h ^ (h >> np.uint64(31))) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)
    whole = np.flatnonzero(np.arange(n) + least <= offsets[1:][doc])
    order = np.sort(h[whole])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return []
    near = np.minimum(np.searchsorted(twice, h[whole]), len(twice) - 1)
    hit = np.unique(doc[whole[twice[near] == h[whole]]])
    out, lo = [], 0
    while lo < len(hit):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[hit[lo:]]), INDEX_WORDS, "right")))
        out += _indexed(codes, offsets, hit[lo:hi], least, min_length, min_exponent)
        lo = hi
    return out


def _indexed(codes, offsets, own, least, min_length, min_exponent) -> list[tuple[int, int, int, int]]:
    sizes = (offsets[1:] - offsets[:-1])[own]
    base = np.concatenate([[0], np.cumsum(sizes)])
    number = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(base[-1]) - base[number] + offsets[own][number]
    local = number * (int(codes.max()) + 1) + codes[place]
    i, j, lcp = suffix_neighbours(local, base[1:][number])
    keep = np.flatnonzero(lcp >= least)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    best: dict[tuple[int, int], int] = {}
    for s, d, length in seeds(i[keep].tolist(), j[keep].tolist(), lcp[keep].tolist()):
        k = int(number[s])
        left = s > base[k] and local[s - 1] == local[s + d - 1]
        if not left and length + d >= max(min_length, min_exponent * d):
            best[s, length + d] = min(d, best.get((s, length + d), d))
    found = [(int(own[number[s]]), int(s - base[number[s]]), length, d) for (s, length), d in best.items()]
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def _chunk(ids: pa.Array, text: pa.Array, min_length: int, min_exponent: int) -> pa.RecordBatch:
    lists = pc.ascii_split_whitespace(text)
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(full)])
    offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64)
    words = words.filter(pa.array(full))
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    found = runs_of(codes, offsets, min_length, min_exponent)
    # Words after the first period of a run are dropped: a count of the runs they lie in.
    inside = np.zeros(len(codes) + 1, np.int64)
    for k, start, length, period in found:
        inside[offsets[k] + start + period] += 1
        inside[offsets[k] + start + length] -= 1
    kept = np.cumsum(inside[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.filter(pa.array(kept))), " ")
    of = np.searchsorted(np.array([r[0] for r in found], np.int64), np.arange(len(ids) + 1)).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(of), runs), collapsed], ["doc_id", "n_words", "runs", "collapsed"]
    )


def find(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """Per row of ``docs``: number of words, every run of at least ``max(min_length, min_exponent * period)`` words by
    start and period, and the text without the words that lie in a run after its first period."""

    def work(batches):
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield _chunk(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).cast(pa.string()), min_length, min_exponent)

    return texts(docs).mapInArrow(work, RUNS)


def with_repeats(docs: DataFrame) -> DataFrame:
    """The query's texts: of the ids whose crc32 is divisible by ten, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(ws, lambda w, i: F.when(i >= a, F.get(ws, (a + (i - a) % p).cast("int"))).otherwise(w))

    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    # The words are bound once as a lambda variable; a plain column would be cut again for each word.
    changed = F.get(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, F.concat_ws(" ", repeated(ws))).otherwise(F.lit(""))), 0)
    return texts(docs).select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exact exponent and the digests of runs and collapsed text."""
    # Runs come by start and period, so the first of equal exponents stays.
    top = F.aggregate("runs", F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return own.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
