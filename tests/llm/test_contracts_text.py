"""Operators 1, 4, 7 and 9 against brute force, on the smallest tables and on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from funnelwright.llm import bpe, decontaminate, graph, records, simhash

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (5, None), (1, ""), (1, "same text twice"), (1, "same text twice"), (None, "no id"), (7, "   \n\t "), (8, "é ́a \x1c! <|endoftext|> x<|startoftext|>"),
    (9, "aaaa AAAA " * 400), (10, "日本語 テスト ΑΣ İ  two  spaces "), (11, "x" * 5000), (12, "a b"), (13, "՘\U00010940 ½ it's They'LL"), (14, "Tab\there\nand \n there"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "x", 3.0) for d, t in ODD], "doc_id long, text string, shard string, fp double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("source", ["odd", "given"])
def test_records_round_trip(spark, odd, source):
    docs = odd if source == "odd" else documents(spark)
    tok = Tokenizer.from_file(BYTES)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.read_records(records.write_records(docs, BYTES, shards=5)).collect())
    at, want = 0, []
    for d, t in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_records_seek_and_checksums(spark, odd):
    manifest = records.write_records(odd, BYTES, shards=1)
    (row,) = manifest.collect()
    tok = Tokenizer.from_file(BYTES)
    ids = [records.record_at(row.path, k) for k in range(row.n_records)]
    assert [d for d, _ in ids] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d or 0))
    assert ids[0][1].tolist() == tok.encode("no id").ids + [0]
    frame = bytearray(records.frame(b"abc"))
    assert records.unframe(bytes(frame), 0) == (b"abc", len(frame))
    for k in (0, 13):
        bad = bytearray(frame)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(bad), 0)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert records.read_records(records.write_records(empty, BYTES)).count() == 0
    assert bpe.encode(empty, WORDS).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("source", ["odd", "given"])
def test_bpe_as_the_library(spark, odd, source):
    docs = odd if source == "odd" else documents(spark)
    tok = Tokenizer.from_file(WORDS)
    want = []
    for d, t in plain(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, (tuple(r) for r in bpe.digests(bpe.encode(docs, WORDS)).collect()))) == sorted(map(repr, want))


def test_bpe_merges_runs_and_lists():
    m = bpe.Merges(WORDS)
    tok = Tokenizer.from_file(WORDS)
    words = [b"a" * k for k in range(1, 40)] + [b"lalalala", b"zzzzz", b"thethethe"]
    flat, at = m.encode_words(words)
    assert [flat[i:j].tolist() for i, j in zip(at, at[1:])] == [tok.encode(w.decode()).ids for w in words]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))


def brute_contamination(docs, bench, n=10):
    wins = {}
    for i, t in bench:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes, out = sorted({len(w) for w in wins}), []
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                own = wins.get(tuple(w[k : k + s]))
                if own:
                    hit.update(range(k, k + s))
                    items |= own
        items = sorted(str(i) for i in items)
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("segment,blocks", [(2_000_000, 2_000_000), (3_000, 200)])
def test_decontamination(spark, segment, blocks, monkeypatch):
    build = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, vocabulary=None: build(docs, vocabulary, segment))
    docs = documents(spark).select("doc_id", "text").unionAll(spark.createDataFrame([(None, "one two three"), (1, None), (3, "x one two three one two THREE. y"), (3, "")], "doc_id long, text string"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").unionAll(spark.createDataFrame([(900, "one two three"), (901, None), (902, " .. "), (903, "One Two Three")], "item_id long, text string"))
    want = brute_contamination(plain(docs), [(r.item_id, r.text or "") for r in bench.collect()])
    got = [tuple(r) for r in decontaminate.digests(decontaminate.contaminated(docs, bench, block_words=blocks)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[-1] for r in want) > 3


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha q q q q q beta"), (3, "delta gamma beta alpha")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    hit = lambda slop: {r.doc_id for r in decontaminate.contaminated(docs, bench, slop=slop).collect() if r.matches}
    assert hit(0) == set() and hit(1) == {1} and hit(3) == {1} and hit(4) == {1, 3}
    with pytest.raises(ValueError):
        hit(40)


def brute_components(fps):
    """Smallest id reachable, by comparing all pairs of distinct fingerprints."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(distinct, np.uint64)
    for k, f in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(f)) <= 2):
            a, b = find(f), find(distinct[j])
            root[max(a, b)] = min(a, b)
    least = {}
    for d, f in fps:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in fps]


def brute_fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
    sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [64, 2])
def test_simhash(spark, odd, bucket):
    docs = documents(spark).select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    want = brute_components([(d, brute_fingerprint(t)) for d, t in plain(docs)])
    got = [tuple(r) for r in simhash.digests(simhash.near_duplicates(docs, bucket=bucket)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("bucket", [64, 3])
def test_links_in_dense_groups(spark, bucket):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for s in seeds for _ in range(120)}
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in graph.components(simhash.links(df, bucket=bucket)).collect()}
    want = {}
    for d, f, c in brute_components([(f, f) for f in fps]):
        want.setdefault(c, set()).add(simhash.signed(d))
    mine = {}
    for f in map(simhash.signed, fps):
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_allocation_is_least():
    cost = [[0, 5, 50, 90], [0, 100, 200, 300], [0, 4, 6, 60]]
    taus = simhash.allocate(cost, 2)
    assert sum(t + 1 for t in taus) == 3 and taus == [0, -1, 1]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1100)] + [(None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 1000 for k in range(1000, 1100))
