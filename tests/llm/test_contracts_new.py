"""Operators 11, 12 and 13 against brute force that follows the contract word by word."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from funnelwright.llm import alignment, periods, queries, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, words string, chunk int, runs string, groups int, n_words string"
CYCLE = " ".join(f"w{k % 5}" for k in range(40))
ODD = [
    (1, None), (2, ""), (3, "same words here"), (3, "same words here"), (None, "no id " * 30), (4, " \n\t "), (5, CYCLE), (6, f"x {CYCLE}\ty " * 3),
    (7, "a " * 23), (8, "a " * 24), (9, "b\x0bb\x0cb\r\n" * 12), (10, "é" + "\u00a0é" * 40), (11, "z " * 20_000), (12, " lead"), (13, "\nnew line"), (14, "tail \n"),
    (15, "two  spaces\n\nand lines\n here"), (16, "<|endoftext|> </s> <unk> <0x41>"), (17, "日本語 と 😀 👩\u200d👩 ǘ ꙮ"), (18, "piece ▁ mark"), (19, "nul \x00 x"),
    (20, "\U0001f600" * 50), (21, "word"), (22, "x" * 5_000), (23, "Ａ ﬁ ① half"), (24, "d\u0301 e\u0301"), (25, "\t"), (26, "end\n"),
]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "w", 7, "r", 9, "n") for d, t in rows], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs --------------------------------------------------------------------


def runs_by_hand(words, min_length=24, min_exponent=3):
    found = set()
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            smaller = any(all(words[t] == words[t + r] for t in range(i, j + q - r)) for r in range(1, q))
            if j + q - i >= max(min_length, min_exponent * q) and not smaller:
                found.add((i, j + q - i, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected_runs(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_hand(words)
    lost = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return doc_id, len(found), *best, milli, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in lost))


RUN_COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            w = [rng.randint(0, rng.choice([0, 1, 2, 30])) for _ in range(rng.randint(0, 50))]
            for _ in range(rng.randint(0, 3)):
                w += [rng.randint(0, 3) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
            texts.append(w)
        codes = np.array([x for t in texts for x in t], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for least in ((24, 3), (6, 2), (9, 4)):
            assert periods.runs_of(codes, offsets, *least) == [(k, *r) for k, t in enumerate(texts) for r in runs_by_hand(t, *least)]


def test_a_small_block_size_keeps_positions_in_order():
    own, seen = periods.Positions(50, wide=2), [50]
    for x in random.Random(1).sample([k for k in range(100) if k != 50], 80):
        below, above = max((y for y in seen if y < x), default=None), min((y for y in seen if y > x), default=None)
        assert own.add(x) == (below, above)
        seen.append(x)
    assert list(own) == sorted(seen)


def test_runs_of_odd_texts(spark):
    docs = frame(spark, ODD)
    got = periods.digests(periods.find(periods.with_repeats(docs))).select(RUN_COLUMNS).collect()
    # The long text of one word is one run; brute force would take too long.
    long_id = 11
    same([tuple(r) for r in got if r.doc_id != long_id], [expected_runs(d, t or "") for d, t in ODD if d != long_id])
    (r,) = [r for r in got if r.doc_id == long_id]
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 20_000, 1) and r.collapsed_sha256 == sha("z")


def test_runs_of_the_documents(spark):
    got = queries.op11(spark, SF).select(RUN_COLUMNS).collect()
    same(map(tuple, got), [expected_runs(d, t) for d, t in plain(documents(spark))])
    assert any(r.n_runs for r in got)


def test_repeats_make_long_runs(spark):
    ids = [k for k in range(3_000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rows = [(k, " ".join(f"v{j}" for j in range(150))) for k in ids]
    got = periods.digests(periods.find(periods.with_repeats(frame(spark, rows)))).select(RUN_COLUMNS).collect()
    same(map(tuple, got), [expected_runs(d, t) for d, t in rows])
    assert sum(r.n_runs for r in got) > 10


def test_runs_of_no_rows(spark):
    assert periods.digests(periods.find(periods.with_repeats(frame(spark, [])))).collect() == []


# --- alignment of tokenizers ----------------------------------------------------------


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = alignment.byte_alphabet()
    per, count = [], Counter()
    for doc_id, text in rows:
        want = (" " + text).encode()
        xs, ys = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        xb = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in xs]
        yb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ys]
        if not text or b"".join(xb) != want or b"".join(yb) != want:
            per.append((doc_id, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        links, i, j = [], 0, 0
        while i < len(xs) and j < len(ys):
            links.append((xs[i], ys[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            k, m = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append(",".join(map(str, xs[i:k])) + "|" + ",".join(map(str, ys[j:m])))
            i, j = k, m
        count.update(links)
        per.append((doc_id, xs, ys, groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [
        (d, len(xs), len(ys), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sha(";".join(groups)) if groups else "")
        for d, xs, ys, groups, links in per
    ]


ALIGNED_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("size", [50, alignment.CHUNK_BYTES])
def test_alignment_of_odd_texts(spark, size):
    got = alignment.digests(alignment.align(frame(spark, ODD), *PATHS, chunk_bytes=size)).select(ALIGNED_COLUMNS).collect()
    want = aligned_by_hand([(d, t or "") for d, t in ODD])
    same(map(tuple, got), want)
    assert sum(w[1] > 0 for w in want) > 15 and any(w[1] == 0 and w[0] == 18 for w in want)


def test_alignment_of_the_documents(spark):
    got = queries.op12(spark, SF).select(ALIGNED_COLUMNS).collect()
    same(map(tuple, got), aligned_by_hand(plain(documents(spark))))


def test_alignment_of_random_characters(spark):
    rng = random.Random(3)
    letters = "ab ,.'\n\tÄé漢字😀🇩🇪\u0301\u200b1290-<|>\u00a0İﬁ" + "  "
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))) for k in range(600)]
    got = alignment.digests(alignment.align(frame(spark, rows), *PATHS, chunk_bytes=2_000)).select(ALIGNED_COLUMNS).collect()
    same(map(tuple, got), aligned_by_hand(rows))


def test_alignment_of_no_rows(spark):
    assert alignment.digests(alignment.align(frame(spark, []), *PATHS)).collect() == []


def test_ends_inside_characters_are_refined():
    own = alignment.aligner(*PATHS)
    text = "é 😀漢 ꙮ"
    e, raw = own.a.encode(" " + text, add_special_tokens=False), (" " + text).encode()
    ends = own._ends_a([e], [" " + text], np.array(e.ids), np.array([len(e.ids)]))
    assert ends.tolist() == np.cumsum([len(own.a_bytes[i]) for i in e.ids]).tolist() and ends[-1] == len(raw)
    (p,) = own.b.encode([text], return_type="proto")
    ids = np.array([x.id for x in p.pieces])
    ends = own._ends_b(np.array([x.end for x in p.pieces]), ids, np.array([len(ids)]), np.array([0, len(raw)]))
    assert ends.tolist() == np.cumsum([len(own.b_bytes[i]) for i in ids]).tolist() and own.b.is_byte(int(ids[-1]))


# --- URL rules ------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, rule string, verdict int"
ODD_URLS = [
    None, "", "no scheme", "http://", "http:///en/1", "https://EXAMPLE.org/es/x", "https://example.org/es", "https://a.b.example.org/en/12?q", "https://notexample.org/en/1", "x://example.org/en/2#/en/1",
    "http://x.com/de/1", "http://X.COM/fr/", "http://com/de/", "http://com", "http://org", "http://org/", "http://a.b://c.com/de/", "http://example.org:80/es/", "http://u@example.org/es/", "http://.org/",
    "http://..com/de/", "http://org./", "line\nbreak://example.org/es/\n?x", "http://www.spam-farm.example.net/a", "http://spam-farm.example.org/a", "http://xspam-farm.example.net/", "http://é.com/de/é", "http://x.net/" + "a/" * 5_000,
    "http://" + "a." * 3_000 + "com/de/1",
]


def judged_by_hand(url, rules, listed):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)

    def best(own):
        fits = [(len(h + p), len(h), h + p, v == "block") for h, p, v in own if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits) if fits else None

    r = best(rules)
    return host, path, r[2] if r else None, "block" if (r[3] if r else best(listed)) else "allow"


def pages_of(spark, given):
    return spark.createDataFrame([(k, u, "<p>", "h", "p", "r", 1) for k, u in enumerate(given)], PAGES)


def built(spark, rules):
    return urls.build(spark.createDataFrame(rules, "host string, path string, verdict string"))


def test_rules_on_odd_urls(spark):
    given = ODD_URLS + ODD_URLS[:9]
    got = urls.judge(pages_of(spark, given), built(spark, queries.URL_RULES), built(spark, queries.URL_LISTED)).collect()
    assert {tuple(r) for r in got} == {(k, *judged_by_hand(u, queries.URL_RULES, queries.URL_LISTED)) for k, u in enumerate(given)} and len(got) == len(given)


def test_rules_on_the_pages(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"select {', '.join(cols)} from ({queries.OP13_SQL})").fetchall()
    same(map(tuple, queries.op13(spark, SF).select(cols).collect()), want)


def test_many_rules(spark):
    rng = random.Random(9)
    hosts = [".".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(3_000)]
    rules = {(rng.choice(hosts), "/" * rng.randint(0, 1) + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 6)))): rng.choice(["allow", "block"]) for _ in range(20_000)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    given = [f"http://{rng.choice(hosts)}/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 8))) for _ in range(2_000)]
    own = built(spark, rules)
    assert len(own.hosts.shards) > 1 and sum(s.n for s in own.rules.shards) == len(rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages_of(spark, given), own).collect()}
    by_host = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((h, p, v))
    for k, u in enumerate(given):
        host = u.split("/")[2]
        parts = host.split(".")
        near = [r for n in range(len(parts)) for r in by_host.get(".".join(parts[n:]), ())]
        assert got[k] == judged_by_hand(u, near, [])


def test_equal_digests_are_told_apart(spark, monkeypatch):
    import xxhash

    own = built(spark, [("aa", "/", "block"), ("bb", "/", "allow")])
    # Every string is made to have the digest of one that is held: none but that string may be a hit.
    held = xxhash.xxh64_intdigest(b"aa", 42)
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda raw, seed: held)
    assert urls.Reader(own.hosts).probe(["zz", "aa", "q"]) == {1: [1]}


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    odd = spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("X.com", None, "block"), ("X.com", "", "allow")], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in urls.judge(pages_of(spark, ["http://x.com/a"]), urls.build(none)).collect()] == [(None, "allow")]
    assert [(r.rule, r.verdict) for r in urls.judge(pages_of(spark, ["http://x.com/a"]), urls.build(odd)).collect()] == [("x.com", "block")]
    assert urls.judge(pages_of(spark, []), urls.build(odd)).collect() == []
