"""Operators 2, 3, 5, 6, 8, 10 and the pipeline against brute force, planted cases and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from funnelwright.llm import chat, decontaminate, fuzzy, near_copies, pii, quality, sharding, toxicity

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, _piece int, upper string"
CARD, OTHER = "4532015112830366", "4532015112830367"
ODD = [
    (1, None), (2, ""), (3, "same words here"), (3, "same words here"), (None, "no id at all"), (4, " \n\t "),
    (5, f"Call +1 (602) 555-1234 or +49 30 1234567 890, card {CARD}, bad {OTHER}, ip 10.0.0.255 and 300.1.1.1, mail a.b+c@x-y.example.com."),
    (6, f"+1 (602) 555-1234 {CARD} joined"), (7, "a@b.c_d@e.f g@h 1.2.3.4.5.6.7.8 é@é.é +12345 x 12 34-56 789012345678 90"), (8, "9" * 3000 + " " + "a" * 3000 + "@" + "1." * 2000),
    (9, "word " * 3000), (10, "4111-1111-1111-1111 and 4111 1111 1111 1111;\U0001f600 \U0001f600 4111111111111111"), (11, "bob [at] mail [dot] example.com"), (12, "007.008.0000255.1 256.1.1.1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, "en", "s", 0, 9, "x", 1, "y") for d, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark, sf=SF):
    return spark.read.parquet(f"{sf}/labels.parquet")


def plain(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# --- personal data ------------------------------------------------------------------

# The base patterns as the contract states them.
PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn_ok(digits):
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn_ok(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("source", ["odd", "given"])
def test_base_spans(spark, odd, source):
    docs = odd if source == "odd" else documents(spark, LARGER)
    got = {}
    for r in pii.digests(pii.spans_of(docs)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r))
    seen = 0
    for d, t in plain(docs):
        spans = base_spans(t)
        seen += len(spans)
        n = Counter(k for _, k, _ in spans)
        shown = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans)
        want = (d, *(n[k] for k in range(4)), hashlib.sha256(shown.encode()).hexdigest())
        own = [g for g in got[d] if g[:6] == want]
        assert own, (d, want, got[d])
        assert set(filter(None, shown.split(","))) <= set(own[0][6].split(","))
    assert seen > 10


def test_phones_with_runs_of_separators(spark):
    """Base phones with runs of separators; in the second to fourth no three digits stand within single ones."""
    rows = list(enumerate(["call +33 6 12 34 56 78 now", "+49 - 30 - 12 - 34 - 56", "at +33 (0)1--23--45--67--89.", "+1 (60) (25) (55) (12) (34)", "+1 2", "+ 1 22 33"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(docs).collect()}
    assert got == {d: base_spans(t) for d, t in rows} and sum(map(len, got.values())) == 4
    shown = {r.doc_id: r.n_phone for r in pii.digests(pii.spans_of(docs)).collect()}
    assert [shown[d] for d in range(6)] == [1, 1, 1, 1, 0, 0]
    out = {r.doc_id: r.text for r in pii.redacted(docs, pii.Boosted()).collect()}
    assert out[0] == "call [PHONE] now" and out[3] == "[PHONE])"


def test_joined_spans_are_added(spark):
    """A phone and a card number side by side fail each other's base check; the model, having seen their forms, adds both."""
    rows = [(k, f"word +1 (60{k % 10}) 555-{1000 + k} word") for k in range(200)] + [(1000 + k, f"word {CARD} word") for k in range(50)] + [(500, f"word +1 (602) 555-1234 {CARD} word")]
    got = {r.doc_id: r for r in pii.digests(pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[500].n_phone == 0 and "phone:5:22" in got[500].spans and "card:23:39" in got[500].spans


def test_redaction_and_empty(spark, odd, empty):
    docs = odd.where("doc_id in (5, 10)")
    out = {r.doc_id: r.text for r in pii.redacted(docs, pii.Boosted()).collect()}
    assert "[EMAIL]" in out[5] and "[CARD]" in out[5] and "[IP]" in out[5] and "602" not in out[5] and OTHER in out[5]
    assert out[10] == "[CARD] and [CARD];\U0001f600 \U0001f600 [CARD]"
    assert pii.redacted(odd, pii.Boosted()).columns == odd.columns
    assert pii.spans_of(empty).count() == 0


def test_boosted_trees_learn_and_compile(spark):
    base = dict.fromkeys(pii.FEATURES, 0)
    counts = [({**base, "digits": d, "cue": c}, 100, 95 if d > 3 and c else 2) for d in range(8) for c in (0, 1)]
    model = pii.boost(counts)
    assert model.margin({**base, "digits": 5, "cue": 1}) > 1 > -1 > model.margin({**base, "digits": 2, "cue": 1})
    df = spark.createDataFrame([(tuple(x.values()),) for x, _, _ in counts], "x struct<" + ", ".join(f"{f}: int" for f in pii.FEATURES) + ">")
    got = [r[0] for r in df.select(model.column(F.col("x"))).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-model.margin(x))) for x, _, _ in counts])


# --- shards ---------------------------------------------------------------------------


@pytest.mark.parametrize("source", ["odd", "given", "hot"])
def test_shards(spark, odd, source, monkeypatch):
    docs = {"odd": lambda: odd, "given": lambda: documents(spark, LARGER), "hot": lambda: spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("pair"), F.floor(F.col("id") / 6).cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))}[source]()
    monkeypatch.setattr(sharding, "PIECE", 100)
    got = sharding.digests(sharding.assign(docs)).collect()
    want = Counter((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in plain(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    if source != "odd":
        places = {}
        for r in got:
            places.setdefault((r.size, r.text_crc32), []).append(r.shard)
        small = [p for p in places.values() if 1 < len(p) < len(got) / 32]
        assert sum(len(set(p)) > 1 for p in small) <= 0.02 * len(small) + 1


def test_quotas_balance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        k = int(rng.integers(2, 7))
        asked = {(a, b): int(rng.integers(0, 30)) for a in range(k) for b in range(k) if a != b}
        free = [int(x) for x in rng.integers(0, 12, k)]
        grant, back = sharding.quotas(asked, free)
        for s in range(k):
            moves = [*grant.items(), *back.items()]
            assert sum(n for (a, _), n in moves if a == s) == sum(n for (_, b), n in moves if b == s)
            assert sum(n for (a, _), n in back.items() if a == s) <= free[s]
        assert all(0 <= grant[p] <= asked[p] for p in grant)


# --- role repair -----------------------------------------------------------------------


def brute_cost(roles):
    """Least cost over all options of every turn, by trying them all."""
    best = {chat.START: 0}
    for role in roles:
        nxt = {}
        own = chat.ROLES.index(role) + 1 if role in chat.ROLES else None
        for s, c in best.items():
            for n in range(3):
                for inserted in itertools.product((1, 2, 3), repeat=n):
                    at, legal = s, True
                    for x in inserted:
                        legal, at = legal and x in chat.NEXT[at], x
                    if not legal:
                        continue
                    for to in chat.NEXT[at]:
                        cost = c + 2 * n + (0 if to == own else 3)
                        nxt[to] = min(nxt.get(to, 99), cost)
            if s != chat.START:
                cost = c + (1 if own == s else 4)
                nxt[s] = min(nxt.get(s, 99), cost)
        best = nxt
    return min(c + chat.CLOSING[s][0] for s, c in best.items())


def test_role_repair_costs():
    for roles in itertools.chain.from_iterable(itertools.product(("user", "assistant", "system", None, "tool"), repeat=n) for n in (1, 2, 3, 4)):
        rows = chat.repair([(k, r, "t") for k, r in enumerate(roles)], chat.START, None, True)
        assert sum(r[5] for r in rows) == brute_cost(roles), roles


def check_rendered(rendered):
    parts = re.findall(r"<\|(user|assistant|system)\|>\n(.*?)<\|end\|>\n", rendered, re.S)
    assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in parts) == rendered
    body = [r for r, _ in parts if r != "system"]
    assert all(r == ("user", "assistant")[k % 2] for k, r in enumerate(body)) and len(body) % 2 == 0
    assert [r for r, _ in parts].count("system") <= 1 and (parts[0][0] == "system" or all(r != "system" for r, _ in parts))
    return parts


@pytest.mark.parametrize("case", ["given", "hot"])
def test_conversations(spark, case):
    if case == "given":
        conv = spark.read.parquet(f"{SF}/conversations.parquet").unionByName(spark.createDataFrame([(None, 1, "user", "x"), (None, None, None, None), (7000, 5, "Tool", "<|user|> y"), (7000, 5, "Tool", "<|user|> y")], "conv_id long, turn long, role string, text string"))
    else:
        # One conversation of 3,000 turns over all partitions, with repeated turn numbers, among short ones.
        conv = spark.range(3300).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("conv_id"), (F.col("id") % 700).alias("turn"), F.element_at(F.array(*[F.lit(r) for r in ("user", "user", "assistant", "system", "tool")]), (F.pmod(F.xxhash64("id"), F.lit(5)) + 1).cast("int")).alias("role"), F.col("id").cast("string").alias("text"))
    rows = chat.repaired(conv).orderBy(F.col("conv_id").asc_nulls_first(), "part", "step").collect()
    assert len(rows) == conv.count()
    of = {}
    for r in rows:
        of.setdefault(r.conv_id, []).append(r)
    for c, own in of.items():
        parts = check_rendered("".join(r.rendered for r in own))
        turns = [(r.turn, r.role_before) for r in own]
        if case == "given":
            assert sum(r.cost for r in own) == brute_cost([x for _, x in turns])
        assert [t for t, _ in turns] == sorted((t for t, _ in turns), key=lambda t: (t is not None, t or 0))
        assert parts
    if case == "hot":
        whole = chat.repair([(r.turn, r.role_before, "") for r in of[5]], chat.START, None, True)
        assert sum(r.cost for r in of[5]) == sum(r[5] for r in whole) and len({r.part for r in of[5]}) > 1


def test_no_conversations(spark):
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- piecewise hashes --------------------------------------------------------------------


@pytest.mark.parametrize("source", ["odd", "given", "one"])
def test_piecewise(spark, odd, source):
    docs = {"odd": odd, "given": documents(spark), "one": odd.where("doc_id = 5")}[source]
    own = sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for k, (d, t) in enumerate(own):
        n, following = len(t), own[k - 1][1]
        e = t[: n - n // 3] + following[: n // 3]
        want.append((d, n, hashlib.sha256(e.encode()).hexdigest(), fuzzy.fingerprint(t), fuzzy.fingerprint(e)))
    got = fuzzy.digests(fuzzy.with_next(docs)).collect()
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if source == "given":
        assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
        assert np.median([r.near_edited for r in got]) > 0.5


def test_likeness(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(500)]
    long = " ".join(rng.choice(words, 2000))
    other = " ".join(rng.choice(words, 2000))
    near = long[:4000] + "INSERTED" + long[4000:]
    rows = [(fuzzy.fingerprint(a), fuzzy.fingerprint(b)) for a, b in ((long, long), (long, near), (long, other), ("", ""), ("", long), (long, long + other))]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(fuzzy.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] == got[3] == 1 and got[1] > 0.9 and got[2] < 0.3 and got[4] == 0 and got[5] > 0.3


# --- classifiers --------------------------------------------------------------------------


def accuracy(rows, marks, name):
    truth = {r.doc_id: getattr(r, name) for r in marks}
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(own) > 50
    return np.mean([a == b for a, b in own])


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 3 == 1


def test_quality(spark):
    docs, marks = documents(spark, LARGER), labels(spark, LARGER)
    rows = quality.digests(quality.scored(docs, marks)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    assert accuracy(rows, marks.collect(), "quality") > 0.95


def test_quality_ignores_held_out_labels(spark):
    docs, marks = documents(spark), labels(spark)
    spoilt = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    stats = quality.statistics(docs)
    assert quality.fit(stats, marks) == quality.fit(stats, spoilt)


def test_quality_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scored(odd, none).collect()} == {0.5}
    assert quality.scored(empty, none).count() == 0
    model = quality.Rules(0.0, [(1.0, (("upper", True, 0.5), ("log_words", False, 2.0)))])
    got = quality.with_statistics(odd).select(model.score("_stats.").alias("s")).collect()
    assert len(got) == len(ODD)
    assert quality.statistics_of("") == quality.statistics_of("")[:20] and all(np.isfinite(quality.statistics_of("")))


def test_toxicity(spark, odd, empty):
    docs, marks = documents(spark, LARGER), labels(spark, LARGER)
    model = toxicity.fit(docs, marks)
    rows = toxicity.digests(toxicity.scored(docs, model)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    assert accuracy(rows, marks.collect(), "toxic") > 0.9  # 260 labels to learn from
    assert toxicity.scored(odd, model).count() == len(ODD) and toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(odd, marks.limit(0)) == toxicity.Model(-6.0, {})


def test_offending_sentences_are_found(spark):
    rng = np.random.default_rng(5)
    words = ["w" + "".join(rng.choice(list("abcdefgh"), 4)) for _ in range(200)]
    rows = []
    for d in range(600):
        sentences = [" ".join(rng.choice(words, 6)) for _ in range(8)]
        if d % 4 == 0:
            sentences[int(rng.integers(8))] += " vileword"
        rows.append((d, ". ".join(sentences) + ".", int(d % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scored(df, toxicity.fit(df, df.select("doc_id", "toxic"))).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        found = [text[r.doc_id][s["first"] : s["after"]] for s in r.sentences]
        assert [("vileword" in f) for f in found] == [True] * (r.doc_id % 4 == 0)


# --- pipeline -------------------------------------------------------------------------------


def shingles(t, n=5):
    w = t.lower().split()
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_near_copies(spark):
    docs = documents(spark, LARGER)
    own = dict(plain(docs))
    kept = {r.doc_id for r in near_copies.one_of_each(docs).collect()}
    sets = {d: shingles(t) for d, t in own.items()}
    root = {d: d for d in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(own), 2):
        x, y = sets[a], sets[b]
        if 0.8 * len(x) <= len(y) <= 1.25 * len(x) + 1 and similar(x, y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert kept == {find(d) for d in own} and len(kept) < len(own)


def brute_groups(texts):
    """Sizes of what hangs together, by all pairs: shared shingles counted with a matrix."""
    sets = [shingles(t) for t in texts]
    ids = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(ids)), np.float32)
    for k, x in enumerate(sets):
        m[k, [ids[y] for y in x]] = 1
    both, n = m @ m.T, m.sum(1)
    near = both >= 0.8 * (n[:, None] + n - both) - 1e-3
    left, out = np.ones(len(sets), bool), []
    while left.any():
        own = np.zeros(len(sets), bool)
        own[np.flatnonzero(left)[0]] = True
        while True:
            grown = own | near[own].any(0)
            if (grown == own).all():
                break
            own = grown
        left &= ~own
        out.append(np.flatnonzero(own).tolist())
    return out


def test_near_copies_of_one_original(spark):
    """Variants near one original but not near each other hang together by it alone."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in rng.permutation(200)]
    texts = [" ".join(words)]
    for k in range(2000):
        own = list(words)
        for at in rng.choice(200, 4, replace=False):
            own[at] = f"v{k}x{at}"
        texts.append(" ".join(own))
    ids = rng.permutation(len(texts)).tolist()
    groups = brute_groups(texts)
    assert len(groups) == 1
    kept = near_copies.one_of_each(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in kept} == {min(ids[k] for k in g) for g in groups}


def test_near_copies_in_a_shared_frame(spark):
    """Groups that share most of their words but are not similar to each other lie in the same buckets and stay apart."""
    rng = np.random.default_rng(9)
    frame, texts = [f"f{k}" for k in range(170)], []
    for g in range(30):
        original = frame + [f"g{g}x{k}" for k in range(30)]
        for k in range(10):
            own = list(original)
            for at in rng.choice(200, 3, replace=False) if k else ():
                own[at] = f"v{g}x{k}x{at}"
            texts.append(" ".join(own))
    groups = brute_groups(texts)
    assert len(groups) < len(texts) / 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in near_copies.keepers(docs).collect()}
    assert kept == {min(g) for g in groups}


def test_near_copies_of_uneven_edits(spark):
    """Variants from hardly to heavily edited: most pairs lie around the threshold, and no centre is near to all."""
    rng = np.random.default_rng(10)
    words, texts = [f"w{k}" for k in range(150)], []
    for k in range(600):
        own = list(words[: 150 - int(rng.integers(0, 25))])
        for at in rng.choice(len(own), int(rng.integers(0, 14)), replace=False):
            own[at] = f"v{rng.integers(0, 40)}" if k % 2 else f"u{k}x{at}"
        texts.append(" ".join(own))
    texts += ["", " \n", "one two", "one two", "One two", "one two three four five six"]
    groups = brute_groups(texts)
    assert 10 < len(groups) < len(texts) - 100
    docs = spark.createDataFrame([(k, t or None) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keepers(docs).collect()} == {min(g) for g in groups}


def test_stages_on_odd_rows(spark, odd, empty):
    names = odd.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, empty, SF).count() == 0
        if name != "tokens":
            assert out.columns == names
        left = sorted((r.doc_id for r in out.collect()), key=str)
        if name == "near_duplicates":
            assert left == sorted([1, None, 3, 5, 6, 7, 8, 9, 10, 11, 12], key=str)
        elif name in ("decontamination", "personal_data", "tokens"):
            assert left == sorted((d for d, _ in ODD), key=str)


CLASHING = ("base", "spans", "candidates", "_digest", "_own", "_stats", "_id", "_hash", "bands", "low", "root", "row", "tid", "node", "own_id", "hit_id", "own_hash", "mark", "bucket")


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as a stage's own come back with the caller's values."""
    good = {r.doc_id for r in labels(spark).where("quality = 1").collect()}
    rows = [(d, t) for d, t in plain(documents(spark)) if d in good][:12] + [(10**9, f"Write to bob.smith@mail.example.com about the {k} words of this letter") for k in range(1)]
    docs = spark.createDataFrame([(d, t, *[f"{c}-{d}" for c in CLASHING]) for d, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got or name == "quality"
        for r in got:
            assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASHING), name
            assert name == "personal_data" or r.text == dict(rows)[r.doc_id]


def test_pipeline(spark):
    docs, out = documents(spark), corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < out.count() < docs.count()
    kept = {r.doc_id for r in out.collect()}
    bad = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect() if r.matches}
    assert not kept & bad
