"""Operator 7: BPE encoding and decoding through a pair occurrence index.

All distinct words of an Arrow batch of the partition (a bounded number of rows) lie in one array of symbols. The index maps the rank of every mergeable pair to all
positions where the pair stands. Active ranks leave a heap in ascending order; a merge is made at all positions of its
pair at once, and only the lists of the pairs beside those positions change. Words never influence each other, and
``Merges`` checks that no merge makes a pair of lower rank than its own, so this gives the ids that merging word by
word gives.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded each; a null
id stays null; an empty table gives an empty one; further input columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from funnelwright.llm.common import give_back, texts

ENCODED = "doc_id long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class Merges:
    """Vocabulary and ranked merges of a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        self.wide = 1 << max(self.token).bit_length()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right, self.made = left, right, np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.wide + right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # The first rank at which a symbol is used must lie after every rank that makes it.
        first = np.full(self.wide, len(pairs), np.int64)
        np.minimum.at(first, left, np.arange(len(pairs)))
        np.minimum.at(first, right, np.arange(len(pairs)))
        self.simultaneous = bool((first[self.made] > np.arange(len(pairs))).all())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = a * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word's ids begin (one more entry than words)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        starts = np.concatenate(([0], ends[:-1]))
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Add to the index the pairs that begin at these positions."""
            ranks = self.rank(sym[at], sym[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            by = np.argsort(ranks, kind="stable")
            at, ranks = at[by], ranks[by]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, own in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, c = self.left[r], self.right[r], self.made[r]
            at = at[sym[at] == a]
            nxt = after[at]
            ok = (nxt >= 0) & (sym[nxt] == b)
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:
                # In a run of equal symbols every second position merges, from the left.
                chain = np.concatenate(([False], at[1:] == nxt[:-1]))
                head = np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
                even = (np.arange(len(at)) - head) % 2 == 0
                at, nxt = at[even], nxt[even]
            if not len(at):
                continue
            beyond = after[nxt]
            sym[at] = c
            sym[nxt] = -1
            after[at] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = at[inside]
            left = before[at]
            note(np.union1d(left[left >= 0], at[inside]))
        alive = sym >= 0
        return sym[alive], np.concatenate(([0], np.cumsum(np.add.reduceat(alive, starts))))


class WordEncoder:
    """Normalises and cuts texts as the file says, and encodes the distinct words of a batch together.

    Letters up to U+024F are normalised and cut here, everything else by the library's own normaliser and
    pre-tokenizer, because versions of Unicode disagree about what is a letter.
    """

    SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"

    def __init__(self, path: str):
        import re

        import regex
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        if not self.merges.simultaneous:
            raise ValueError("a merge of this file makes a pair of lower rank; merging at all positions at once would differ")
        # The pre-tokenizer's pattern, a fixed value of the file.
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{self.SPACE}\p{{L}}\p{{N}}]+")
        self.rare = re.compile("[^\x00-\u024f]")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.byte = {c: b for b, c in enumerate(byte_letters())}

    def words(self, text: str) -> list[str | bytes]:
        """The words of a text; those that the library cut are bytes, special tokens keep their own string."""
        if "<|" in text:
            return [w for s in self.marks.split(text) for w in ([s.encode()] if s in self.merges.special else self.words_between(s))]
        return self.words_between(text)

    def words_between(self, text: str) -> list[str | bytes]:
        if text.isascii():
            return self.cut.findall(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.rare.search(text):
                parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes([self.byte[c] for c in w]) for w, _ in parts]
        return self.cut.findall(unicodedata.normalize("NFC", text).lower())

    def encode(self, batch: list[str]) -> tuple[list, list, list[array]]:
        """Ids and shown tokens of each distinct word, and the numbers of each text's words.

        Texts are kept as numbers, 4 bytes a word, so a batch takes the room of its distinct words.
        """
        number = _Numbers()
        cut = [array("i", map(number.__getitem__, self.words(t))) for t in batch]
        special = {s.encode(): i for s, i in self.merges.special.items()}
        flat, at = self.merges.encode_words([w if isinstance(w, bytes) else w.encode() for w in number])
        tokens, data, at = self.merges.token, flat.astype("<i4").tobytes(), at.tolist()
        shown = [tokens[i] for i in flat.tolist()]
        ids = [data[4 * i : 4 * j] for i, j in zip(at, at[1:])]
        text = [" ".join(shown[i:j]) for i, j in zip(at, at[1:])]
        for s in special.keys() & number.keys():
            ids[number[s]], text[number[s]] = np.array([special[s]], "<i4").tobytes(), s.decode()
        return ids, text, cut


class _Numbers(dict):
    """Words numbered in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Ids of every text and the text they decode to. No shuffle: each scan task indexes the pairs of its own words."""

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            ids, shown, cut = enc.encode(batch.column(1).to_pylist())
            for lo in range(0, batch.num_rows, 128):
                own = [b"".join([ids[w] for w in c]) for c in cut[lo : lo + 128]]
                decoded = [" ".join([shown[w] for w in c]) for c in cut[lo : lo + 128]]
                at = np.cumsum([0, *(len(x) // 4 for x in own)])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 128), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
            del ids, shown, cut
            give_back()

    return texts(docs).mapInArrow(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    """Number of ids and SHA-256 of ids and decoded text."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
