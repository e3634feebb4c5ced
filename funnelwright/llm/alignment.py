"""Operator 12: alignment of two tokenizers by their spans.

The byte-level tokenizer (tokenizers library, A) and the piece tokenizer (sentencepiece, B) read the same bytes: a space
and the text. Each library's own spans, character offsets of A and the spans of B's proto (the installed library has
``proto`` in place of ``immutable_proto``, with byte positions), give coarse ends. An end is kept where the span is as
long as the token's decoded bytes; ends inside multibyte characters and byte-fallback runs are refined by decoded bytes
from the last kept end on. Offsets where tokens of both end cut the tokens into groups; between two neighbouring ends
of either lies exactly one linked pair.

Both tokenizers always cut before a single space between visible characters (A's pre-tokenizer does; no piece of B has
a space after another character, which is checked when the model is read). So the distinct spaced words of a chunk of
documents are encoded and aligned once, many in one call; a text with other spacing, or with a character that is
not printable, is one word as a whole. A text whose bytes one of the tokenizers does not keep has no tokens.

Plan: (1) one task per input split cuts documents into chunks of ``CHUNK_BYTES`` (a longer text is one chunk) and stores
per chunk its words' groups, its distinct linked pairs with counts, and per document the numbers of its words. (2) Pair
counts are summed over all chunks, the highest of each B id found. (3) Each chunk gets the counts of its own pairs and
sums them per document. Rows shuffled per pair are at most the number of chunks, whatever the pair.

Defined results: null and empty texts and those whose bytes differ have zeros and empty groups; rows are treated one by
one, so repeated rows and ids give repeated results (and count as often in the pair counts); a null id stays null; an
empty table gives an empty result; columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from funnelwright.llm.common import give_back, stored, texts

CHUNK_BYTES = 4 << 20
AT_ONCE = 256  # words encoded as one text
PIECE_BYTES = 128 << 10  # bytes encoded in one call: what both libraries return takes about a hundred times as much
CHUNKS = "chunk long, doc_id long, is_doc boolean, words array<int>, pairs array<long>, pair_n array<long>, links array<int>, flags binary, link_n array<int>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
NEW_A, NEW_B, LAST = 1, 2, 4  # a link's flags: first of its A token, first of its B token, last of its group


def byte_alphabet() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 itself, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers of a worker and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet, vocab = byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.tables = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum(n) - n, n) for t, n in ((self.a_bytes, self.a_len), (self.b_bytes, self.b_len))]
        # A piece with a space after another character could span two words: then every text is one word.
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)

    def plain(self, text: str) -> bool:
        """Whether the text's words, cut at single spaces, can be encoded apart."""
        return (
            self.cuts and text[0] not in " \n" and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text
            and "▁" not in text and text.replace("\n", "").isprintable()
        )

    def align(self, words: list[str], whole: list[str] = ()) -> dict:
        """Linked pairs of each word of ``words``, given without the space before it, and of each text of ``whole``.

        Words are encoded many at a time; where a joined text does not keep its bytes or a word's end, its words are
        encoded alone. ``bad`` ones keep their bytes in neither way and have no links. ``n`` counts the links of each.
        """
        every, out = [*words, *whole], []
        todo = [list(range(lo, min(lo + AT_ONCE, len(words)))) for lo in range(0, len(words), AT_ONCE)]
        alone = [[k] for k in chain(range(len(words), len(every)), *self._aligned(todo, every, out))]
        bad = {k for (k,) in self._aligned(alone, every, out)}
        at, pairs, flags = (np.concatenate([np.zeros(0, t), *[o[c] for o in out]]) for c, t in enumerate((np.int64, np.int64, np.uint8)))
        order = np.argsort(at, kind="stable")
        return {"pairs": pairs[order], "flags": flags[order], "n": np.bincount(at, minlength=len(every)), "bad": bad}

    def _kept(self, ids: np.ndarray, sizes: np.ndarray, raw: list[bytes], which: int) -> np.ndarray:
        """Whether the decoded bytes of each text's ids are its bytes."""
        table, start, size = self.tables[which]
        n = size[ids]
        per_text = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])])
        good = per_text == np.array([len(r) for r in raw])
        own = np.repeat(good, sizes)
        ids, n = ids[own], n[own]
        joined = table[np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        wanted = np.frombuffer(b"".join([r for r, g in zip(raw, good) if g]), np.uint8)
        if not np.array_equal(joined, wanted):
            bounds = np.cumsum(per_text[good])
            good[np.flatnonzero(good)[np.unique(np.searchsorted(bounds, np.flatnonzero(joined != wanted), "right"))]] = False
        return good

    def _aligned(self, sets, words, out) -> list[list[int]]:
        """Align the words of each set as one text, adding (words, pairs, flags) of links to ``out``; returns the sets
        whose bytes or word ends are not kept."""
        left, some, size = [], [], 0
        for s in sets:
            some.append(s)
            size += sum(len(words[k]) for k in s)
            if size >= PIECE_BYTES:
                left += self._piece(some, words, out)
                some, size = [], 0
        return left + (self._piece(some, words, out) if some else [])

    def _piece(self, sets, words, out) -> list[list[int]]:
        joined = [" ".join([words[k] for k in s]) for s in sets]
        raw = [(" " + t).encode() for t in joined]
        ea = self.a.encode_batch([" " + t for t in joined], add_special_tokens=False)
        eb = self.b.encode(joined, return_type="proto", num_threads=1)
        spans = [[(p.id, p.end) for p in e.pieces] for e in eb]
        size_a, size_b = np.array([len(e) for e in ea]), np.array([len(e) for e in spans])
        ids_a = np.fromiter(chain.from_iterable(e.ids for e in ea), np.int64, size_a.sum())
        both = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * size_b.sum())
        ids_b, span_ends = both[::2], both[1::2]
        good = self._kept(ids_a, size_a, raw, 0) & self._kept(ids_b, size_b, raw, 1)
        if not good.all():
            rest = [s for s, g in zip(sets, good) if g]
            return [s for s, g in zip(sets, good) if not g] + (self._piece(rest, words, out) if rest else [])
        base = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ends_a = self._ends_a(ea, [" " + t for t in joined], ids_a, size_a)
        ends_b = self._ends_b(span_ends, ids_b, size_b, base)
        number = np.array([w for s in sets for w in s], np.int64)
        word_ends = np.cumsum([1 + len(words[w].encode()) for w in number])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        inside = np.isin(word_ends, shared, assume_unique=True)
        if not inside.all():
            # A tokenizer went over a word's end: the words of that set are encoded alone.
            lost = set(np.searchsorted(base[1:], word_ends[~inside]).tolist())
            rest = [s for k, s in enumerate(sets) if k not in lost]
            return [s for k, s in enumerate(sets) if k in lost] + (self._piece(rest, words, out) if rest else [])
        # Between two neighbouring ends of either lies one pair.
        cuts = np.union1d(ends_a, ends_b)
        a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        flags = NEW_A * (np.diff(a, prepend=-1) > 0) + NEW_B * (np.diff(b, prepend=-1) > 0) + LAST * np.isin(cuts, shared, assume_unique=True)
        out.append((number[np.searchsorted(word_ends, cuts)], ids_a[a] << 32 | ids_b[b], flags.astype(np.uint8)))
        return []

    def _ends_a(self, encodings, joined: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends of A's tokens over all texts in a row, from its character offsets."""
        points = np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32)
        byte_of = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        first = np.cumsum([0, *[len(t) for t in joined]])[:-1]
        chars = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in encodings)), np.int64, 2 * len(ids))[1::2]
        return self._refined(byte_of[chars + np.repeat(first, sizes)], self.a_len[ids])

    def _ends_b(self, span_ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Byte ends of B's tokens; its spans count from the text's first byte, after the space that the model adds."""
        return self._refined(span_ends + 1 + np.repeat(base[:-1], sizes), self.b_len[ids])

    @staticmethod
    def _refined(coarse: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Coarse ends where a span has the token's number of bytes; else decoded bytes counted on from the last such end."""
        clean = np.diff(coarse, prepend=0) == size
        last = np.maximum.accumulate(np.where(clean, np.arange(len(coarse)), -1))
        done = np.cumsum(size)
        return np.where(last >= 0, coarse[last] + done - done[last], done)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, kept from task to task."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _chunk(own: Aligner, chunk: int, ids: pa.Array, text: list[str]) -> pa.RecordBatch:
    """One row for the chunk and one for each document."""
    plain = np.array([t != "" and own.plain(t) for t in text], bool)
    lists = pc.split_pattern(pa.array([t if p else "" for t, p in zip(text, plain)], pa.string()), " ")
    sizes = np.where(plain, pc.list_value_length(lists).to_numpy(), 0)
    flat = lists.flatten().filter(pa.array(np.repeat(plain, pc.list_value_length(lists).to_numpy())))
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    cut = np.concatenate([[0], np.cumsum(sizes)])
    of = [codes[lo:hi] for lo, hi in zip(cut, cut[1:])]
    whole: dict[str, int] = {}

    def as_one(k: int) -> None:
        of[k] = np.array([len(words) + whole.setdefault(text[k], len(whole))], np.int32)

    for k in np.flatnonzero(~plain):
        if text[k]:
            as_one(int(k))
    found = own.align(words, list(whole))
    # A plain text with a word that is not kept goes through whole before it is given up.
    lost, known = np.zeros(len(words), bool), len(whole)
    lost[[k for k in found["bad"] if k < len(words)]] = True
    for k in np.flatnonzero(plain) if lost.any() else ():
        if lost[of[k]].any():
            as_one(int(k))
    if len(whole) > known:
        more = own.align([], list(whole)[known:])
        found = {k: np.concatenate([found[k], more[k]]) for k in ("pairs", "flags", "n")} | {"bad": found["bad"] | {len(words) + known + k for k in more["bad"]}}
    of = [o[:0] if len(o) == 1 and int(o[0]) in found["bad"] else o for o in of]
    used = np.bincount(np.concatenate([np.zeros(0, np.int64), *of]), minlength=len(found["n"]))
    pairs, links = np.unique(found["pairs"], return_inverse=True)
    pair_n = np.zeros(len(pairs), np.int64)
    np.add.at(pair_n, links, np.repeat(used, found["n"]))
    n = len(text)

    def once(value, kind):
        return pa.array([value, *[None] * n], kind)

    ends = np.concatenate([[0, 0], np.cumsum([len(o) for o in of])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, chunk)), pa.concat_arrays([pa.nulls(1, pa.int64()), ids]), pa.array([False, *[True] * n]),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *of]).astype(np.int32))),
            once(pairs, pa.list_(pa.int64())), once(pair_n, pa.list_(pa.int64())), once(links.astype(np.int32), pa.list_(pa.int32())),
            once(found["flags"].tobytes(), pa.binary()), once(found["n"].astype(np.int32), pa.list_(pa.int32())),
        ],
        ["chunk", "doc_id", "is_doc", "words", "pairs", "pair_n", "links", "flags", "link_n"],
    )


def _lists(values: pa.Array, sizes: np.ndarray, between: str) -> pa.Array:
    """Consecutive values as one string per stretch."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values), between)


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums and groups of one chunk's documents, from its words' links and the counts of its pairs over the corpus."""
    give_back()
    left = left.combine_chunks()
    docs, own = left.filter(left["is_doc"]), left.filter(pc.invert(left["is_doc"])).slice(0, 1)
    flat = lambda name: own[name].combine_chunks().flatten().to_numpy()
    pairs, links, n = flat("pairs"), flat("links"), flat("link_n")
    flags = np.frombuffer(own["flags"][0].as_py(), np.uint8)
    order = np.argsort(right["pair"].to_numpy())
    count, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order]
    if len(count) != len(pairs):
        raise ValueError("the pairs of a chunk and their counts do not agree")
    ends = np.cumsum(n)
    new_a, new_b, last = (flags & f > 0 for f in (NEW_A, NEW_B, LAST))
    per_word = np.column_stack([_sums(x, ends) for x in (new_a, new_b, last, np.ones(len(links), bool), best[links], count[links])])
    # Ids as text, joined per group, word and document.
    group = np.cumsum(last) - last
    sides = []
    for new, ids in ((new_a, pairs >> 32), (new_b, pairs & 0xFFFFFFFF)):
        sides.append(_lists(pa.array(ids[links[new]]).cast(pa.string()), np.bincount(group[new], minlength=int(last.sum())), ","))
    per_group = pc.binary_join_element_wise(*sides, "|")
    word_text = _lists(per_group, per_word[:, 2], ";")
    words = docs["words"].combine_chunks()
    codes, sizes = words.flatten().to_numpy(), pc.list_value_length(words).to_numpy()
    stop = np.cumsum(sizes)
    total = np.column_stack([_sums(per_word[codes, k], stop) for k in range(6)])
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return pa.table({"doc_id": docs["doc_id"], **{k: total[:, i] for i, k in enumerate(names)}, "groups": _lists(word_text.take(pa.array(codes)), sizes, ";")})


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values`` that end at ``ends``."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(run[ends], prepend=0)


def chunks(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The stored chunks of ``docs`` and their documents."""

    def work(batches):
        own, n, first = aligner(a_path, b_path), 0, TaskContext.get().partitionId() << 32
        ids, text, size = [], [], 0
        # Few rows at a time become Python texts, however many a batch holds.
        for b in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            for i, t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), pc.binary_length(b.column(1)).to_pylist()):
                if size and size + k > chunk_bytes:
                    yield _chunk(own, first + n, pa.array(ids, pa.int64()), text)
                    ids, text, size, n = [], [], 0, n + 1
                    give_back()
                ids.append(i)
                text.append(t)
                size += k
        if ids:
            yield _chunk(own, first + n, pa.array(ids, pa.int64()), text)
        ids, text = [], []
        give_back()

    return stored(texts(docs).mapInArrow(work, CHUNKS), "alignment")


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, links that are their B id's most frequent, the sum of
    the links' counts over the corpus, and the groups as ``a1,a2|b1;a3|b2,b3``. Both paths must exist on every executor."""
    own = chunks(docs, a_path, b_path, chunk_bytes)
    heads = own.where(~F.col("is_doc"))
    each = heads.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p")).select("p.pairs", "p.pair_n")
    total = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_n").alias("n"))
    # A B id has at most one pair for each id of A.
    highest = F.max("n").over(W.partitionBy(F.expr("pair & 4294967295")))
    total = stored(total.select("pair", "n", (F.col("n") == highest).cast("long").alias("best")), "pairs")
    wanted = heads.select(F.col("chunk").alias("of"), F.explode("pairs").alias("pair")).join(total, "pair").select("of", "pair", "n", "best")
    return own.groupBy("chunk").cogroup(wanted.groupBy("of")).applyInArrow(_finish, ALIGNED)


def digests(aligned: DataFrame) -> DataFrame:
    return aligned.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))).drop("groups")
