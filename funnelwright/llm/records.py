"""Operator 1: token ids as length-delimited binary records with a separate offset index.

File format, all numbers little-endian. A shard has two files.

* ``<shard>.rec``: 8 bytes ``FWREC001``, then one frame per document:
  ``u64 payload length | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload``.
  The payload is the document's ids, 2 bytes each when the vocabulary has at most 65,536 ids, else 4.
* ``<shard>.idx``: one 32-byte entry per document: ``i64 doc_id | i64 frame offset | i64 number of ids | i64 flags``
  (flag 1: the id is null; flag 2: ids take 4 bytes).

A masked checksum is the CRC-32 rotated right by 15 bits plus 0xA282EAD8, so that a checksum of data that hold
checksums stays meaningful. The index lets a loader read any record of any shard by one seek.

Defined results: a null or empty text gives a record with the end id alone; rows with equal ids are ordered by text
and each keeps its own record; a null id sorts first; an empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from funnelwright.llm.common import shared_folder, shuffle_width, texts

MAGIC = b"FWREC001"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8"), ("flags", "<i8")])
MANIFEST = "shard int, path string, n_records long, n_tokens long"
RECORDS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(buf, at: int) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and the place after it; raises when a checksum does not hold."""
    head = bytes(buf[at : at + 8])
    (n,), (c,) = struct.unpack("<Q", head), struct.unpack_from("<I", buf, at + 8)
    if masked(head) != c:
        raise ValueError(f"length checksum does not hold at {at}")
    payload = bytes(buf[at + 12 : at + 12 + n])
    if len(payload) != n or masked(payload) != struct.unpack_from("<I", buf, at + 12 + n)[0]:
        raise ValueError(f"payload checksum does not hold at {at}")
    return payload, at + 16 + n


class PieceEncoder:
    """Byte-level BPE of the tokenizers library, applied once to each distinct piece between single spaces.

    The pre-tokenizer always cuts before a single space between two visible characters, and merges never cross its
    cuts, so the ids of a text are the ids of its pieces in order. New pieces go to the library many at a time, and
    come apart again at the ids whose token begins with a space. Texts with other spacing go through whole.
    ``limit`` bounds the pieces a worker remembers from batch to batch beyond those of the batch itself.
    """

    def __init__(self, path: str, limit: int = 900_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65_536 else "<u4")
        self.begins = np.zeros(max(vocab.values()) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.limit, self.known = limit, {}

    def whole(self, batch: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def spaced(self, pieces: list[str], at_once: int = 256) -> dict[str, bytes]:
        """Ids of each piece with a space before it."""
        out, wide = {}, self.dtype.itemsize
        for lo in range(0, len(pieces), at_once):
            own = pieces[lo : lo + at_once]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = (np.flatnonzero(self.begins[ids]) * wide).tolist()
            if len(cuts) != len(own):
                out.update(zip(own, self.whole([" " + p for p in own])))
                continue
            data = ids.tobytes()
            out.update(zip(own, [data[i:j] for i, j in zip(cuts, [*cuts[1:], len(data)])]))
        return out

    def encode(self, batch: list[str]) -> list[bytes]:
        # Whole texts: runs of spaces, spaces beside line ends, and anything that is neither printable nor a line end.
        plain = [t != "" and "  " not in t and " \n" not in t and "\n " not in t and t[-1] != " " and t.replace("\n", "").isprintable() for t in batch]
        cut = [t.split(" ") if p else None for t, p in zip(batch, plain)]
        own = set().union(*[p[1:] for p in cut if p is not None])
        fresh = self.spaced(list(own.difference(self.known)))
        if len(self.known) + len(fresh) > self.limit:
            # Start again from the batch's pieces; frequent ones come back at once.
            self.known = {x: self.known[x] for x in own.difference(fresh)}
        self.known.update(fresh)
        known = self.known
        heads = iter(self.whole([p[0] for p in cut if p is not None]))
        rest = iter(self.whole([t for t, p in zip(batch, plain) if not p]))
        return [next(rest) if p is None else next(heads) + b"".join([known[x] for x in p[1:]]) for p in cut]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker, kept from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write one shard per range of (``doc_id``, text); returns the stored manifest.

    ``tokenizer`` is a path every executor has. Ranges hold about equal numbers of documents (``shards``, by default
    the session's shuffle partitions). A task writes files named after its attempt and only the manifest of the
    attempt that Spark commits names them, so retries and lost executors leave no half-written shard in the result.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "records")

    def write(batches):
        ctx = TaskContext.get()
        enc, out, idx, at, rows, tokens = encoder(tokenizer), None, None, len(MAGIC), 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        uri = f"{folder}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, path = _files(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out, idx = fs.open_output_stream(f"{path}.rec"), fs.open_output_stream(f"{path}.idx")
                out.write(MAGIC)
            ids = batch.column(0).to_pylist()
            entries = np.zeros(len(ids), ENTRY)
            for lo in range(0, len(ids), 4096):
                part = enc.encode(batch.column(1).slice(lo, 4096).to_pylist())
                for k, (doc, own) in enumerate(zip(ids[lo : lo + 4096], part), lo):
                    data = frame(own + end)
                    n = (len(own) + len(end)) // enc.dtype.itemsize
                    entries[k] = (doc or 0, at, n, (doc is None) + 2 * (enc.dtype.itemsize == 4))
                    at, rows, tokens = at + len(data), rows + 1, tokens + n
                    out.write(data)
            idx.write(entries.tobytes())
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([ctx.partitionId()], pa.int32()), "path": [uri], "n_records": [rows], "n_tokens": [tokens]})

    ordered = texts(docs).repartitionByRange(shards or shuffle_width(spark), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the shards: document, ids before it in the whole set, number of ids, CRC-32 of its ids as u32."""
    # One row per shard: the running total over them is small, whatever the number of documents.
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = _files(path)
                with fs.open_input_file(f"{p}.idx") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with fs.open_input_file(f"{p}.rec") as f:
                    if f.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{path} is not a record file")
                    for lo in range(0, len(index), 512):
                        own = index[lo : lo + 512]
                        first = int(own["offset"][0])
                        stop = int(index["offset"][lo + 512]) if lo + 512 < len(index) else f.size()
                        buf, sums = f.read_at(stop - first, first), []
                        for e in own:
                            payload, _ = unframe(buf, int(e["offset"]) - first)
                            ids = np.frombuffer(payload, "<u4" if e["flags"] & 2 else "<u2")
                            if len(ids) != e["n_tokens"]:
                                raise ValueError(f"the index of {path} does not fit its records")
                            sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        starts = base + np.cumsum(own["n_tokens"]) - own["n_tokens"]
                        base += int(own["n_tokens"].sum())
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(own["doc_id"], mask=(own["flags"] & 1).astype(bool)), "start": pa.array(starts),
                            "n_tokens": pa.array(own["n_tokens"]), "ids_crc32": pa.array(sums, pa.int64()),
                        })

    shards = manifest.select("path", before.alias("before"))
    return shards.repartition(shuffle_width(manifest.sparkSession)).mapInArrow(read, RECORDS)


def record_at(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """The document and ids of one record of a shard, by one seek through the index: what a shuffling loader does."""
    fs, p = _files(path)
    with fs.open_input_file(f"{p}.idx") as f:
        (e,) = np.frombuffer(f.read_at(ENTRY.itemsize, ENTRY.itemsize * number), ENTRY)
    wide = 4 if e["flags"] & 2 else 2
    with fs.open_input_file(f"{p}.rec") as f:
        payload, _ = unframe(f.read_at(16 + wide * int(e["n_tokens"]), int(e["offset"])), 0)
    return (None if e["flags"] & 1 else int(e["doc_id"])), np.frombuffer(payload, f"<u{wide}").astype(np.int64)
