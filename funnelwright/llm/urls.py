"""Operator 13: URL filter over sorted digest arrays.

A list of rules (host, path, verdict) of any size is built by Spark into two arrays, one of hosts and one of rules,
each a set of shards by range of digest. A shard is three files in the shared folder:

* ``.key``: 64-bit xxhash digests (seed 42), sorted, 8 bytes each;
* ``.ref``: per key the places where its string and its values end, two 64-bit numbers;
* ``.str``: the strings in UTF-8, and ``.val``: 32-bit values (a host's distinct path lengths; a rule's verdict).

Tasks memory-map the shards their candidates fall into (a store without memory maps is read shard by shard), probe
them by vectorised binary search and compare the stored string of every equal digest, so a collision is never a hit.

A rule fits its host and all subdomains if the path of the URL starts with the rule's. First the suffixes of a URL's
host that have as many labels as some rule's host are looked up; those found name the path lengths worth looking up.
The longest rule (characters of host and path) wins, among equals that of the longer host; of rules equal in host and
path, block wins. ``listed`` hosts and paths are blocked by the same test where no rule fits; all else is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path and is allowed; A-Z of hosts are lowered,
in URLs and rules, paths stay; rules with a null or empty host are left out, a null path counts as empty; without rules
all is allowed; repeated rows give repeated results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from funnelwright.llm.common import shared_folder, shuffle_width

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
JUDGED = "page_id long, host string, path string, rule string, verdict string"
MANIFEST = "path string, first long, last long, n long"
SEED = 42


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Shard:
    path: str
    first: int
    last: int
    n: int


@dataclass(frozen=True)
class DigestArray:
    """A built array: one entry per shard, by digest. Its size grows with the shards, not with the keys."""

    shards: tuple[Shard, ...]


@dataclass(frozen=True)
class UrlRules:
    hosts: DigestArray
    rules: DigestArray
    labels: tuple[int, ...]  # label counts of the rules' hosts


def digest_array(strings: DataFrame, folder: str, shards: int) -> DigestArray:
    """Write ``string`` with its ``vals`` (array of int), one row per string, as an array of ``shards`` ranges."""
    spark = strings.sparkSession

    def write(batches):
        from pyarrow.fs import FileSystem

        ctx, files, n, at, vals, first, last = TaskContext.get(), None, 0, 0, 0, 0, 0
        uri = f"{folder}/{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        for b in batches:
            if not b.num_rows:
                continue
            if files is None:
                fs, path = FileSystem.from_uri(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                files, first = {k: fs.open_output_stream(f"{path}.{k}") for k in ("key", "ref", "str", "val")}, b.column(0)[0].as_py()
            own = [x.encode() for x in b.column(1).to_pylist()]
            held = b.column(2).to_pylist()
            ref = np.empty((b.num_rows, 2), "<i8")
            ref[:, 0] = at + np.cumsum([len(x) for x in own])
            ref[:, 1] = vals + np.cumsum([len(x) for x in held])
            at, vals, n, last = int(ref[-1, 0]), int(ref[-1, 1]), n + b.num_rows, b.column(0)[-1].as_py()
            files["key"].write(b.column(0).to_numpy().astype("<i8").tobytes())
            files["ref"].write(ref.tobytes())
            files["str"].write(b"".join(own))
            files["val"].write(np.array([v for x in held for v in x], "<i4").tobytes())
        if files:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"path": [uri], "first": [first], "last": [last], "n": [n]})

    rows = strings.select(F.xxhash64("string").alias("digest"), "string", "vals")
    # A task writes files named after its attempt; only the attempts that Spark commits are in the manifest.
    rows.repartitionByRange(shards, "digest").sortWithinPartitions("digest", "string").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    own = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("first", "last").collect()
    return DigestArray(tuple(Shard(*r) for r in own))


def build(rules: DataFrame, shards: int | None = None) -> UrlRules:
    """``rules`` (host, path, verdict) as digest arrays in the shared folder. Only the manifest reaches the driver."""
    spark = rules.sparkSession
    folder, shards = shared_folder(spark, "urls"), shards or shuffle_width(spark)
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").cast("int").alias("block")).where("host <> ''")
    hosts = clean.groupBy(F.col("host").alias("string")).agg(F.sort_array(F.collect_set(F.char_length("path"))).alias("vals"))
    keys = clean.groupBy(F.concat_ws("\t", "host", "path").alias("string")).agg(F.array(F.max(F.coalesce("block", F.lit(0)))).alias("vals"))
    labels = clean.select((F.size(F.split("host", r"\.", -1))).alias("n")).distinct().orderBy("n").collect()
    return UrlRules(digest_array(hosts, f"{folder}/hosts", shards), digest_array(keys, f"{folder}/rules", shards), tuple(r.n for r in labels))


class Reader:
    """The arrays of one task. Shards are opened when a candidate falls into their range."""

    def __init__(self, array: DigestArray):
        self.shards, self.last = array.shards, np.array([s.last for s in array.shards], np.int64)

    def _open(self, shard: Shard):
        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, path = FileSystem.from_uri(shard.path)
        kinds = (("key", "<i8"), ("ref", "<i8"), ("str", "u1"), ("val", "<i4"))
        if isinstance(fs, LocalFileSystem):
            parts = [np.memmap(f"{path}.{k}", t, "r") if fs.get_file_info(f"{path}.{k}").size else np.zeros(0, t) for k, t in kinds]
        else:
            parts = []
            for k, t in kinds:
                with fs.open_input_file(f"{path}.{k}") as f:
                    parts.append(np.frombuffer(f.read(), t))
        parts[1] = parts[1].reshape(-1, 2)
        return parts

    def probe(self, strings: list[str]) -> dict[int, list[int]]:
        """Values of those ``strings`` that are held, by their place in the list."""
        import xxhash

        if not strings or not self.shards:
            return {}
        raw = [s.encode() for s in strings]
        want = np.array([xxhash.xxh64_intdigest(r, SEED) for r in raw], np.uint64).view(np.int64)
        order = np.argsort(want, kind="stable")
        # A digest shared by two strings may lie on both sides of a cut: every shard whose range holds it is asked.
        out = {}
        for shard in self.shards:
            lo, hi = np.searchsorted(want[order], shard.first, "left"), np.searchsorted(want[order], shard.last, "right")
            if lo == hi:
                continue
            keys, ref, text, vals = self._open(shard)
            own = order[lo:hi]
            left, right = np.searchsorted(keys, want[own], "left"), np.searchsorted(keys, want[own], "right")
            for k in np.flatnonzero(left < right):
                for at in range(int(left[k]), int(right[k])):
                    s = int(ref[at - 1, 0]) if at else 0
                    if text[s : int(ref[at, 0])].tobytes() == raw[own[k]]:
                        out[int(own[k])] = vals[int(ref[at - 1, 1]) if at else 0 : int(ref[at, 1])].tolist()
        return out


def suffixes(host: str, labels: tuple[int, ...]) -> list[str]:
    """Suffixes of ``host`` at label borders that have one of the given numbers of labels."""
    cuts = [0, *(k + 1 for k, c in enumerate(host) if c == ".")]
    return [host[cuts[-n] :] for n in labels if n <= len(cuts)]


class Judge:
    def __init__(self, rules: UrlRules):
        self.labels, self.hosts, self.rules = rules.labels, Reader(rules.hosts), Reader(rules.rules)

    def best(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """Per URL the winning rule's string and whether it blocks; equal hosts and candidates are probed once."""
        own = {h: suffixes(h, self.labels) if h else [] for h in set(hosts)}
        names = sorted({s for v in own.values() for s in v if s})
        held = {names[k]: v for k, v in self.hosts.probe(names).items()}
        own = {h: [s for s in v if s in held] for h, v in own.items()}
        wanted = [[(s, n) for s in own[h] for n in held[s] if n <= len(p)] for h, p in zip(hosts, paths)]
        keys = sorted({f"{s}\t{p[:n]}" for w, p in zip(wanted, paths) for s, n in w})
        found = {keys[k]: v[0] for k, v in self.rules.probe(keys).items()}
        out = []
        for w, p in zip(wanted, paths):
            fits = [(len(s) + n, len(s), s + p[:n], found[f"{s}\t{p[:n]}"]) for s, n in w if f"{s}\t{p[:n]}" in found]
            out.append((max(fits)[2], bool(max(fits)[3])) if fits else None)
        return out


def judge(pages: DataFrame, rules: UrlRules, listed: UrlRules | None = None) -> DataFrame:
    """Per row of ``pages``: host and path of its ``url``, the rule that decides (null if none does) and the verdict."""

    def work(batches):
        by_rule, by_list = Judge(rules), Judge(listed) if listed else None
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            first = by_rule.best(hosts, paths)
            second = by_list.best(hosts, paths) if by_list else [None] * len(first)
            verdict = ["block" if (a[1] if a else c) else "allow" for a, c in zip(first, second)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([a[0] if a else None for a in first], pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return own.mapInArrow(work, JUDGED)
