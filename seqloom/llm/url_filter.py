"""URL filter: a sorted array of 64-bit digests in a memory-mapped file.

An entry is a host and a path, written host + path; it fits its host and all subdomains of
it if the URL's path starts with the entry's. The index file holds the XXH64 keys of all
entries in ascending order, and behind them the entries themselves; that of a long list, which is
a table, has parts by ranges of keys. It is written once to shared storage, and each executor
fetches it and maps it into memory, so that its workers share one copy. A URL is probed with the host endings and path beginnings that some entry
could have, all URLs of a batch in one vectorised binary search, and a hit counts only if the
stored string is the one that was looked for.

Nulls: a URL that is null or without `://` has an empty host and path, which no entry fits.
Where several rules fit, the longest one wins (of equally long ones the first in string
order). Repeated rows each get a row, an empty table of pages gives none, and without entries every
URL without a rule is allowed. A URL's length has no bound: what is probed grows with the different
lengths of entries, not with the URL's. Other columns play no part, whatever their names. Null and
repeated entries of a list count not at all and once; an entry without a slash is a whole host.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (rule, verdict); the rules of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Entries of the method's own list: link farms.
BLOCKED = ("spam-farm.example.com/", "spam-farm.example.net/", "spam-farm.example.org/")
ALLOW, BLOCK = "allow", "block"
_MAGIC = b"URLDIG2\0"
#: Entries in a part of the index of a long list.
PART = 1_000_000


def key(entry: bytes) -> int:
    """XXH64 with the seed of F.xxhash64, which gives the same digest of a string."""
    import xxhash

    return xxhash.xxh64_intdigest(entry, 42)


def part_bytes(keys: np.ndarray, text: list[bytes], kinds: np.ndarray) -> bytes:
    """A part of the index file: its size, header, keys, places of the strings, kinds, strings. Keys are in ascending order."""
    hosts = [e.split(b"/", 1)[0] for e in text]
    depths, lengths = sorted({h.count(b".") + 1 for h in hosts}), sorted({len(e) - len(h) for e, h in zip(text, hosts, strict=True)})
    head = np.array([len(text), len(depths), len(lengths), *depths, *lengths], "<u8").tobytes()
    places = np.concatenate(([0], np.cumsum([len(e) for e in text], dtype=np.int64))).astype("<u8").tobytes()
    whole = _MAGIC + head + keys.astype("<u8").tobytes() + places + kinds.astype("<u8").tobytes() + b"".join(text)
    whole += bytes(-len(whole) % 8)
    return np.array([len(whole)], "<u8").tobytes() + whole


def index_bytes(rules: Iterable[tuple[str, str]], blocked: Iterable[str], digest=key) -> bytes:
    """An index file of one part.

    kinds: bit 0 is set for block, bit 1 for a rule; a list entry and a rule can have one string.
    """
    entries = {(r.encode(), 2 + (v == BLOCK)) for r, v in rules} | {(b.encode(), 1) for b in blocked}
    rows = sorted((digest(e), e, k) for e, k in entries)
    return part_bytes(np.array([d for d, _, _ in rows], np.uint64), [e for _, e, _ in rows], np.array([k for _, _, k in rows], np.uint64))


def listed_parts(blocked: DataFrame, size: int = PART) -> Iterator[bytes]:
    """The parts of an index of blocked(entry), each of at most `size` entries.

    Entries are sorted and cut into parts by the executors and written to shared storage; the driver
    has one part at a time.
    """
    first = F.lit(-(1 << 63)).cast("long")  # turns the order of signed numbers into that of unsigned ones
    rows = blocked.select("entry").filter("entry IS NOT NULL").distinct().select("entry", F.xxhash64("entry").bitwiseXOR(first).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(keys: list[np.ndarray], text: list[bytes]) -> pa.RecordBatch:
            found = part_bytes(np.concatenate(keys), text, np.ones(len(text), np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["part"])

        keys, text = [], []
        for whole in batches:
            for batch in common.sliced([whole], size):
                if text and len(text) + batch.num_rows > size:
                    yield part(keys, text)
                    keys, text = [], []
                keys.append(batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63))
                text += [e.encode() for e in batch.column(0).to_pylist()]
        if text:
            yield part(keys, text)

    parts = common.staged(rows.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(run, "part binary"), "url-parts")
    for row in parts.toLocalIterator():
        yield bytes(row["part"])


class _Part:
    def __init__(self, whole: np.ndarray):
        if whole[:8].tobytes() != _MAGIC:
            raise ValueError("not an index of URLs")
        words = whole[8:].view("<u8")
        n, d, p = (int(x) for x in words[:3])
        self.depths, self.lengths = words[3 : 3 + d].tolist(), words[3 + d : 3 + d + p].tolist()
        at = 3 + d + p
        self.keys, self.places, self.kinds = words[at : at + n], words[at + n : at + 2 * n + 1], words[at + 2 * n + 1 : at + 3 * n + 1]
        self.text = whole[8 * (at + 3 * n + 2) :]

    def found(self, probe: np.ndarray, wanted: list[bytes]) -> Iterator[tuple[int, int]]:
        """(position in wanted, kind) of the strings that are entries."""
        if not len(self.keys):
            return
        near = np.flatnonzero((probe >= self.keys[0]) & (probe <= self.keys[-1]))
        first, last = np.searchsorted(self.keys, probe[near], "left"), np.searchsorted(self.keys, probe[near], "right")
        for j in np.flatnonzero(last > first):
            for e in range(int(first[j]), int(last[j])):  # more than one where digests collide
                if self.text[int(self.places[e]) : int(self.places[e + 1])].tobytes() == wanted[near[j]]:
                    yield int(near[j]), int(self.kinds[e])


class Index:
    """An index file, mapped into memory."""

    def __init__(self, path: str, digest=key):
        whole, self.parts, self.digest = np.memmap(path, np.uint8, "r"), [], digest
        at = 0
        while at < len(whole):
            size = int(whole[at : at + 8].view("<u8")[0])
            self.parts.append(_Part(whole[at + 8 : at + 8 + size]))
            at += 8 + size
        self.depths, self.lengths = (sorted({x for p in self.parts for x in getattr(p, name)}) for name in ("depths", "lengths"))

    def candidates(self, host: bytes, path: bytes) -> Iterator[bytes]:
        labels = host.split(b".")
        for d in self.depths if host else ():
            if d <= len(labels):
                end = b".".join(labels[len(labels) - d :])
                for n in self.lengths:
                    if n <= len(path):
                        yield end + path[:n]

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """(rule or None, verdict) of each URL."""
        owner, wanted = [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            for c in self.candidates(h.encode(), p.encode()):
                owner.append(i)
                wanted.append(c)
        rules: list[tuple[bytes, int] | None] = [None] * len(hosts)
        listed = [False] * len(hosts)
        probe = np.array([self.digest(c) for c in wanted], np.uint64)
        for part in self.parts:
            for j, kind in part.found(probe, wanted):
                i = owner[j]
                if not kind & 2:
                    listed[i] = True
                elif rules[i] is None or (-len(wanted[j]), wanted[j]) < (-len(rules[i][0]), rules[i][0]):
                    rules[i] = wanted[j], kind
        out: list[tuple[str | None, str]] = []
        for rule, hit in zip(rules, listed, strict=True):
            if rule:
                out.append((rule[0].decode(), BLOCK if rule[1] & 1 else ALLOW))
            else:
                out.append((None, BLOCK if hit else ALLOW))
        return out


def publish(spark: SparkSession, parts: Iterable[bytes]) -> str:
    """The name under which executors find an index of these parts as a local file. It is kept in shared storage."""
    name = f"url-digests-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    for data in parts:
        for at in range(0, len(data), 1 << 20):
            out.write(bytearray(data[at : at + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judged(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, blocked: Iterable[str] | DataFrame = BLOCKED) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page. blocked: a few entries, or a table (entry) of any number of them."""
    if isinstance(blocked, DataFrame):
        parts = itertools.chain([index_bytes(rules, [])], listed_parts(blocked))
    else:
        parts = [index_bytes(rules, blocked)]
    name = publish(pages.sparkSession, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            got = index.judge(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            out = batch.append_column("rule", pa.array([g[0] for g in got], pa.string()))
            yield out.append_column("verdict", pa.array([g[1] for g in got], pa.string()))

    rest = F.when(F.col("url").contains("://"), F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select("page_id", "url", rest.alias("rest"))
    rows = rows.select(
        "page_id",
        "url",
        F.coalesce(common.ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, host string, path string, rule string, verdict string")
