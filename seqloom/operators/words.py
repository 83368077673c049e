"""Words of sequences: windows and hashes, the sampled index, word counts, sketches.

A window's hash is polynomial, so that it is a difference of two prefix sums times a power, whatever the window's
length: with S[i] the sum of code[j] / BASE ** j over j < i modulo a prime, the window of k letters at i has
(S[i + k] - S[i]) * BASE ** (i + k - 1). A sequence is read once into numbers and all its windows are hashed together, in Arrow batches.
Strings of windows are never cut out but where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.functions.lanes import coded

#: Rows of a batch that goes back to Spark, about.
ROWS = 1 << 18


class Powers:
    """BASE ** i and BASE ** -i modulo MODULUS, as far as they were asked for."""

    up, down = np.ones(1, np.int64), np.ones(1, np.int64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The first n of both."""
        while len(cls.up) < n:
            size = len(cls.up)
            more, less = pow(C.BASE, size, C.MODULUS), pow(C.BASE, -size, C.MODULUS)
            cls.up, cls.down = (np.concatenate([x, x * f % C.MODULUS]) for x, f in ((cls.up, more), (cls.down, less)))
        return cls.up[:n], cls.down[:n]


class Prefixes:
    """The prefix sums of a sequence."""

    def __init__(self, text: str):
        codes = coded(text).astype(np.int64)
        self.n = len(codes)
        self.up, down = Powers.of(self.n + 1)
        self.sums = np.concatenate(([0], np.cumsum(codes * down[: self.n] % C.MODULUS))) % C.MODULUS

    def hashes(self, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the windows of k letters at some places, or at all."""
        if at is None:
            n = max(0, self.n - k + 1)
            return (self.sums[k : k + n] - self.sums[:n]) % C.MODULUS * self.up[k - 1 : k - 1 + n] % C.MODULUS
        return (self.sums[at + k] - self.sums[at]) % C.MODULUS * self.up[at + k - 1] % C.MODULUS


def _each(seqs: DataFrame, alphabet: int, names: list[str], of: Callable[[Prefixes], list[np.ndarray]], kinds: list[str], keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """Rows (keep..., names...) of what `of` makes of each sequence, as arrays of equal lengths; a null sequence has none."""
    own = seqs.select(*keep, C.reduced(F.col("seq"), alphabet).alias("seq"))
    schema = ", ".join([f"{c} {own.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {k}" for c, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, size = [], [], 0
            for i, x in enumerate(batch.column(len(keep)).to_pylist()):
                got = of(Prefixes(x or ""))
                rows.append((i, len(got[0])))
                found.append(got)
                size += len(got[0])
                if size >= ROWS or i == batch.num_rows - 1:
                    at = pa.array(np.repeat(*np.array(rows, np.int64).T))
                    arrays = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keep))), *arrays], [*keep, *names])
                    rows, found, size = [], [], 0

    return own.mapInArrow(run, schema)


def windows(seqs: DataFrame, k: int, alphabet: int = 0) -> DataFrame:
    """(seq_id, pos, hash) of every window of k letters."""

    def of(p: Prefixes) -> list[np.ndarray]:
        found = p.hashes(k)
        return [np.arange(len(found), dtype=np.int32), found]

    return _each(seqs, alphabet, ["pos", "hash"], of, ["int", "long"])


def window_texts(seqs: DataFrame, k: int) -> DataFrame:
    """(seq_id, pos, word): windows as strings."""
    rows = seqs.select("seq_id", F.array_remove(F.split("seq", ""), "").alias("_c")).select("seq_id", "_c", F.size("_c").alias("_n"))
    return rows.select("seq_id", "_c", F.explode(F.when(F.col("_n") >= k, F.sequence(F.lit(0), F.col("_n") - k)).otherwise(F.array().cast("array<int>"))).alias("pos")).select("seq_id", "pos", F.array_join(F.slice("_c", F.col("pos") + 1, k), "").alias("word"))


def _picked(p: Prefixes, k: int, mincnt: int, high_perc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the index's words, whether they are longer by one, and their hashes."""
    count = max(0, p.n - (k - 1))
    at = np.arange(0, count, max(1, count // mincnt))
    longer = (at > 0) & (at * 100 // max(1, count) >= 100 - high_perc) & (at + k + 1 <= p.n)
    found = np.empty(len(at), np.int64)
    for more in (False, True):
        own = longer == more
        found[own] = p.hashes(k + more, at[own])
    return at, longer, found


def sampled(seqs: DataFrame, k: int, mincnt: int, high_perc: int = 0, alphabet: int = 0, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(seq_id, pos, len, hash) of the index's words: about mincnt of each sequence, evenly spaced.

    Words at the last high_perc percent of the positions are longer by one; the first is not.
    """

    def of(p: Prefixes) -> list[np.ndarray]:
        at, longer, found = _picked(p, k, mincnt, high_perc)
        return [at.astype(np.int32), np.where(longer, k + 1, k).astype(np.int32), found]

    return _each(seqs, alphabet, ["pos", "len", "hash"], of, ["int", "int", "long"], keep)


def index(seqs: DataFrame, k: int, mincnt: int, high_perc: int = 0, alphabet: int = 0, n_buckets: int | None = None, lengths: bool = False) -> DataFrame:
    """(bucket, seq_id), distinct: the inverted index of sampled words; with lengths also seqlen.

    A bucket is a word's hash, or its remainder modulo n_buckets where words may share buckets. A seq_id is one row, so that
    repeats are left out where it is read, without a shuffle.
    """
    keep = ("seq_id", "seqlen") if lengths else ("seq_id",)

    def of(p: Prefixes) -> list[np.ndarray]:
        found = _picked(p, k, mincnt, high_perc)[2]
        return [np.unique(found % n_buckets if n_buckets else found)]

    return _each(seqs, alphabet, ["bucket"], of, ["long"], keep).select("bucket", *keep)


def probes(seqs: DataFrame, k: int, longer: bool = False, alphabet: int = 0, n_buckets: int | None = None, lengths: bool = False, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(bucket, seq_id), distinct: every word of k letters, and of k + 1 if longer; with lengths also seqlen.

    A sequence's repeats are left out where it is read, without a shuffle; so are buckets that `only` (meeting.known) says are in no index.
    """
    keep = ("seq_id", "seqlen") if lengths else ("seq_id",)

    def of(p: Prefixes) -> list[np.ndarray]:
        found = np.concatenate([p.hashes(k), p.hashes(k + 1)]) if longer else p.hashes(k)
        found = np.unique(found % n_buckets if n_buckets else found)
        return [found if only is None else found[only(found)]]

    return _each(seqs, alphabet, ["bucket"], of, ["long"], keep).select("bucket", *keep)


def word_sets(seqs: DataFrame, k: int, alphabet: int = 0, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keep..., words, n): the different words of a sequence by 16 bits of their hash, as ascending numbers of two bytes, and how many windows it has."""

    own = seqs.select(*keep, C.reduced(F.col("seq"), alphabet).alias("seq"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [Prefixes(x or "").hashes(k) for x in batch.column(len(keep)).to_pylist()]
            found = [np.unique((h % 65536).astype("<u2")).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(found, pa.binary()), pa.array([len(h) for h in hashes], pa.int64())], [*keep, "words", "n"])

    return own.mapInArrow(run, f"{kinds}, words binary, n long")


def counts(seqs: DataFrame, k: int, alphabet: int = 0) -> DataFrame:
    """(seq_id, word, cnt): the multiset of a sequence's words, by 16 bits of their hash. Counted where it is read: a seq_id is one row."""

    def of(p: Prefixes) -> list[np.ndarray]:
        words, n = np.unique(p.hashes(k) % 65536, return_counts=True)
        return [words.astype(np.int32), n.astype(np.int64)]

    return _each(seqs, alphabet, ["word", "cnt"], of, ["int", "long"])


def sketches(seqs: DataFrame, k: int, size: int = 32, alphabet: int = 0, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """(keep..., sketch): the `size` largest hashes of each sequence's words, repeats included, cut to 16 bits, in descending order."""
    own = seqs.select(*keep, C.reduced(F.col("seq"), alphabet).alias("seq"))
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(len(keep)).to_pylist():
                h = Prefixes(x or "").hashes(k)
                h = np.partition(h, len(h) - size)[len(h) - size :] if len(h) > size else h
                found.append(np.sort(h % 65536)[::-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), pa.array(found, pa.list_(pa.int64()))], [*keep, "sketch"])

    return own.mapInArrow(run, f"{kinds}, sketch array<long>")


def posting_histogram(postings: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """(bin, buckets, entries) by the logarithm of posting size; empty buckets are bin 0 where n_buckets says how many there are."""
    sizes = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    bins = sizes.groupBy(C.log_bin(F.col("size")).alias("bin")).agg(F.count(F.lit(1)).alias("buckets"), F.sum("size").alias("entries"))
    if n_buckets is None:
        return bins
    empty = sizes.agg((F.lit(n_buckets) - F.count(F.lit(1))).alias("buckets")).select(F.lit(0).alias("bin"), "buckets", F.lit(0).cast("long").alias("entries"))
    return bins.unionByName(empty.filter("buckets > 0"))


def pair_cost(postings: DataFrame, cap: int) -> DataFrame:
    """(all_pairs, capped_pairs): comparisons that the index stands for, without and with the cap."""
    sizes = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(F.sum(F.col("size") * F.col("size")).alias("all_pairs"), F.sum(F.col("size") * F.least(F.col("size"), F.lit(cap))).alias("capped_pairs"))
