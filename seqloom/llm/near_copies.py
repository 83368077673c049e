"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `least` percent.

Candidates are found by two joins. The first is simhash's: 64-bit SimHashes of the shingle sets, and
its binary-trie self-join at a distance of at most `bits`, whose components are groups. Texts at a
similarity of 0.8 differ in about ten bits, and a budget that wide leaves blocks of four bits to
join by; so the second join finds what is farther apart: groups share one of BANDS bands of ROWS
min-hashes each, and a pair at 0.8 shares none with a chance of (1 - 0.8 ** 4) ** 32 = 5e-8.

The members of a group meet in a task with their whole shingle sets, and all pairs of them are
compared there by a product of matrices; what leaves the task is a spanning forest of the links,
never the pairs. A group with more than `cell` members is dealt out by pairs of blocks of them.
Bands that have the same members are compared once, and those whose members the first join's links
have all joined are not compared again. No group is dropped, capped or sampled.

A text of fewer than `words` words is one shingle; texts without words have the empty set and are
copies of each other. A null text counts as empty. Repeated rows and null doc_ids are treated as in
simhash. An empty table gives an empty one; columns of other names are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Words of a shingle, and the similarity in percent from which on texts are near copies.
WORDS, LEAST = 5, 80
#: Bits in which SimHashes may differ in the trie join.
BITS = 5
BANDS, ROWS = 32, 4
#: Members of a band that one task compares, and shingles that are columns of a product at once.
CELL, COLUMNS = 512, 4096
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2)
_MIX, _BAND = np.uint64(0x9E3779B97F4A7C15), _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The different hashes of a text's runs of `words` words, ascending."""
    import xxhash

    tokens = text.encode().lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a shingle set's bands; none for the empty set."""
    if not len(found):
        return np.array([], np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        least = np.minimum(least, (found[at : at + 512] * _MULTIPLY + _ADD).min(axis=1))
    key = _BAND.copy()
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, fp, sim, bands) of every row; fp is a digest of the shingle set, sim its SimHash."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in common.sliced(batches):
            fps, sims, keys = [], [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), words)
                fps.append(xxhash.xxh64_intdigest(found.tobytes()))
                sims.append(simhash.folded(found.astype(">u8").view(np.uint8).reshape(-1, 8)))
                keys.append(bands(found).view(np.int64))
            fp, sim = (pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (fps, sims))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp, sim, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fp", "sim", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, sim long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, shingles) of wanted (doc_id, text_hash, fp), written to shared storage."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            found = [shingles(x.as_py(), words).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["fp", "shingles"])

    wanted = common.small(wanted.withColumnsRenamed({"doc_id": "__sl_doc", "text_hash": "__sl_hash"}), F.lit(32))
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = held.join(wanted, held["doc_id"].eqNullSafe(F.col("__sl_doc")) & (held["text_hash"] == F.col("__sl_hash"))).select("fp", "text")
    return common.staged(rows.mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"]), "copies-shingles")


def near_pairs(sets: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs of shingle sets that are similar enough."""
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) == 2:
        a, b = sorted(sizes.tolist())
        if a * 100 < b * least:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        rank = np.cumsum(shared) - 1
        keep = shared[column]
        owner, column = owner[keep], rank[column[keep]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((len(sets), len(sets)), np.int64)
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, int(rank[-1]) + 1 - at)), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            both += (part @ part.T).astype(np.int64)  # counts up to 4096 are exact
    return np.nonzero(np.triu(both * 100 >= (sizes[:, None] + sizes[None, :] - both) * least, 1))


def _cells(members: DataFrame, cell: int) -> DataFrame:
    """(band, a, b, fp): the members of a band, those of a large one by pairs (a, b) of blocks."""
    parts = F.ceil(F.col("n") * 2 / cell)
    other = F.when(F.col("n") <= cell, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), parts - 1), lambda x: x != F.col("own")))
    own = F.when(F.col("n") <= cell, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("fp"), parts))
    rows = members.withColumn("own", own).select("band", "fp", "own", F.explode(other).alias("other"))
    return rows.select("band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")


def _compared(rows: DataFrame, least: int) -> DataFrame:
    """Edges (u > v) that span the links in each cell of rows (band, a, b, fp, shingles)."""

    def edges(fps: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        i, j = near_pairs(sets, least)
        root = simhash.spanned(i, j, len(fps))
        x = np.array(fps, np.int64)
        at = np.flatnonzero(root != np.arange(len(fps)))
        return np.maximum(x[at], x[root[at]]), np.minimum(x[at], x[root[at]])

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []
        for batch in batches:
            us, vs = [], []
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "a", "b")), strict=True))
            starts, flat = batch.column("shingles").offsets.to_numpy(), batch.column("shingles").values.to_numpy()
            for i, (key, fp) in enumerate(zip(keys, batch.column("fp").to_pylist(), strict=True)):
                if key != now:
                    if len(fps) > 1:
                        u, v = edges(fps, sets)
                        us.append(u)
                        vs.append(v)
                    now, fps, sets = key, [], []
                fps.append(fp)
                sets.append(flat[starts[i] : starts[i + 1]])
            sets = [x.copy() for x in sets]  # the last cell may go on in the next batch
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
        if len(fps) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in edges(fps, sets)], ["u", "v"])

    dealt = rows.repartition("band", "a", "b").sortWithinPartitions("band", "a", "b")
    return dealt.mapInArrow(run, "u long, v long")


def trie_groups(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(band, fp, n): the shingle sets of each component of the SimHashes' trie join, of which there are n > 1."""
    nodes = prints.select("sim", "fp").distinct()
    edges = simhash.links(nodes.select(F.col("sim").alias("fp")).distinct(), bits)
    roots = simhash.components(edges).withColumnRenamed("u", "sim")
    placed = common.staged(nodes.join(roots, "sim", "left").select(F.coalesce("root", "sim").alias("band"), "fp"), "copies-placed")
    return placed.join(placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "band")


def band_groups(prints: DataFrame) -> DataFrame:
    """(band, fp, n): the n > 1 shingle sets that share a band."""
    rows = prints.select("fp", "bands").dropDuplicates(["fp"]).select("fp", F.explode("bands").alias("band"))
    mark = F.bit_xor(F.xxhash64("fp", F.lit(1)))
    groups = rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), mark.alias("y")).filter("n > 1")
    # of bands with the same members, as their number and 128 bits of them tell, one is compared
    groups = groups.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    return rows.join(groups, "band")


def _open(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members of those bands that edges (u, v) don't join yet."""
    roots = simhash.components(edges).withColumnRenamed("u", "fp")
    root = F.coalesce("root", "fp")
    bands = members.join(roots, "fp", "left").groupBy("band").agg(F.min(root).alias("low"), F.max(root).alias("high"))
    return members.join(bands.filter("low != high").select("band"), "band", "left_semi")


def links(docs: DataFrame, prints: DataFrame, words: int = WORDS, least: int = LEAST, cell: int = CELL, bits: int = BITS) -> DataFrame:
    """Edges (u > v) between different shingle sets that join all near copies found."""
    near, members = common.staged(trie_groups(prints, bits), "copies-trie"), common.staged(band_groups(prints), "copies-bands")
    wanted = near.select("fp").union(members.select("fp")).distinct()
    ones = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).join(wanted, "fp", "left_semi")
    sets = _sets(docs, ones.select("one.doc_id", "one.text_hash", "fp"), words)
    compared = lambda rows: common.staged(_compared(_cells(rows, cell).join(sets, "fp"), least).distinct(), "copies-links")
    edges = compared(near)
    return edges.unionByName(compared(_open(members, edges)))


def near_copies(docs: DataFrame, words: int = WORDS, least: int = LEAST, cell: int = CELL, bits: int = BITS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), a row for each document, as simhash.near_duplicates has."""
    prints = common.staged(_prints(docs, words), "copies-prints")
    return simhash.grouped(prints.drop("sim", "bands"), links(docs, prints, words, least, cell, bits))


def survivors(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """docs with one document of each group of near copies: that of the smallest doc_id."""
    return simhash.one_each(docs, near_copies(docs, words, least))
