"""SimHash near-duplicate groups: fingerprints, a binary-trie self-join, components.

The self-join finds all pairs of different fingerprints at a Hamming distance of at
most `bits`. It is dealt out by the pigeonhole principle: of bits + 1 disjoint blocks of
a fingerprint at least one is equal in both of a pair, so all pairs meet in some group
of equal (block, value). A group with more than `group_rows` fingerprints is dealt out
again by blocks of its remaining bits, so that no task ever holds a large group and none
is dropped or sampled. Inside a group the pair search walks two nodes of the group's
binary trie at a time, adds up differing bits and prunes a node pair when the error
budget is exceeded. A group reports a spanning forest of its links, not all of them.

Nulls: a null text counts as empty; a null doc_id stays null and never names a component
unless all of its documents have none. Repeated rows stay, each with its own result row. Empty
tables give empty ones. Texts of any length are read whole. Other columns play no part, whatever
their names; survivors() carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, BITS = 3, 3
#: Fingerprints of a group that one task compares; larger groups are split by further bits.
GROUP_ROWS = 512
#: Groups are compared together as long as they have at most about so many pairs.
PAIRS_AT_ONCE = 400_000
MASK64 = (1 << 64) - 1


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    import xxhash

    if not text:
        return 0
    tokens = text.encode().lower().split()
    n = len(tokens)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n <= words:
        hashes = digest(b" ".join(tokens), 42)
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: n - words + 1]
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)])
    return folded(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def folded(octets: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, rows of eight octets with the highest first."""
    # a histogram of each of the eight octets gives the count of each bit
    spread = np.bincount((octets + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return int.from_bytes(np.packbits((spread @ bits * 2 > len(octets)).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; fp is the fingerprint as a signed long."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits that mask lacks, in so many blocks, each as a mask."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[int], bits: int) -> DataFrame:
    """rows (mask, fp) with each row once for each block of the bits that its mask leaves."""
    below = [(_signed(m), [_signed(m | b) for b in _blocks(m, bits + 1) if b]) for m in masks]
    if len(below) == 1:
        out = rows.select(F.explode(F.array(*[F.lit(m).cast("long") for m in below[0][1]])).alias("mask"), "fp")
        return out.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("at"), "fp")
    more = rows.sparkSession.createDataFrame(below, "mask long, below array<long>")
    out = rows.join(more, "mask").select(F.explode("below").alias("mask"), "fp")
    return out.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("at"), "fp")


def links(nodes: DataFrame, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u > v) between different fingerprints of nodes(fp) that join all that link.

    Every pair at a distance of at most `bits` ends up in one component of the edges.
    """
    rows, masks = nodes.select(F.lit(0).cast("long").alias("mask"), "fp"), [0]
    found: DataFrame | None = None
    while masks:
        dealt = _dealt(rows, masks, bits)
        if len(masks) > 1:  # two groups' blocks can add up to the same bits
            dealt = dealt.distinct()
        sizes = dealt.groupBy("mask", "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = common.staged(dealt.join(sizes, ["mask", "at"]), "simhash-groups")
        part = _joined(sized.filter(F.col("n") <= group_rows), bits)
        found = part if found is None else found.unionByName(part)
        rows = sized.filter(F.col("n") > group_rows).select("mask", "fp").distinct()
        masks = [r["mask"] & MASK64 for r in rows.select("mask").distinct().collect()]  # a few bit patterns, not rows
    return found.distinct()


def _joined(groups: DataFrame, bits: int) -> DataFrame:
    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = np.stack([batch.column(i).to_numpy() for i in range(3)])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            if not now.shape[1]:
                continue
            new = np.flatnonzero(np.any(now[:2, 1:] != now[:2, :-1], axis=0)) + 1
            last = int(new[-1]) if len(new) else 0
            rest = now[:, last:]  # the last group may go on in the next batch
            if last:
                yield from out(now[:, :last])
        if rest is not None and rest.shape[1]:
            yield from out(rest)

    def out(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, v = trie_forest(part, bits)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = groups.select("mask", "at", "fp").repartition("mask", "at").sortWithinPartitions("mask", "at", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def trie_forest(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (u > v) that span the links in each group of rows (mask, at, fp), sorted so."""
    fps = rows[2].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.any(rows[:2, 1:] != rows[:2, :-1], axis=0))))
    last = np.append(first[1:], len(fps))
    us, vs = [], []
    cost = np.cumsum((last - first) ** 2)
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(cost // PAIRS_AT_ONCE)) + 1):
        a, b = int(first[part[0]]), int(last[part[-1]])
        i, j = trie_pairs(fps[a:b], first[part] - a, last[part] - a, bits)
        root = spanned(i, j, b - a)
        at = np.flatnonzero(root != np.arange(b - a))
        x, y = fps[a:b][at], fps[a:b][root[at]]
        us.append(np.maximum(x, y)[x != y])
        vs.append(np.minimum(x, y)[x != y])
    return np.concatenate(us), np.concatenate(vs)


def trie_pairs(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs at most `bits` apart inside each interval [lo, hi) of sorted fps.

    A trie node is an interval of equal leading bits. Node pairs go down together, bit by
    bit; those whose difference so far exceeds the budget are pruned, and two leaves are
    compared at once in what bits they have left.
    """
    raw = fps.view(np.uint64)
    key = np.lexsort((raw, np.repeat(np.arange(len(lo)), hi - lo)))  # unsigned order inside each interval
    raw = raw[key]
    al, ah = lo.astype(np.int32), hi.astype(np.int32)
    bl, bh, d = al, ah, np.zeros(len(lo), np.int8)
    got_i, got_j = [], []
    for bit in range(63, -1, -1):
        if not len(al):
            break
        ones = np.concatenate(([0], np.cumsum((raw >> np.uint64(bit) & np.uint64(1)).astype(np.int32), dtype=np.int32))).astype(np.int32)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        # zero-zero, one-one, zero-one, and one-zero of pairs of different nodes
        nal = np.concatenate([al, am, al, am[~same]])
        nah = np.concatenate([am, ah, am, ah[~same]])
        nbl = np.concatenate([bl, bm, bm, bl[~same]])
        nbh = np.concatenate([bm, bh, bh, bm[~same]])
        nd = np.concatenate([d, d, d + 1, d[~same] + 1])
        keep = (nah > nal) & (nbh > nbl) & (nd <= bits) & ~((nal == nbl) & (nah - nal == 1))
        al, ah, bl, bh, d = nal[keep], nah[keep], nbl[keep], nbh[keep], nd[keep]
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = np.bitwise_count(raw[i] ^ raw[j]) <= bits
            got_i.append(i[near])
            got_j.append(j[near])
            al, ah, bl, bh, d = al[~leaf], ah[~leaf], bl[~leaf], bh[~leaf], d[~leaf]
    apart = al != bl  # what is left are nodes of equal fingerprints
    got_i.append(al[apart])
    got_j.append(bl[apart])
    return key[np.concatenate(got_i)], key[np.concatenate(got_j)]


def spanned(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least position in each position's component under the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node but the roots; root is the least node of its component.

    Alternates large and small stars, each of them an aggregate with map-side combine and
    a join whose large partitions adaptive execution can split. Each round is checkpointed.
    """
    now = common.checkpointed(edges.select("u", "v").distinct())
    sign = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = sign(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), a row for each document.

    Texts whose fingerprints differ in at most `bits` bits link; component_id is the
    smallest doc_id that links reach, root the least fingerprint (as a signed long).
    """
    prints = common.staged(fingerprints(docs, words), "simhash-fingerprints")
    return grouped(prints, links(prints.select("fp").distinct(), bits, group_rows))


def grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """prints (doc_id, text_hash, fp) with the root and component_id that edges (u, v) between fps give."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(edges).withColumnRenamed("u", "fp")
    placed = nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_doc")
    named = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    lookup = placed.select("fp", "root").join(named, "root")
    return prints.join(lookup, "fp", "left").select("doc_id", "text_hash", "fp", "root", "component_id")


def survivors(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """docs with one document of each near-duplicate group: that of the smallest doc_id."""
    return one_each(docs, near_duplicates(docs, words, bits))


def one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of found: one with its smallest doc_id.

    Of different texts with that doc_id the one with the smallest hash stays, of rows that repeat both
    the one with the smallest hash of all its columns. What goes is told by its keys, which are
    broadcast if they are measured to be few; only else whole texts are shuffled.
    """
    found = common.staged(found, "simhash-components")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    lost = found.filter(~first).select("doc_id", "text_hash")
    named = found.filter(first)
    several = named.groupBy("component_id", "root").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).filter("least != most").select("root", "least")
    lost = lost.unionByName(named.join(several, "root").filter("text_hash != least").select("doc_id", "text_hash"))
    again = named.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "text_hash")
    again = common.staged(again, "simhash-repeated")
    out = common.without(docs, lost)
    if again.isEmpty():
        return out
    # whole rows are compared by a hash; equal hashes are equal rows
    rows = common.held(out, again)
    least = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*docs.columns))
    single = rows.groupBy("doc_id", F.xxhash64("text").alias("__sl_hash")).agg(least.alias("__sl_row")).select("__sl_row.*")
    return common.without(out, again).unionByName(single)
