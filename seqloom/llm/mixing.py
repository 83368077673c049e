"""Mixing sources to target weights by fitting a subset sum.

A source's target is its share of all words by weight, at most CAP times its own words; what that leaves is
shared again by weight. Each document of a source is repeated as often as the whole source fits its target, and
the remaining budget is met by some documents once more. Documents of a source that have equally many words
are alike to the budget, so that all that fitting needs is how many there are of each length.

The plan of a source walks its lengths from the longest on and gives each its share of the budget as far as whole
documents go, handing the remainder on, so that the lengths are mixed as in the source. A reserve is kept back from this, and a
bounded-knapsack dynamic program, a bitset with a bit for each total, fits it with documents of what is left; the reserve
grows until it is fitted exactly or is at its bound. Which of the documents of a length are taken follows from a seeded hash of
doc_id and text: they are numbered in its order by ranges over all tasks, however many are alike.

Nulls: a null text has no words; null sources are a source of their own, the last; a null doc_id is one like any other.
Repeated rows are documents of their own; which of equal rows is taken makes no difference. Documents without words are taken with 0 words.
Empty tables give none. Texts of any length are counted whole. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import sequences

from . import common

WEIGHTS, SHARE, CAP, SEED = (1, 2, 3), 1.0, 3, 13
#: Words that the dynamic program has to fit, at most, but for what a document is longer. Of that it is given an eighth of the
#: budget, then a half, then all, until it fits.
RESERVE, PARTS = 1 << 16, (8, 2, 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, draw): the words of each text, told apart by ASCII white space, and a seeded hash."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for text in batch.column(3):
                space = _SPACE[np.frombuffer(text.as_buffer(), np.uint8)] if text.is_valid else np.empty(0, bool)
                sizes.append(int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], ["doc_id", "source", "draw", "size"])

    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("draw"), "text")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "source")}
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, source {kinds['source']}, draw long, size long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources(source, words) with sid and target.

    Weights go round in the order of sources' code points, null last. Only sums over sources come to the driver.
    """
    placed = sequences.numbered(sources, [F.col("source").asc_nulls_last()], "sid")
    placed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    placed = common.staged(placed, "mixing-sources")
    total = (placed.agg(F.sum("words").alias("n")).first()["n"] or 0) * share
    over, known = F.lit(False), -1
    while True:  # sources above their cap stay so: what they leave makes the others' targets larger
        got = placed.select("*", over.alias("over")).agg(F.sum(F.when(F.col("over"), F.col("words") * cap)).alias("given"), F.sum(F.when(~F.col("over"), F.col("weight"))).alias("w"), F.count(F.when(F.col("over"), 1)).alias("n")).first()
        rest = total - (got["given"] or 0)
        own = F.col("weight") * F.lit(float(rest)) / F.lit(float(got["w"] or 1))
        if got["n"] == known:
            return placed.withColumn("target", F.when(over, (F.col("words") * cap).cast("double")).otherwise(own)).drop("weight")
        known, over = got["n"], over | (own > F.col("words") * cap)


def fitted(counts: dict[int, int], budget: float, seed: int = SEED, reserve: int = RESERVE) -> dict[int, int]:
    """Of how many documents of each length to take so that their words come as near to the budget as they can."""
    counts = {x: n for x, n in counts.items() if x > 0 and n > 0}
    words = sum(x * n for x, n in counts.items())
    goal = int(round(budget))
    if goal >= words or not words:
        return counts
    best, apart = {}, goal + 1
    for own in dict.fromkeys(min(reserve, goal // x) for x in PARTS):
        part, taken, given, carry = (goal - own) / words, {}, 0, 0.0
        for x in sorted(counts, reverse=True):
            carry += counts[x] * x * part
            taken[x] = min(counts[x], int(carry // x))
            carry -= taken[x] * x
            given += taken[x] * x
        left = {x: n - taken[x] for x, n in counts.items() if n > taken[x]}
        for x, n in knapsack(left, goal - given, seed).items():
            taken[x] += n
        off = abs(goal - sum(x * n for x, n in taken.items()))
        if off < apart:
            best, apart = taken, off
        if not off:
            break
    return best


def knapsack(counts: dict[int, int], room: int, seed: int = SEED) -> dict[int, int]:
    """Lengths, each used at most as often as counts has it, whose sum is nearest to room; of two that are equally near the smaller.

    Lengths come in a seeded order, and the search ends as soon as a combination meets the room.
    """
    most = 2 * room  # a sum beyond is farther away than none at all
    full, reach = (1 << most + 1) - 1, 1
    first, steps = np.full(most + 1, -1, np.int32), []  # the step at which a sum is first reached
    for x in sorted((x for x in counts if x <= most), key=lambda x: (zlib.crc32(f"{seed}:{x}".encode()), x)):
        if reach >> room & 1:
            break
        left, size = min(counts[x], most // x), 1
        while left:  # 1, 2, 4, ... documents at once
            size = min(size, left)
            new = reach << x * size & full & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(raw)
                at = np.unpackbits(raw[some], bitorder="little").reshape(-1, 8)
                rows, bits = np.nonzero(at)
                first[some[rows] * 8 + bits] = len(steps)
                reach |= new
            steps.append((x, size))
            left -= size
            size *= 2
    below = (reach & (1 << room + 1) - 1).bit_length() - 1
    above = reach >> room
    above = room + (above & -above).bit_length() - 1 if above else most + 1
    total, used = below if room - below <= above - room else above, {}
    while total:
        x, size = steps[first[total]]
        used[x] = used.get(x, 0) + size
        total -= x * size
    return used


def planned(histogram: DataFrame, sources: DataFrame, seed: int = SEED, reserve: int = RESERVE) -> DataFrame:
    """(source, size, n, sid, words, target, repeats, extra): histogram(source, size, n) and of how many of the n documents there is one repeat more."""
    same = histogram["source"].eqNullSafe(F.col("_s"))
    rows = histogram.join(sources.withColumnRenamed("source", "_s"), same).drop("_s")
    kind = histogram.schema["source"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        target, words = float(frame["target"].iloc[0]), int(frame["words"].iloc[0])
        repeats = int(target // words) if words else 0
        taken = fitted(dict(zip(frame["size"].tolist(), frame["n"].tolist(), strict=True)), target - repeats * words, seed + int(frame["sid"].iloc[0]), reserve)
        return frame.assign(repeats=repeats, extra=[taken.get(x, 0) for x in frame["size"].tolist()])

    schema = f"source {kind}, size long, n long, sid long, words long, target double, repeats long, extra long"
    # a source's group has a row for each different length of its documents
    return rows.select("source", "size", "n", "sid", "words", "target").groupBy("sid").applyInPandas(run, schema)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, reserve: int = RESERVE) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken), a row for each document: how often the mix has it, and its words in all."""
    rows = common.staged(sized(docs, seed), "mixing-sizes")
    histogram = common.staged(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-lengths")
    sources = common.staged(targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), weights, share, cap), "mixing-targets")
    plan = common.staged(planned(histogram, sources, seed, reserve), "mixing-plan")
    lines = common.small(plan.withColumnsRenamed({"source": "_source", "size": "_size"}), F.lit(80) + F.coalesce(F.octet_length(F.col("_source").cast("string")), F.lit(0)))
    found = rows.join(lines, rows["source"].eqNullSafe(F.col("_source")) & (rows["size"] == F.col("_size")))
    names = ("doc_id", "source", "size", F.col("words").alias("source_size"), "target")
    given = lambda more: (*names, (F.col("repeats") + more).alias("repeats"))
    whole = found.filter((F.col("extra") == 0) | (F.col("extra") == F.col("n"))).select(*given(F.when(F.col("extra") > 0, 1).otherwise(0)))
    some = found.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    some = sequences.numbered(some.select(*names, "repeats", "sid", "extra", "draw"), [F.col("sid"), F.col("size"), F.col("draw")], "nth")
    starts = some.groupBy("sid", "size").agg(F.min("nth").alias("start"))
    starts = common.small(common.staged(starts, "mixing-starts"), F.lit(32))
    some = some.join(starts, ["sid", "size"]).select(*[F.col(c) if isinstance(c, str) else F.col("source_size") for c in names], (F.col("repeats") + F.when(F.col("nth") - F.col("start") < F.col("extra"), 1).otherwise(0)).alias("repeats"))
    return whole.unionByName(some).withColumn("taken", F.col("repeats") * F.col("size"))
