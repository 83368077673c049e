"""Fill-in-the-middle texts: a parallel automaton scan finds units, markers and cuts.

The automaton reads bytes. Its state says whether a unit (a line with its line end) begins here, how much
of a marker has been read, and whether one has been read whole. What a chunk of text does is a function from entry
states to end states, with the number of units that begin in it for each entry state. Functions of chunks that
follow one another compose, and composing is associative: inside a chunk the functions of its symbols are
composed in pairs, and of a giant text, which is dealt out in chunks to all tasks, those of its chunks. That
resolves each chunk's entry state; the counts then say which chunk holds a cut and which of its units
it is, and only that chunk is read again. Texts of at most `chunk` bytes are one chunk and stay in place.

A text's cuts are after k units, k drawn by a keyed hash of its doc_id. A giant text has at most
2 GiB / chunk summaries of a few numbers, which meet in one task.

Nulls: a null text is empty; a null doc_id is drawn like an empty one. An empty text and one that contains a
marker stay plain. Repeated rows are done each on its own and are equal. Empty tables give none. Texts of any length are read
whole. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MARKERS, SEED = ("<P>", "<S>", "<M>"), 7
#: Percent of the texts that are transformed, and percent of those whose suffix comes first.
RATE, SUFFIX_FIRST = 100, 50
#: Bytes of a text above which it is dealt out in chunks of so many.
CHUNK = 1 << 16


class Automaton:
    """States: 0 a unit begins, 1 + k inside a unit with k the node of the markers' trie; the last two are 0 and 1 after a marker."""

    def __init__(self, markers: tuple[str, ...] = MARKERS):
        words = [m.encode() for m in markers]
        nodes = sorted({w[:i] for w in words for i in range(len(w))}, key=len)  # beginnings of markers, the empty one first
        at = {x: i for i, x in enumerate(nodes)}
        used = sorted({c for w in words for c in w} | {10})
        self.classes = np.zeros(256, np.uint8)  # 0: any other byte
        self.classes[used] = np.arange(1, len(used) + 1)
        n = len(nodes)
        self.states, self.found = n + 3, n + 1
        self.ends = np.empty((len(used) + 1, self.states), np.uint8)
        self.begins = np.zeros(self.states, np.int64)
        self.begins[[0, self.found]] = 1  # a letter read in these states begins a unit
        for k, c in enumerate([None, *used]):
            for state in range(self.states):
                self.ends[k, state] = self._step(words, nodes, at, c, state)

    def _step(self, words: list[bytes], nodes: list[bytes], at: dict[bytes, int], c: int | None, state: int) -> int:
        if state >= self.found:
            return self.found + (c != 10)
        read = (nodes[state - 1] if state else b"") + bytes([c]) if c is not None else b""
        if any(read.endswith(w) for w in words):
            return self.found + (c != 10)
        if c == 10:
            return 0
        return 1 + at[next(read[i:] for i in range(len(read) + 1) if read[i:] in at)]

    def function(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, units) by entry state, of a chunk's bytes."""
        kinds = self.classes[raw]
        other = kinds == 0
        keep = ~other
        keep[1:] |= other[1:] & ~other[:-1]  # of other bytes in a row the first does what all do
        keep[:1] = True
        kinds = kinds[keep]
        ends, units = self.ends[kinds], np.repeat(self.begins[None], len(kinds), 0)
        while len(ends) > 1:
            last = (ends[-1:], units[-1:]) if len(ends) % 2 else None
            even = len(ends) // 2 * 2
            ends, units = composed((ends[:even:2], units[:even:2]), (ends[1:even:2], units[1:even:2]))
            if last:
                ends, units = np.concatenate([ends, last[0]]), np.concatenate([units, last[1]])
        return (ends[0], units[0]) if len(ends) else (np.arange(self.states, dtype=np.uint8), np.zeros(self.states, np.int64))

    def unit(self, raw: np.ndarray, state: int, k: int) -> int:
        """Where in a chunk that is entered in this state its k-th unit begins, from 0."""
        starts = np.flatnonzero(raw[:-1] == 10) + 1
        if self.begins[state]:
            return 0 if k == 0 else int(starts[k - 1])
        return int(starts[k])


def composed(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First f, then g, for many of them at once."""
    via = f[0].astype(np.intp)
    return np.take_along_axis(g[0], via, 1), f[1] + np.take_along_axis(g[1], via, 1)


def resolved(ends: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of chunks in a row, what all up to each of them do together: (ends, units) entered in state 0, by doubling steps."""
    f, step = (ends, units), 1
    while step < len(ends):
        e, u = composed((f[0][:-step], f[1][:-step]), (f[0][step:], f[1][step:]))
        f, step = (np.concatenate([f[0][:step], e]), np.concatenate([f[1][:step], u])), step * 2
    return f[0][:, 0].astype(np.int64), f[1][:, 0]


def letters(raw: np.ndarray) -> int:
    """Code points of which this is the beginning, or a part."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def drawn(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits that follow from a doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _short(docs: DataFrame, markers: tuple[str, ...]) -> DataFrame:
    """docs(doc_id, text, d0, d1) with n, marked, and the code points before the middle and the suffix."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n long, marked boolean, a long, b long"

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(markers)
        for batch in common.pieces_of(batches, 1):
            found = []
            for text, x, y in zip(batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                ends, units = machine.function(raw)
                n = int(units[0])
                cuts = sorted((x % (n + 1), y % (n + 1)))
                where = [letters(raw if k == n else raw[: machine.unit(raw, 0, k)]) for k in cuts]
                found.append((n, bool(ends[0] >= machine.found), *where))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            rest = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], ["doc_id", "text", "n", "marked", "a", "b"])

    return docs.select("doc_id", "text", "d0", "d1").mapInArrow(run, schema)


def _giant(docs: DataFrame, markers: tuple[str, ...], chunk: int) -> DataFrame:
    """As _short(), of texts that are dealt out in chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    piece = lambda at: F.substring(F.col("text").cast("binary"), (at * chunk + 1).cast("int"), F.lit(chunk))
    parts = own.select("doc_id", "text_hash", "d0", "d1", "text", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int"))).alias("chunk"))
    parts = parts.select("doc_id", "text_hash", "d0", "d1", "chunk", piece(F.col("chunk")).alias("raw")).repartition("doc_id", "text_hash", "chunk")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(markers)
        for batch in batches:
            raws = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(5)]
            done = [machine.function(x) for x in raws]
            arrays = [pa.array([x.astype(np.int64) for x, _ in done], pa.list_(pa.int64())), pa.array([x for _, x in done], pa.list_(pa.int64())), pa.array([letters(x) for x in raws], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *arrays], ["doc_id", "text_hash", "d0", "d1", "chunk", "ends", "units", "letters"])

    each = parts.mapInArrow(scan, f"doc_id {kind}, text_hash long, d0 long, d1 long, chunk int, ends array<long>, units array<long>, letters long")
    each = each.dropDuplicates(["doc_id", "text_hash", "chunk"])  # repeated rows
    rows = each.groupBy("doc_id", "text_hash", "d0", "d1").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends", "units", "letters"))).alias("p"))
    rows = rows.select("doc_id", "text_hash", "d0", "d1", *[F.col(f"p.{x}").alias(x) for x in ("ends", "units", "letters")])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Automaton(markers).found
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ends, units = resolved(np.array(r["ends"], np.uint8), np.array(r["units"], np.int64))
                before = np.concatenate(([0], np.cumsum(r["letters"])))
                n = int(units[-1])
                for side, k in enumerate(sorted((r["d0"] % (n + 1), r["d1"] % (n + 1)))):
                    at = int(np.searchsorted(units, k, "right"))  # the first chunk by whose end more than k units have begun
                    inside = at < len(units)
                    row = (at, int(ends[at - 1]) if at else 0, k - (int(units[at - 1]) if at else 0)) if inside else (None, None, None)
                    out.append((r["doc_id"], r["text_hash"], n, bool(ends[-1] >= found), side, *row, int(before[at])))
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "text_hash", "n", "marked", "side", "chunk", "state", "k", "before"])

    cuts = rows.mapInArrow(select, f"doc_id {kind}, text_hash long, n long, marked boolean, side int, chunk int, state int, k long, before long")
    cuts = common.staged(cuts, "infill-cuts")
    wanted = common.joined(own.select("doc_id", "text"), cuts.filter("chunk IS NOT NULL"), F.lit(64))
    wanted = wanted.select("doc_id", "text_hash", "n", "marked", "side", "before", "state", "k", piece(F.col("chunk")).alias("raw"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(markers)
        for batch in batches:
            at = []
            for raw, before, state, k in zip(batch.column(8), *(batch.column(i).to_pylist() for i in (5, 6, 7)), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint8)
                at.append(before + letters(own[: machine.unit(own, state, k)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at, pa.int64())], ["doc_id", "text_hash", "n", "marked", "side", "at"])

    found = wanted.mapInArrow(place, f"doc_id {kind}, text_hash long, n long, marked boolean, side int, at long")
    found = found.unionByName(cuts.filter("chunk IS NULL").select("doc_id", "text_hash", "n", "marked", "side", F.col("before").alias("at")))
    both = found.groupBy("doc_id", "text_hash", "n", "marked").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return common.joined(own.select("doc_id", "text"), common.staged(both, "infill-places"), F.lit(64)).select("doc_id", "text", "n", "marked", "a", "b")


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, ...] = MARKERS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output), a row for each document.

    form: plain (the text as it is), psm (prefix, suffix, middle) or spm; markers stand before prefix, suffix and middle.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    draws = drawn(F.col("doc_id"), seed)
    rows = rows.select("doc_id", "text", draws[0].alias("d0"), draws[1].alias("d1"))
    long = F.octet_length("text") > chunk
    found = _short(rows.filter(~long), markers).unionByName(_giant(rows.filter(long), markers, chunk))
    plain = (F.col("text") == "") | F.col("marked") | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < suffix_first, "spm").otherwise("psm")
    found = found.select("doc_id", "text", "n", form.alias("form"), "a", "b")
    fim = F.col("form") != "plain"
    found = found.select("doc_id", "text", "n", "form", F.when(fim, F.col("a")).alias("prefix_chars"), F.when(fim, F.col("b") - F.col("a")).alias("middle_chars"))
    a, m = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    text = F.col("text")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, m), F.substring(text, a + m + 1, F.length(text))
    p, s, e = (F.lit(x) for x in markers)
    out = F.when(~fim, text).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, e, middle)).otherwise(F.concat(s, suffix, p, prefix, e, middle))
    return found.withColumn("output", out)


def restored(output: Column, form: Column, markers: tuple[str, ...] = MARKERS) -> Column:
    """The text from which an output of this form was made: its parts stand between the first markers of each kind."""
    p, s, e = markers
    part = lambda before, after: F.substring_index(F.substring(output, F.locate(before, output) + len(before), F.length(output)), after, 1)
    last = F.substring(output, F.locate(e, output) + len(e), F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(p, s), last, part(s, e))).otherwise(F.concat(part(p, e), last, part(s, p)))
