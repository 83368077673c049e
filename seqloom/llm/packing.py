"""Packing documents into sequences by minimum bin slack.

Each document is its token ids and an end id; only one that is longer than a sequence is
cut. What the packing needs to know of all pieces is how many there are of each length,
at most `capacity` numbers whatever the input. From that histogram the plan is made: per
bin, the longest remaining piece is taken, and a subset-sum dynamic program over the
remaining lengths, a bitset with one bit for each total, finds the fullest combination
that it can be completed to, which is then removed. A combination is removed as often as
the histogram has it, so the plan is a few lines for each length.

The plan says for each length which bins its 1st, 2nd, ... piece goes to. A piece's number
among those of its length is its number in its partition plus the sum of what earlier
partitions have, so no task sorts or holds all pieces of a common length.

Nulls: a null text is empty and gives a piece of the end id alone. Repeated rows are packed
each on its own. An empty table gives no pieces. A text of any length is encoded whole and cut into
as many pieces as it takes. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

CAPACITY, END_ID, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Words whose ids a worker keeps, and the letters of the longest; when there are more, only those in use stay.
KEPT_WORDS, KEPT_LETTERS = 600_000, 64
#: Bytes of texts whose ids are put in a row together, which take many times as much.
ROW_BYTES = 2 << 20
#: What may follow the letters of a word and is a match of the tokenizer of its own.
MARKS = '.,!?;:"()[]-'
#: Kinds of bytes: what Arrow splits at, letters (and all beyond ASCII), marks, digits, and what keeps its word whole.
BLANK, LETTER, MARK, DIGIT, ODD = range(5)


def _kind(c: int) -> int:
    x = chr(c)
    if c >= 128 or x.isalpha():
        return LETTER
    if x.isdigit():
        return DIGIT
    return BLANK if x in " \t\n\v\f\r" else MARK if x.isprintable() and x not in "'<" else ODD


KINDS = bytes(map(_kind, range(256)))
LOWERED = bytes(range(256)).lower()


class Words:
    """The ids of words, which the tokenizer finds out once for each word."""

    def __init__(self, path: str):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.known, self.letters, self.usual = Tokenizer.from_file(public_tokenizers.path(path)), {}, {}, set()
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        #: Letters of two bytes, by code point, and these with ASCII's.
        self.pairs = np.zeros(0x800, bool)
        for c in range(0x80, 0x800):
            self.pairs[c] = self.lettered(chr(c))
        self.usual = {chr(c) for c in range(0x800) if (self.pairs[c] or c < 0x80) and chr(c).isalpha()}

    def lettered(self, word: str) -> bool:
        """Whether all of a word stays letters for the tokenizer.

        It knows its own version of Unicode, and its lower case of a letter can have a mark (U+0130),
        which then belongs to the marks behind. So a character is tried between two letters.
        """
        if not word.isalpha():
            return False
        if word.isascii() or self.usual.issuperset(word):
            return True
        for c in set(word).difference(self.letters):
            self.letters[c] = int(self.ends[self.tok.encode(f"a{c}a", add_special_tokens=False).ids].sum()) == 1
        return all(map(self.letters.__getitem__, word))

    def learn(self, words: list[str]) -> None:
        """Adds words to those known.

        A word of letters alone is one match of the tokenizer, and its last token is the only
        one that ends a word; so many of them are encoded as one text and told apart by that.
        Marks behind the letters are a match too. All other words are encoded one by one.
        """
        known, plain, ended, other = self.known, {}, [], []
        for w in words:
            if w.isalpha() and w.isascii():
                plain[w] = None
                continue
            core = w.rstrip(MARKS)
            if not self.lettered(core):
                other.append(w)
            elif core == w:
                plain[w] = None
            else:
                m = w[len(core) :]
                ended.append((w, core, m))
                if core not in known:
                    plain[core] = None
                if m not in known:
                    other.append(m)
        keys = list(plain)
        for at in range(0, len(keys), 4000):
            part = keys[at : at + 4000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(part):  # some letter is none for the tokenizer
                other += part
                continue
            raw, start = ids.tobytes(), 0
            for w, stop in zip(part, stops.tolist(), strict=True):
                known[w] = raw[start:stop]
                start = stop
        other = list(dict.fromkeys(other))
        for w, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w, c, m in ended:
            known[w] = known[c] + known[m]

    def cut(self, data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The tokenizer's matches in UTF-8 texts, one behind the other, and which is the first of each text.

        starts: where each text begins, and the end of the last. A match is a run of letters or of marks, or
        a digit; ASCII is lower-cased. Words with other than ASCII and letters of two bytes, with
        controls, or with an apostrophe or `<` (endings, special tokens) stay whole and as they are.
        """
        kind = np.frombuffer(data.tobytes().translate(KINDS), np.uint8)
        kept, fresh = kind != BLANK, np.zeros(len(data) + 1, bool)
        fresh[starts] = True
        fresh = fresh[:-1]
        fresh[1:] |= ~kept[:-1]
        begins = kind == DIGIT
        begins[1:] |= kind[1:] != kind[:-1]
        begins |= fresh
        begins &= kept
        high = np.flatnonzero(data > 0x7F)
        lead = data[high].astype(np.int16)
        pair = (lead >= 0xC2) & (lead < 0xE0)
        pair[pair] = self.pairs[(lead[pair] & 31) << 6 | data[high[pair] + 1] & 63]
        pair[1:] |= pair[:-1]  # a letter's second byte follows its first
        odd, runs = np.concatenate((high[~pair], np.flatnonzero(kind == ODD))), np.flatnonzero(begins)
        first = fresh[runs]
        words = runs[first]
        whole = np.zeros(len(words), bool)
        whole[np.searchsorted(words, odd, "right") - 1] = True
        whole = whole[np.cumsum(first) - 1]
        joined = whole & ~first
        begins[runs[joined]] = False
        runs, whole = runs[~joined], whole[~joined]
        raw = data[kept]
        offsets = np.append(np.flatnonzero(begins[kept]), len(raw)).astype(np.int32)
        low = bytearray(raw.tobytes().translate(LOWERED))
        if len(odd):
            np.copyto(np.frombuffer(low, np.uint8), raw, where=np.repeat(whole, np.diff(offsets)))
        found = pa.StringArray.from_buffers(len(runs), pa.py_buffer(offsets), pa.py_buffer(low))
        return found, np.searchsorted(runs, starts)


def words_of(path: str) -> Words:
    """This process's words."""
    kept = sys.modules.setdefault(common.WORDS_MODULE, types.ModuleType(common.WORDS_MODULE)).__dict__
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def token_ids(texts: pa.Array, path: str = TOKENIZER) -> Iterator[np.ndarray]:
    """The ids of each text, equal to those of the tokenizer over the whole text.

    The tokenizer's matches never go over white space and it drops white space, so that the
    ids of a text are those of its words, and those of an ordinary word are those of its runs of letters
    and of marks and its digits (Words.cut). What came before need not be done again.
    It also lower-cases, behind composing characters with their marks, so ASCII is lower-cased first
    where no mark that composes and no special token can be.
    Runs are told apart and their ids put in a row for all texts together, by Arrow and numpy.
    """
    if not len(texts):
        return
    own = words_of(path)
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, places, data = texts.buffers()
    starts = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[starts[0] : starts[-1]]
    runs, begins = own.cut(data, starts - starts[0])
    found = runs.dictionary_encode()
    words, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    each = list(map(own.known.get, words))
    if len(own.known) > KEPT_WORDS:
        own.known = {w: ids for w, ids in zip(words, each, strict=True) if ids is not None}
    if new := [w for w, ids in zip(words, each, strict=True) if ids is None]:
        own.learn(new)
        each = [own.known[w] if ids is None else ids for w, ids in zip(words, each, strict=True)]
        for w in new:
            if len(w) > KEPT_LETTERS:
                del own.known[w]
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), "<u4")
    counts = sizes[at]
    ends = np.concatenate(([0], np.cumsum(counts)))
    first = (np.cumsum(sizes) - sizes)[at]
    where = np.repeat(first - ends[:-1], counts)
    where += np.arange(ends[-1])
    ids = flat.take(where)
    stops = ends[begins]
    for a, z in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        yield ids[a:z]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, nth), written to shared storage.

    part and nth: the partition and the piece's number, from 0, among its pieces of this length.
    """

    @partial(common.tidy, words=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in common.pieces_of(batches, 1, ROW_BYTES):
            rows, kept = [], []
            for doc, ids in zip(batch.column(0), token_ids(batch.column(1), path), strict=True):
                ids = np.append(ids, np.array([end_id], "<u4"))
                for n, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc.as_py(), n, start, len(own), zlib.crc32(own), part, seen[len(own)]))
                    seen[len(own)] += 1
                    if keep_ids:
                        kept.append(own.astype(np.int32))
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            if rows:
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids
    return common.staged(rows.mapInArrow(run, schema), "pieces")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each used at most as often as counts has it, with the largest sum up to room.

    Longer lengths come first, and the search ends as soon as a combination fills the room.
    """
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... pieces at once
            size = min(size, left)
            steps.append((reach, length, size))
            reach |= reach << length * size & full
            left -= size
            size *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for before, length, size in reversed(steps):
        if not before >> total & 1:
            total -= length * size
            used += [length] * size
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, bin, each, offset): pieces first .. last - 1 of the length go, `each`
    at a time, to the bins from `bin` on, there from `offset` on."""
    counts, taken, lines, bins = dict(histogram), Counter(), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        use = Counter([longest, *fullest(counts, capacity - longest)])
        counts[longest] += 1
        times, offset = min(counts[x] // n for x, n in use.items()), 0
        for x, n in sorted(use.items(), reverse=True):
            lines.append((x, taken[x], taken[x] + n * times, bins, n, offset))
            taken[x] += n * times
            offset += x * n
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        bins += times
    return sorted(lines)


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id and offset instead of part and nth."""
    spark = found.sparkSession
    each = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    lines = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    starts = lines[:, 0] << 48 | lines[:, 1]
    shared = spark.sparkContext.broadcast((starts, lines))  # its size follows the capacity, not the input

    @partial(common.tidy, words=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, lines = shared.value
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("earlier").to_numpy()
            line = lines[np.searchsorted(starts, length << 48 | nth, "right") - 1]
            bins, own = np.divmod(nth - line[:, 1], line[:, 4])
            out = batch.drop_columns(["part", "nth", "earlier"])
            out = out.append_column("sequence_id", pa.array(line[:, 3] + bins))
            yield out.append_column("offset", pa.array(line[:, 5] + own * length))

    joined = found.join(offsets, ["length", "part"])
    names = [c for c in found.columns if c not in ("part", "nth")]
    joined = joined.select(*names, "part", "nth", "earlier")
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"
    return joined.mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    return placed(pieces(docs, capacity, end_id, path, keep_ids), capacity)
