"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window of `window` words has window - gram + 1 grams of `gram` words; the least of
their hashes is the window's fingerprint. Two equal windows have equal fingerprints, so
joining the fingerprints of documents and items finds every shared span of at least
`window` words. Of a document, a fingerprint is kept once for each place that it is selected at:
windows that follow each other mostly select the same gram. Hits are extended: the windows behind a
selected gram are compared as strings, and those that are equal are merged into spans. An item of
fewer words is one window of its own length, found in the same pass with that length.

What is joined by fingerprint are places, without text or words: where the items' fingerprints
are measured to be few, they are broadcast and only hits leave the scan; else a row of four numbers
for each selected place is shuffled, in proportion to the words. Texts are read again for documents
with hits alone. A window that many items share stands for them by a number until the end.

Nulls: a null text has no words; an item with a null item_id is left out, since it can't
be named. Rows of one doc_id with different texts are told apart by the text's hash;
repeated rows each get a row of results. Texts without words have no windows. Empty tables of
documents give none, of items documents without hits. A text's length has no bound but that of a
string. Other columns play no part, whatever their names; clean() carries them along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

WINDOW, GRAM = 10, 6
#: What stands between words after lower-casing A-Z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _gram(length: int, window: int, gram: int) -> int:
    """Words of a gram in windows of this length."""
    return max(1, min(gram, length * gram // window if length < window else gram))


def _hashed(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows(text) as (keys, w, n, h): the words, their number and hashes."""
    rows = rows.select(*keys, words(F.col("text")).alias("w"))
    names = [c for c in rows.columns if c != "w"]
    return rows.select(*names, "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def _least(length: int, k: int, first: int = 0) -> list[Column]:
    """The hashes of the grams of the window at s, from its first-th on: turned hashes of their words, added bit by bit."""

    def turned(i: int, by: int) -> Column:
        # never null, and said not to be: it would else be tested again and again
        h = F.coalesce(F.get("h", F.col("s") + i), F.lit(0).cast("long"))
        return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h

    return [reduce(lambda a, b: a.bitwiseXOR(b), [turned(i + j, 11 * j % 64) for j in range(k)]) for i in range(first, length - k + 1)]


def _places(rows: DataFrame, keys: list[str], lengths: list[int], window: int, gram: int) -> DataFrame:
    """rows (keys, n, h) as (keys, s, len, fp): the first window with each selected gram, of all lengths in one pass."""
    starts = F.when(F.col("n") >= min(lengths), F.sequence(F.lit(0), F.col("n") - min(lengths))).otherwise(F.array().cast("array<int>"))
    at = rows.select(*keys, "n", "h", F.explode(starts).alias("s"))
    hashes = {length: _least(length, _gram(length, window, gram), -1) for length in lengths}
    # the grams are columns below a generator, which keeps them from being worked out again in each condition
    at = at.select(*keys, "n", "s", *[g.alias(f"g{length}_{i}") for length, own in hashes.items() for i, g in enumerate(own)])
    found = []
    for length, own in hashes.items():
        before, *grams = [F.col(f"g{length}_{i}") for i in range(len(own))]
        chosen = F.col("n") >= F.col("s") + length
        if len(grams) > 1:
            old = F.least(*grams[:-1]) if len(grams) > 2 else grams[0]
            # the window before has the same gram if that is older than the newest and not the one that went
            chosen = chosen & ((F.col("s") == 0) | (before <= old) | (grams[-1] < old))
        fp = F.struct(F.lit(length).alias("len"), (F.least(*grams) if len(grams) > 1 else grams[0]).alias("fp"))
        found.append(F.when(chosen, F.array(fp)).otherwise(F.array().cast("array<struct<len:int,fp:bigint>>")))
    places = found[0] if len(found) == 1 else F.concat(*found)
    return at.select(*keys, "s", F.explode(places).alias("f")).select(*keys, "s", "f.len", "f.fp")


def item_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(wid, len, span, fp, item_ids) of each different window of the items, numbered, written to shared storage."""
    rows = _hashed(items.filter("item_id IS NOT NULL"), "item_id").withColumn("len", F.least("n", F.lit(window)))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - F.col("len"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("item_id", "w", "h", "len", F.explode(starts).alias("s"))
    fp = None
    for length in range(1, window + 1):
        grams = _least(length, _gram(length, window, gram))
        own, here = F.least(*grams) if len(grams) > 1 else grams[0], F.col("len") == length
        fp = F.when(here, own) if fp is None else fp.when(here, own)
    found = rows.select("item_id", "len", F.array_join(F.slice("w", F.col("s") + 1, F.col("len")), " ").alias("span"), fp.alias("fp"))
    found = found.groupBy("len", "span", "fp").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    return common.staged(found.select(F.monotonically_increasing_id().alias("wid"), "*"), "item-windows")


def matches(docs: DataFrame, theirs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, s, len, wid): each window of a document, from word s, that is one of item_windows(). Written to shared storage."""
    keys = ["doc_id", "text_hash"]
    lengths = sorted(r["len"] for r in theirs.select("len").distinct().collect()) or [window]  # at most `window` numbers
    rows = _hashed(docs, "doc_id", F.xxhash64("text").alias("text_hash")).select(*keys, "n", "h")
    fps = common.small(theirs.select("len", "fp").distinct())
    near = _places(rows, keys, lengths, window, gram).join(fps, ["len", "fp"], "left_semi").select(*keys, "s", "len")
    near = common.staged(near.groupBy(*keys).agg(F.collect_set(F.struct("s", "len")).alias("places")), "windows")
    # the windows that may have selected the gram: up to the one that starts with it
    steps = F.element_at(F.create_map(*[F.lit(x) for n in lengths for x in (n, n - _gram(n, window, gram))]), F.col("p.len"))
    again = common.joined(docs.select("doc_id", "text"), near, F.size("places") * 16 + 32)
    again = again.select(*keys, words(F.col("text")).alias("w"), "places").select(*keys, "w", F.explode("places").alias("p"))
    again = again.select(*keys, "w", F.col("p.len").alias("len"), F.explode(F.sequence(F.col("p.s"), F.least(F.col("p.s") + steps, F.size("w") - F.col("p.len")))).alias("s"))
    spans = again.select(*keys, "s", "len", F.array_join(F.slice("w", F.col("s") + 1, F.col("len")), " ").alias("span"))
    known = common.small(theirs.select("len", "span", "wid"), F.octet_length("span") + 64)
    return common.staged(spans.join(known, ["len", "span"]).select(*keys, "s", "len", "wid").distinct(), "matches")


def _merged(found: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans, n_hit) of matches: their words as spans (s, e) without overlap, in order."""
    keys = ["doc_id", "text_hash"]
    rows = found.groupBy(*keys, "s").agg((F.col("s") + F.max("len")).alias("e"))
    before = W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(*keys).orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1))).cast("int"))
    rows = rows.withColumn("nth", F.sum("new").over(so_far)).groupBy(*keys, "nth").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"), F.sum(F.col("e") - F.col("s")).cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, n_hit, item_ids) of every document.

    spans: the merged hits as (s, e) word positions, e exclusive; item_ids: the items that
    have a window in the document, ascending.
    """
    keys, theirs = ["doc_id", "text_hash"], item_windows(items, window, gram)
    found = matches(docs, theirs, window, gram)
    named = found.select(*keys, "wid").distinct().join(theirs.select("wid", "item_ids"), "wid").groupBy(*keys)
    named = named.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    hits = _merged(found).withColumnsRenamed({"doc_id": "__sl_d", "text_hash": "__sl_h"})
    hits = hits.join(named, F.col("__sl_d").eqNullSafe(named["doc_id"]) & (F.col("__sl_h") == named["text_hash"])).select("__sl_d", "__sl_h", "spans", "n_hit", "item_ids")
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = all_docs.join(hits, all_docs["doc_id"].eqNullSafe(F.col("__sl_d")) & (all_docs["text_hash"] == F.col("__sl_h")), "left")
    return out.select(*keys, "n_words", "spans", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), "item_ids")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without those that share a window with an item."""
    found = matches(docs, item_windows(items, window, gram), window, gram)
    return common.without(docs, found.select("doc_id", "text_hash").distinct())
