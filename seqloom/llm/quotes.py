"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of its leading `>` marks, up to 1,000. Consecutive lines of one
level are a passage. A passage is asked for as a whole, by paragraph and by line; what a message
says itself, at level 0, is offered as a whole and by passage, paragraph and line, so that quotes
of a part and of a reply between quotes are found. Each is normalised (marks off, lower case,
white space as one blank) and hashed, and asked for among the messages that say it: the latest
earlier one in the conversation, else the first one anywhere. A message's parent is the source, in its
conversation, of its first passage at the lowest level that has one: that of the whole passage, else of
its longest paragraph, else of its longest line that has one. A thread is a message and all that answer
it, directly or not; in it a message's place is its rank in reply order: each answer behind what it
answers and the answers to that by earlier turns.

Joins go by (conversation, hash) over what is quoted somewhere, and "the latest
earlier" is found in blocks of turns, whose last values are carried over, so that a
conversation or passage with a large share of all rows is not in one task. Sources in other
conversations are one row for each hash. Threads follow parents by pointer doubling, places
the tour of a thread's messages.

DataFrame functions only; texts of any length are parsed in time in proportion to it. Nulls: a null text
has no passages and stays null; a message without conv_id or turn keeps its text without quotes,
and links to nothing. Messages of one conversation with the same turn count as one source; each
gets its own row of results, as repeated rows do. Empty tables stay empty; of other columns none is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Turns that are searched together for the latest earlier message.
BLOCK = 1024
_MARK = r"^[ \t]{0,3}(?:>[ \t]?){1,1000}"
#: What counts as white space.
SPACE = " \t\n\x0b\f\r"


def lines(text: Column) -> Column:
    """The lines of a text as (level, line) structs, marks taken off."""
    mark = lambda x: F.regexp_extract(x, _MARK, 0)
    each = lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.when(mark(x) == "", x).otherwise(x.substr(F.length(mark(x)) + 1, F.length(x))).alias("line"))
    return F.transform(F.split(text, r"\r?\n"), each)


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def passages(text: Column) -> Column:
    """Consecutive lines of one level as (level, lines) structs, in order."""

    def cut(parsed: Column) -> Column:
        level = lambda i: F.get(parsed, i)["level"]
        starts = F.filter(F.sequence(F.lit(0), F.size(parsed) - 1), lambda i: (i == 0) | (level(i) != level(F.greatest(i - 1, F.lit(0)))))
        run = lambda own, i, j: F.slice(parsed, i + 1, F.coalesce(F.get(own, j + 1), F.size(parsed)) - i)["line"]
        return _let(starts, lambda own: F.transform(own, lambda i, j: F.struct(level(i).alias("level"), run(own, i, j).alias("lines"))))

    return _let(lines(text), cut)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s>]+", " "))


def _hash(text: Column) -> Column:
    """128 bits of a normalised passage; null for an empty one."""
    return F.when(text != "", F.substring(F.sha2(text, 256), 1, 32))


def unquoted(text: Column) -> Column:
    """A text without its quoted lines and the blank lines around it."""
    own = F.array_join(F.transform(F.filter(lines(text), lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    return F.when(F.instr(text, ">") == 0, text).otherwise(F.rtrim(F.regexp_replace(own, r"^\s*\n", ""), F.lit(SPACE)))


def _parts(own: Column) -> Column:
    """A passage's lines as (kind, size, hash): the whole (kind 0), paragraphs (1) and lines (2). Those without a word have a null hash."""

    def unit(kind: int):
        return lambda x: _let(normal(x), lambda y: F.struct(F.lit(kind).alias("kind"), (-F.length(y)).alias("size"), _hash(y).alias("hash")))

    whole = F.array_join(own, "\n")
    each = _let(whole, lambda t: F.concat(F.array(unit(0)(t)), F.transform(F.split(t, r"\n\s*\n"), unit(1))))
    return F.concat(each, F.when(F.size(own) > 1, F.transform(own, unit(2))).otherwise(F.array().cast("array<struct<kind:int,size:int,hash:string>>")))


def quoted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, level, kind, size, hash) of each quoted passage and its parts; size is below zero."""
    has = rows.filter(F.col("text").rlike(r"(?m)" + _MARK))
    each = has.select("conv_id", "turn", F.posexplode(passages(F.col("text"))).alias("nth", "p")).filter("p.level > 0")
    each = each.select("conv_id", "turn", "nth", "p.level", F.explode(_parts(F.col("p.lines"))).alias("u"))
    return each.select("conv_id", "turn", "nth", "level", "u.kind", "u.size", "u.hash").filter("hash IS NOT NULL")


def said(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, hash) of what messages say themselves: as a whole, by passage, paragraph and line."""
    rows = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    whole = rows.select("conv_id", "turn", F.array(unquoted(F.col("text"))).alias("own"))
    runs = F.when(F.instr("text", ">") == 0, F.array(F.split("text", r"\r?\n"))).otherwise(F.filter(passages(F.col("text")), lambda p: p["level"] == 0)["lines"])
    each = whole.unionByName(rows.select("conv_id", "turn", F.explode(runs).alias("own")))
    found = each.select("conv_id", "turn", F.explode(_parts(F.col("own"))["hash"]).alias("hash"))
    return found.filter("hash IS NOT NULL").distinct()


def latest_before(asks: DataFrame, offers: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """asks with source: the greatest turn of offers below the ask's, among rows of equal keys."""
    own = lambda df: df.withColumn("_b", F.floor(F.col("turn") / block))
    asked = own(asks.select(*keys, "turn").distinct()).withColumn("_offer", F.lit(None).cast("long"))
    given = own(offers.select(*keys, "turn").distinct()).withColumn("_offer", F.col("turn").cast("long"))
    tops = given.groupBy(*keys, "_b").agg(F.max("_offer").alias("_top"))
    # the last value of earlier blocks, over blocks that ask or offer: one row each
    marks = asked.select(*keys, "_b").distinct().join(tops, [*keys, "_b"], "full")
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", F.max("_top").over(earlier).alias("_carried"))
    inside = W.partitionBy(*keys, "_b").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    here = asked.unionByName(given).withColumn("_near", F.max("_offer").over(inside)).filter("_offer IS NULL")
    found = here.join(carried, [*keys, "_b"], "left").select(*keys, "turn", F.coalesce("_near", "_carried").alias("source"))
    return asks.join(found, [*keys, "turn"], "left")


def links(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, n_quotes, parent_turn, source_conv, source_turn), a row for each message that quotes.

    parent_turn: the earlier message of the conversation that it answers. source_conv and
    source_turn: if there is none, the first message anywhere that says its first passage.
    """
    asks = common.staged(quoted(rows), "quoted")
    wanted = asks.select("hash").distinct()
    offers = common.staged(said(rows).join(common.small(wanted, F.lit(48)), "hash", "left_semi"), "said")
    placed = asks.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    inside = latest_before(placed, offers, ["conv_id", "hash"], block)
    first = offers.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("_first"))
    both = inside.join(first, "hash", "left")
    order = ("level", "nth", "kind", "size")
    away = F.when((F.col("_first.conv_id") != F.col("conv_id")), F.struct(*order, F.col("_first.conv_id").alias("conv"), F.col("_first.turn").alias("turn")))
    near = F.when(F.col("source").isNotNull(), F.struct(*order, "source"))
    found = both.groupBy("conv_id", "turn").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("n_quotes"), F.min(near).alias("_near"), F.min(away).alias("_away"))
    alone = F.col("_near").isNull()
    return found.select("conv_id", "turn", "n_quotes", F.col("_near.source").alias("parent_turn"), F.when(alone, F.col("_away.conv")).alias("source_conv"), F.when(alone, F.col("_away.turn")).alias("source_turn"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of each message with a parent."""
    now = common.staged(linked.filter("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = now.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("_up"), F.col("depth").alias("_more"))
        step = now.join(up, ["conv_id", "thread_turn"], "left")
        moved = common.staged(step.select("conv_id", "turn", F.coalesce("_up", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_moved")), "threads")
        now = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return now


def places(linked: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, place): the rank of each message in its thread's tour, answers by turn behind what they answer.

    The tour enters and leaves each message; how many are entered from a step on to the end is added up
    by pointer doubling, and what that is less than at the thread's first message is the place.
    """
    kids = linked.filter("parent_turn IS NOT NULL").select("conv_id", "parent_turn", "turn")
    before = latest_before(kids, kids, ["conv_id", "parent_turn"], block)
    after = before.filter("source IS NOT NULL").select("conv_id", F.col("source").alias("turn"), F.col("turn").alias("next"))
    eldest = kids.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("kid"))
    nodes = kids.select("conv_id", "turn").union(kids.select("conv_id", "parent_turn")).distinct()
    nodes = nodes.join(kids, ["conv_id", "turn"], "left").join(after, ["conv_id", "turn"], "left").join(eldest, ["conv_id", "turn"], "left")
    step = lambda turn, out: F.struct(turn.alias("turn"), F.lit(out).alias("out"))
    enter = F.when(F.col("kid").isNotNull(), step(F.col("kid"), 0)).otherwise(step(F.col("turn"), 1))
    leave = F.when(F.col("next").isNotNull(), step(F.col("next"), 0)).when(F.col("parent_turn").isNotNull(), step(F.col("parent_turn"), 1))
    first = F.col("parent_turn").isNull()
    tour = nodes.select("conv_id", "turn", F.lit(0).alias("out"), enter.alias("to"), F.lit(1).cast("long").alias("n"), first.alias("top"))
    tour = tour.unionByName(nodes.select("conv_id", "turn", F.lit(1).alias("out"), leave.alias("to"), F.lit(0).cast("long").alias("n"), first.alias("top")))
    now = common.staged(tour.select("conv_id", "turn", "out", F.col("to.turn").alias("to_turn"), F.col("to.out").alias("to_out"), "n", "top"), "tour")
    while not now.filter("to_turn IS NOT NULL").isEmpty():
        on = now.select("conv_id", F.col("turn").alias("to_turn"), F.col("out").alias("to_out"), F.col("to_turn").alias("_turn"), F.col("to_out").alias("_out"), F.col("n").alias("_n"))
        step = now.join(on, ["conv_id", "to_turn", "to_out"], "left")
        now = common.staged(step.select("conv_id", "turn", "out", F.col("_turn").alias("to_turn"), F.col("_out").alias("to_out"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), "top"), "tour")
    return now.filter("out = 0").select("conv_id", "turn", "n", "top")


def conversations(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """messages(conv_id, turn, role, text) without quotes, with their place in reply order.

    Adds n_quotes, parent_turn, source_conv, source_turn, depth (answers from the thread's first
    message), thread_turn (that message) and place: a conversation in reply order is its rows by
    thread_turn, place.
    """
    linked = common.staged(links(messages, block), "links")
    toured = places(linked, block)
    found = threads(linked)
    tops = toured.filter("top").select("conv_id", F.col("turn").alias("thread_turn"), F.col("n").alias("_all"))
    found = found.join(tops, ["conv_id", "thread_turn"]).join(toured.select("conv_id", "turn", "n"), ["conv_id", "turn"])
    found = found.select("conv_id", "turn", "thread_turn", "depth", (F.col("_all") - F.col("n")).alias("place"))
    placed = linked.join(found, ["conv_id", "turn"], "left").withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    own = messages.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("text"))
    out = own.join(placed, (own["conv_id"] == F.col("_conv")) & (own["turn"] == F.col("_turn")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", zero).alias("n_quotes"), "parent_turn", "source_conv", "source_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", zero).alias("depth"), F.coalesce("place", zero).alias("place"),
    )
