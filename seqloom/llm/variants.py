"""Spelling variants of words by anagram hashing.

A word's key is the sum of the fifth powers of its letters' code points, modulo a prime: an order-free
number, equal for all anagrams. A letter more or less changes it by that letter's power, and an exchange
by the difference of two. So a word is posted under its own key and under its key less each of its
letters: an added or removed letter is a key that meets a lessened one, an exchanged letter two
lessened keys that meet. Two words that differ in one letter agree in their whole first or whole second half,
and that half, by its hash, is part of what is joined, so that words of the same letters in another order
don't meet. Of those that meet, the order of letters decides: one edit or not.

A word's form is its near word that occurs most, if that occurs FACTOR times as often; forms are
followed to the last, the root, by doubling steps. Counts grow FACTOR-fold each step, so that few rounds do.

Nulls: a null text has no words; a null doc_id counts as an empty one. Repeated rows count again, as their
words occur again. Of near words that occur equally often the first in the order of code points is the form.
Empty tables give none. Texts of any length are read whole, words of any length are compared. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

RUN, LETTERS, OCCURRENCES, FACTOR = "[a-zÀ-ÿ]+", 6, 5, 5
POWER, PRIME = 5, 2**61 - 1
#: One in so many occurrences of a word loses a letter, in runs_with_slips().
SLIPS = 199


def runs_with_slips(docs: DataFrame, one_in: int = SLIPS, letters: int = LETTERS) -> DataFrame:
    """(word) of each occurrence of at least so many letters, A-Z lower-cased; a keyed one in `one_in` has lost a letter."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(common.ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("w"))
    found = found.filter(F.length("w") >= letters)  # a shorter one is too short with a letter less as well
    h = F.crc32(F.concat("d", F.lit(":"), "w"))
    at = (h % F.length("w")).cast("int")
    shorter = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    return found.select(F.when(h % one_in == 0, shorter).otherwise(F.col("w")).alias("word")).filter(F.length("word") >= letters)


def counted(occurrences: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """(word, n) of words that occur at least so often; counts are added up in each task first."""
    return occurrences.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _power(c: Column) -> Column:
    out = c
    for _ in range(POWER - 1):
        out = out * c
    return out


def _keyed(words: DataFrame) -> DataFrame:
    """words(word, n) with same, shorter and longer: what a word is joined by as one of a pair of equal lengths, and as the shorter or the longer one."""
    codes = F.transform(F.array_remove(F.split("word", ""), ""), lambda c: _power(F.ascii(c).cast("long")))
    rows = words.select("word", "n", F.length("word").alias("l"), codes.alias("c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: (a + x) % PRIME)
    rows = rows.select("word", "n", "l", "c", total.alias("key"))

    def halves(length: Column, more: int) -> tuple[Column, Column, Column]:
        """The place that parts both halves of a word of this length, and both halves of one with `more` letters more."""
        at = F.floor(length / 2).cast("int")
        return at, F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 1 + more, length)

    def lessened(kind: int, length: Column, more: int) -> Column:
        """A key for each different letter of the second half, with the first half, and the other way round."""
        at, head, tail = halves(length, more)
        less = lambda part, side, half: F.transform(F.array_distinct(part), lambda x: F.xxhash64(F.lit(kind), length, F.pmod(F.col("key") - x, F.lit(PRIME)), F.lit(side), half))
        return F.concat(less(F.slice("c", at + 1, F.col("l")), 0, head), less(F.slice("c", F.lit(1), at), 1, tail))

    _, head, tail = halves(F.col("l"), 0)
    whole = F.array(F.xxhash64(F.lit(1), "l", "key", F.lit(0), head), F.xxhash64(F.lit(1), "l", "key", F.lit(1), tail))
    return rows.select("word", "n", lessened(0, F.col("l"), 0).alias("same"), whole.alias("shorter"), lessened(1, F.col("l") - 1, 1).alias("longer"))


#: Letters of a word up to which edits are counted by a table.
SHORT = 32


def _one_edit(a: Column, b: Column) -> Column:
    """Whether a, not longer than b, differs from it by one letter; in time in proportion to the length for long words."""
    letters = lambda w: F.array_remove(F.split(w, ""), "")
    differ = F.zip_with(letters(a), F.slice(letters(b), F.lit(1), F.length(a)), lambda x, y: x != y)
    at = F.array_position(differ, True).cast("int")  # the first place that differs, from 1; 0: none
    at = F.when(at == 0, F.length(a) + 1).otherwise(at)
    rest = lambda w, i: F.substring(w, i, F.length(w))
    same = F.when(F.length(a) == F.length(b), (rest(a, at + 1) == rest(b, at + 1)) & (at <= F.length(a))).otherwise((F.length(b) == F.length(a) + 1) & (rest(a, at) == rest(b, at + 1)))
    return F.when(F.length(b) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(same)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), each pair once: words(word, n), all different, that differ by one added, removed or exchanged letter."""
    keyed = _keyed(words)
    one = keyed.select(F.explode(F.concat("same", "shorter")).alias("k"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = keyed.select(F.explode(F.concat("same", "longer")).alias("k"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    # a key for each letter: by the size of the words that they are made of Spark would take the keys for few, and broadcast them
    met = one.join(other.hint("merge"), "k").filter((F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    # of equal letters in a row one or another can be the added one, and both halves agree: several keys, one pair
    return met.filter(_one_edit(F.col("a"), F.col("b"))).select("a", "a_n", "b", "b_n").distinct()


def formed(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words(word, n) with n_near, form and form_n."""
    both = near_pairs(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("o"), F.col("b_n").alias("o_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("o"), F.col("a_n").alias("o_n")))).alias("p")).select("p.*")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("o_n")).alias("m"), "o")).alias("best"))
    rows = words.join(near.hint("merge"), "word", "left")
    high = -F.col("best.m") >= F.col("n") * factor
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("best.o")).alias("form"), F.when(high, -F.col("best.m")).alias("form_n"))


def rooted(found: DataFrame, factor: int = FACTOR) -> DataFrame:
    """found(word, n, form, ...) with root, the last of the forms that follow one another; the word itself if it has none."""
    up = common.staged(found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "variants-up")
    top = found.agg(F.max("n").alias("n"), F.min("n").alias("m")).first()
    steps = math.floor(math.log(max(1, (top["n"] or 1) / max(1, top["m"] or 1)), factor) + 1e-9) + 1  # at most so many forms in a row
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        up = common.staged(up.join(higher.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "variants-up")
    return found.join(up.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), which are all different."""
    held = common.staged(words, "variants-words")
    found = common.staged(formed(held, factor), "variants-forms")
    return rooted(found, factor).select("word", "form", "root", "n", "n_near", "form_n")
