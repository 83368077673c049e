"""Sequence tables: dense ids, orders, kind, letter statistics, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import columns as C
from seqloom.plans.params import DNA, PROTEIN, RNA

from . import storage

#: Records that the kind of sequence is told from.
TYPE_ROWS = 256


def loaded(seqs: DataFrame) -> DataFrame:
    """seqs(name, seq, ...) with seqlen; an empty or missing name or sequence is an error."""
    fine = (F.length("name") > 0) & (F.length("seq") > 0)
    checked = F.when(F.coalesce(fine, F.lit(False)), F.col("seq")).otherwise(F.raise_error(F.lit("a record without name or sequence")).cast("string"))
    return seqs.withColumn("seq", checked).withColumn("seqlen", F.length("seq"))


def numbered(df: DataFrame, order: list[Column], name: str = "seq_id", start: int = 0) -> DataFrame:
    """df with dense ids in this order, without bringing the rows to one task.

    Rows are dealt out by ranges of the order and written; a partition's first id is the number
    of rows in those before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    held = storage.kept(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    held = held.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()  # a row for each partition
    rows, total = [], start
    for r in sizes:
        rows.append((r["_part"], total))
        total += r["_n"]
    first = df.sparkSession.createDataFrame(rows, "_part long, _first long")
    return held.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_nth")).drop("_part", "_at", "_nth", "_first")


def order_key(order: str, name: Column, seq: Column) -> list[Column]:
    """The sort keys of an order: shuffle, length (longest first), else as they come."""
    if order == "shuffle":
        return [F.xxhash64(name, F.lit(7)), name]
    if order == "length":
        return [F.length(seq).desc(), C.poly_hash_of(name), name]
    return []


def detected_type(seqs: DataFrame, rows: int = TYPE_ROWS) -> DataFrame:
    """(n_nucleotide, n_other, seqtype) of the first rows, by seq_id where it is there."""
    first = (seqs.orderBy("seq_id") if "seq_id" in seqs.columns else seqs).limit(rows)
    count = lambda letters: F.sum(F.length("seq") - F.length(F.regexp_replace("seq", f"[{letters}]", "")))
    got = first.agg(count("ACGTUacgtu").alias("n_nucleotide"), F.sum(F.length("seq")).alias("n_all"), count("Tt").alias("n_t"), count("Uu").alias("n_u"))
    other = F.col("n_all") - F.col("n_nucleotide")
    kind = F.when(other * 4 > F.col("n_nucleotide"), PROTEIN).when(F.col("n_t") < F.col("n_u"), RNA).otherwise(DNA)
    return got.select("n_nucleotide", other.alias("n_other"), kind.alias("seqtype"))


def letters(seqs: DataFrame) -> DataFrame:
    """(letter, n) over all residues; counts are added up in each partition first."""
    return seqs.select(F.explode(F.array_remove(F.split("seq", ""), "")).alias("letter")).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))


def letter_statistics(seqs: DataFrame) -> DataFrame:
    """(residues, entropy, effective_letters, homology_threshold)."""
    counts = letters(seqs)
    total = counts.agg(F.sum("n").alias("residues"))
    p = F.col("n") / F.col("residues")
    got = counts.crossJoin(F.broadcast(total)).groupBy("residues").agg(F.sum(-p * F.ln(p)).alias("entropy"))  # one row with the total
    return got.select("residues", "entropy", F.exp("entropy").alias("effective_letters"), (1 / F.pow(F.exp("entropy"), F.lit(0.33))).alias("homology_threshold"))


def half_sample(df: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """About half of the rows, told by a hash, so that it is the same half wherever it runs."""
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)) == 0)


def neighbours(seqs: DataFrame, n: int, wanted: int = 10_000, powers: int | None = None) -> DataFrame:
    """(seq_id, other_id): every (n / wanted)-th sequence with those 1, 2, 4, ... places from it; powers: how many of these distances at most."""
    step, most = max(1, n // wanted), max(1, n)
    reach = most.bit_length() if powers is None else min(powers, most.bit_length())
    offsets = [s * (1 << i) for i in range(reach) for s in (-1, 1) if 1 << i < most]
    base = seqs.filter(F.col("seq_id") % step == 0).select("seq_id", F.explode(F.array(*[F.lit(x).cast("long") for x in offsets or [0]])).alias("_o"))
    return base.select("seq_id", (F.col("seq_id") + F.col("_o")).alias("other_id")).filter((F.col("other_id") >= 0) & (F.col("other_id") < n) & (F.col("other_id") != F.col("seq_id")))


def letter_frequencies(seqs: DataFrame) -> DataFrame:
    """(seq_id, match_probability): the sum of squared letter frequencies of each sequence."""
    each = seqs.select("seq_id", F.explode(F.array_remove(F.split("seq", ""), "")).alias("letter")).groupBy("seq_id", "letter").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("seq_id").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("match_probability"))


SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("comment", T.StringType()), T.StructField("seq", T.StringType())])
