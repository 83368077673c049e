"""Readers of sequence and cluster files as DataFrames. Compression follows from the file's ending.

Record files are read with a record separator, or line by line, where what a line belongs to is
carried on from the lines before it, from block to block of a file. No file is read as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import storage

SEQUENCE = "name string, comment string, seq string"
WHITE = r"[ \t\x0B\f\r]"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq): name up to white space, comment the rest of the header, wrapped lines joined."""
    records = spark.read.option("lineSep", "\n>").text(path)
    # the first record of a file keeps its mark, and maybe lines before it
    body = F.regexp_replace("value", r"^(?:[^>]*\n)?>", "")
    head = F.regexp_extract(body, r"^([^\n]*)", 1)
    rest = F.regexp_replace(F.regexp_extract(body, r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", "")
    rows = records.filter(F.trim(F.regexp_replace("value", r"[>\s]", "")) != "")
    return rows.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.rtrim(F.regexp_extract(head, r"^\S*\s?([^\r]*)", 1)).alias("comment"), rest.alias("seq"))


def fastx_records(lines: Iterable[str]) -> Iterator[tuple[str, str, str]]:
    """(name, comment, seq) of FASTA or FASTQ lines; a quality is read to the length of its sequence, and left out."""
    for head, seq, _ in _records(list(lines), True)[0]:
        parts = head.split(None, 1)
        yield parts[0] if parts else "", parts[1].rstrip() if len(parts) > 1 else "", seq


def _records(lines: list[str], ends: bool) -> tuple[list[tuple[str, str, int]], int]:
    """((head, seq, line) of the records of lines, the line at which one begins that isn't whole yet).

    ends: nothing follows; else the last record may go on.
    """
    found, at, n = [], 0, len(lines)
    while at < n:
        begin = at
        if lines[at][:1] not in (">", "@"):
            at += 1
            continue
        at += 1
        while at < n and lines[at][:1] not in (">", "@", "+"):
            at += 1
        seq = "".join("".join(lines[begin + 1 : at]).split())
        if at == n and not ends:
            return found, begin
        if at < n and lines[at][:1] == "+":
            at, got = at + 1, 0
            while at < n and got < len(seq):
                got, at = got + len(lines[at].rstrip("\r\n")), at + 1
            if got < len(seq) and not ends:
                return found, begin
            if got != len(seq):
                raise ValueError(f"the quality of {lines[begin][1:].strip()} is not as long as its sequence")
        found.append((lines[begin][1:].rstrip("\r\n"), seq, begin))
    return found, n


#: Records that have to follow one another without a fault before a line counts as the beginning of one.
SURE = 2


SEQUENCE_LINE = re.compile(r"[A-Za-z*.\s-]*")


def first_record(lines: list[str]) -> int | None:
    """The first line that a record begins at, told without what stands before these lines; None if there is none for certain.

    A line with @ or > may be a quality. As a beginning it is followed by a sequence and, with @, by + and a quality of equal
    length, SURE times or as far as the lines go; a quality isn't.
    """
    return next((at for at, line in enumerate(lines) if line[:1] in ("@", ">") and _sound(lines, at)), None)


def _sound(lines: list[str], at: int) -> bool:
    n, mark = len(lines), lines[at][:1]
    for k in range(SURE):
        if at == n:
            return True
        if lines[at][:1] != mark:
            return False
        at, size = at + 1, 0
        while at < n and lines[at][:1] not in (">", "@", "+"):
            if not SEQUENCE_LINE.fullmatch(lines[at]):
                return False
            size, at = size + len("".join(lines[at].split())), at + 1
        if at == n:
            return k > 0 or mark == ">" and size > 0
        if not size:
            return False
        if lines[at][:1] != "+":
            if mark == "@":
                return False
            continue
        at, got = at + 1, 0
        while at < n and got < size:
            got, at = got + len(lines[at].rstrip("\r\n")), at + 1
        if got < size:
            return k > 0
        if got > size:
            return False
    return True


#: Lines of a block that are looked at together.
LINES = 1 << 14


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines (file, block, value): the records of each block, and the lines before its first and of its last that isn't whole.

    part: 0 a record (head and seq), 1 the lines before the first record, 2 those of the last one, in `seq`.
    """
    now, held, open_ = None, [], False

    def step(last: bool) -> tuple[list[tuple], list[str]]:
        nonlocal open_
        lines, out = held, []
        if not open_:
            at = 0 if now[1] == 0 else first_record(lines)
            if at is None and not last:
                return [], lines
            if now[1]:
                out.append((*now, 1, None, "\n".join(lines[:at])))
            if at is None:  # a block inside a record
                return out, []
            lines, open_ = lines[at:], True
        found, rest = _records(lines, False)
        out += [(*now, 0, head, seq) for head, seq, _ in found]
        if last:
            out.append((*now, 2, None, "\n".join(lines[rest:])))
        return out, lines[rest:]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["file", "block", "part", "head", "seq"])

    for batch in batches:
        out = []
        for file, block, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != now:
                if now:
                    out += step(True)[0]
                now, held, open_ = (file, block), [], False
            held.append(value)
            if len(held) % LINES == 0:
                more, held = step(False)
                out += more
        if out:
            yield batch_of(out)
    if now:
        yield batch_of(step(True)[0])


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of the lines that lie on both sides of blocks' borders, from each file's parts in order."""
    for batch in batches:
        rows = []
        for parts in batch.column(0).to_pylist():
            lines: list[str] = []
            for p in parts:  # what a block begins with belongs to what the one before it ends with
                if p["part"] == 2:
                    rows += _records(lines, True)[0]
                    lines = []
                lines += p["seq"].split("\n") if p["seq"] else []
            rows += _records(lines, True)[0]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["head", "seq"])


def fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, comment, seq) of FASTQ and FASTA files, folders or patterns of them; qualities are checked and left out.

    Large files are read in blocks by many tasks. Each finds its first record by itself; the few lines on both sides of a
    border are put together afterwards, a row for each block. A record without a head, or a quality of another length, is an error.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    # written once: blocks that are read again could be cut elsewhere
    found = storage.kept(lines.mapInArrow(_split, "file string, block long, part int, head string, seq string"), "fastq")
    edges = found.filter("part > 0")
    around = edges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "part", "seq"))).alias("parts")).select("parts")
    rows = found.filter("part = 0").select("head", "seq").unionByName(around.mapInArrow(_stitched, "head string, seq string"))
    name = F.regexp_extract("head", r"^\s*(\S*)", 1)
    return rows.select(name.alias("name"), F.rtrim(F.regexp_replace("head", r"^\s*\S*\s*", "")).alias("comment"), "seq")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the lines of text files in blocks that are read apart; block and line give their order in a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.select("file", "block", F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def _here():
    return W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)


def _carried(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with the last value that isn't null up to each line.

    Lines of a block are looked at in one task, and what a block ends with is carried over to the next.
    """
    rows = rows.withColumns(values)
    last = rows.groupBy("file", "block").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(f"_{c}") for c in values])
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = last.select("file", "block", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in values])
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(_here()) for c in values}).join(last, ["file", "block"])
    return rows.withColumns({c: F.coalesce(c, f"_{c}") for c in values}).drop(*[f"_{c}" for c in values])


def _counted(rows: DataFrame, name: str, flag: Column, one: bool = False) -> DataFrame:
    """rows with the number of lines with this flag up to each line, in its file, or in all of them by name if they are one list."""
    sums = rows.groupBy("file", "block").agg(F.sum(flag.cast("long")).alias("_n"))
    before = (W.orderBy("file", "block") if one else W.partitionBy("file").orderBy("block")).rowsBetween(W.unboundedPreceding, -1)  # a row for each block
    sums = sums.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    return rows.withColumn(name, F.sum(flag.cast("long")).over(_here())).join(sums, ["file", "block"]).withColumn(name, F.col(name) + F.col("_n")).drop("_n")


def stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(family, accession, member, name, seq): the aligned rows of each family, gaps taken out; name is family@member."""
    tag = lambda t: F.when(F.col("value").startswith(f"#=GF {t}"), F.trim(F.regexp_replace("value", f"^#=GF {t}", "")))
    rows = _carried(_lines(spark, path), family=tag("ID"), accession=tag("AC"))
    rows = rows.filter(~F.col("value").startswith("#") & ~F.col("value").startswith("//") & (F.trim("value") != ""))
    member = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.translate(F.regexp_extract("value", r"^\s*\S+\s+(\S+)", 1), ".-", "")
    return rows.select("family", "accession", member.alias("member"), F.concat("family", F.lit("@"), member).alias("name"), seq.alias("seq"))


def uniref(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq) of UniRef entries; comment has name, members, taxon, taxon id and representative."""
    # the tag is needed in full, since inference would guess numbers
    prop = "array<struct<_type:string,_value:string>>"
    schema = f"_id string, name string, property {prop}, representativeMember struct<dbReference:struct<_id:string,property:{prop}>,sequence:string>"
    rows = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    value = lambda props, kind: F.get(F.transform(F.filter(props, lambda x: x["_type"] == kind), lambda x: x["_value"]), F.lit(0))
    title = F.when(F.col("name").startswith("Cluster: "), F.expr("substr(name, 10)")).otherwise(F.coalesce("name", F.lit("None")))
    text = lambda c: F.coalesce(c, F.lit("None"))
    comment = F.concat(
        title, F.lit(" n="), text(value("property", "member count")), F.lit(" Tax="), text(value("property", "common taxon")),
        F.lit(" TaxID="), text(value("property", "common taxon ID")), F.lit(" RepID="), text(F.col("representativeMember.dbReference._id")),
    )
    return rows.select(F.col("_id").alias("name"), comment.alias("comment"), F.regexp_replace("representativeMember.sequence", r"\s+", "").alias("seq"))


def pdb(spark: SparkSession, path: str, last_date: str = "2017-01-01", least: int = 11, known: float = 0.9) -> DataFrame:
    """(name, seq) of files with exactly one chain, deposited by last_date.

    Modified residues count as what they stand for, unknown ones as X; a chain is kept if it has
    `least` residues and as large a share of `known` ones.
    """
    rows = _lines(spark, path).withColumn("at", F.struct("block", "line"))
    day = F.to_date(F.initcap(F.lower(F.regexp_extract("value", r"(\d\d-[A-Z]{3}-\d\d)", 1))), "dd-MMM-yy")
    late = rows.filter(F.col("value").startswith("HEADER")).filter(day > F.lit(last_date).cast("date")).select("file").distinct()
    rows = rows.join(late, "file", "left_anti")
    changed = rows.filter(F.col("value").startswith("MODRES")).select("file", F.substring("value", 13, 3).alias("code"), F.substring("value", 25, 3).alias("to")).distinct()
    named = rows.filter(F.col("value").startswith("SEQRES")).select("file", "at", F.substring("value", 12, 1).alias("chain"), F.posexplode(F.split(F.trim(F.expr("substr(value, 20)")), r"\s+")).alias("nth", "code"))
    letters = named.join(changed, ["file", "code"], "left").select("file", "chain", "at", "nth", C.residue(F.coalesce("to", "code")).alias("c"))
    chains = letters.groupBy("file").agg(F.countDistinct("chain").alias("n"), F.min("chain").alias("chain"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "nth", "c"))), lambda x: x["c"]), "").alias("seq"))
    size, fine = F.length("seq"), F.length(F.translate("seq", "X", ""))
    kept = chains.filter((F.col("n") == 1) & (size >= least) & (fine >= size * known))
    stem = F.lower(F.regexp_extract("file", r"([^/.]+?)(?:\.[^/]*)?$", 1))
    return kept.select(F.concat(stem, F.lit("_"), "chain").alias("name"), "seq")


def clstr(spark: SparkSession, path: str) -> DataFrame:
    """(centroid, member, identity) of a .clstr file; the representative's own row has 100."""
    rows = _counted(_lines(spark, path), "cluster", F.col("value").startswith(">Cluster"))
    name = F.regexp_extract("value", r">(\S+?)\.\.\.", 1)
    identity = F.regexp_extract("value", r"(?:[+-]/)?([0-9.]+)%\s*$", 1)
    rows = rows.filter(~F.col("value").startswith(">") & (name != "")).select("file", "cluster", name.alias("member"), F.rtrim("value").endswith("*").alias("is_centroid"), identity.alias("i"))
    top = rows.filter("is_centroid").select("file", "cluster", F.col("member").alias("centroid"))
    value = F.when(F.col("is_centroid"), 100.0).otherwise(F.expr("try_cast(i AS double)"))
    return rows.join(top, ["file", "cluster"]).select("centroid", "member", value.alias("identity"))


def uc(spark: SparkSession, path: str) -> DataFrame:
    """(centroid, member, identity) of a .uc file: hits, and the representatives themselves with 100."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).select(f.alias("f"))
    hits = rows.filter("f[0] = 'H'").select(F.get("f", F.lit(9)).alias("centroid"), F.get("f", F.lit(8)).alias("member"), F.get("f", F.lit(3)).cast("double").alias("identity"))
    tops = rows.filter("f[0] = 'C'").select(F.get("f", F.lit(8)).alias("centroid"), F.get("f", F.lit(8)).alias("member"), F.lit(100.0).alias("identity"))
    return hits.unionByName(tops)


def adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, sim), ids from 1, of a list whose first line is a header and whose n-th other line is source n.

    The files of a folder are one list, in the order of their names.
    """
    rows = _counted(_lines(spark, path), "at", F.lit(True), one=True).withColumn("at", F.col("at") - 1).filter((F.col("at") > 0) & (F.trim("value") != ""))
    each = rows.select(F.col("at").cast("long").alias("src"), F.split(F.trim("value"), r"\s+").alias("f"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("f") - 2, F.lit(2)), lambda i: F.struct(F.get("f", i).cast("int").alias("sim"), F.get("f", i + 1).cast("long").alias("dst")))
    return each.select("src", F.explode(pairs).alias("p")).select("src", "p.dst", "p.sim")


def ordinals(spark: SparkSession, path: str, either: bool = False) -> DataFrame:
    """(centroid, member, sim) by ordinal, from 1.

    either: a member 0 says that its line, and those after it in its file, count from 0; they are given from 1 as well.
    """
    if not either:
        return spark.read.csv(path, sep="\t", schema="centroid long, member long, sim int")
    f = F.split("value", "\t")
    rows = _lines(spark, path).filter(F.trim("value") != "").select("file", "block", "line", F.get(f, F.lit(0)).cast("long").alias("centroid"), F.get(f, F.lit(1)).cast("long").alias("member"), F.get(f, F.lit(2)).cast("int").alias("sim"))
    rows = _carried(rows, zero=F.when(F.col("member") == 0, True))
    more = F.when(F.col("zero"), 1).otherwise(0)
    return rows.select((F.col("centroid") + more).alias("centroid"), (F.col("member") + more).alias("member"), "sim")


def clusters(spark: SparkSession, path: str, prefix: str = "UniRef100_") -> DataFrame:
    """(centroid, member, sim) by name, a prefix of the names taken off."""
    f = F.split("value", r"\s+")
    bare = lambda i: F.regexp_replace(F.get(f, F.lit(i)), f"^{prefix}", "")
    return spark.read.text(path).filter(F.trim("value") != "").select(bare(0).alias("centroid"), bare(1).alias("member"), F.get(f, F.lit(2)).cast("int").alias("sim"))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, alt_ids, obsolete, namespace, is_a) of the terms of an OBO-XML file."""
    schema = "id string, alt_id array<string>, is_obsolete string, namespace string, is_a array<string>"
    rows = spark.read.format("xml").option("rowTag", "term").schema(schema).load(path)
    none = F.array().cast("array<string>")
    return rows.select("id", F.coalesce("alt_id", none).alias("alt_ids"), F.coalesce(F.col("is_obsolete") == "1", F.lit(False)).alias("obsolete"), "namespace", F.coalesce("is_a", none).alias("is_a"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(acc, term, aspect, evidence) of a UniProt flat file, by each record's first accession."""
    # a row for each record, or for several that have other line ends
    records = spark.read.option("lineSep", "\n//\n").text(path).select(F.explode(F.split("value", r"(?m)^//\r?$")).alias("record"))
    rows = records.select(F.regexp_extract("record", r"(?m)^AC\s+([^;\s]+)", 1).alias("acc"), F.explode(F.split("record", r"\r?\n")).alias("value")).filter(F.col("value").startswith("DR   GO;"))
    f = F.split("value", r";\s*")
    return rows.select("acc", F.get(f, F.lit(1)).alias("term"), F.substring(F.get(f, F.lit(2)), 1, 1).alias("aspect"), F.regexp_extract(F.get(f, F.lit(3)), r"^([^:.]*)", 1).alias("evidence"))


def memo(spark: SparkSession, path: str) -> DataFrame:
    """(id1, id2, tm1, tm2), a row for each unordered pair, of what was added to a memo table so far."""
    return spark.read.option("recursiveFileLookup", True).csv(path, sep="\t", schema="id1 string, id2 string, tm1 double, tm2 double")
