"""Writers of the formats that other tools read. Each sorts by the order asked for and writes text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta_text(name: Column, comment: Column, seq: Column, sep: str = " ") -> Column:
    """A record on two lines; the blank stays where the comment is empty."""
    return F.concat(F.lit(">"), name, F.lit(sep), F.coalesce(comment, F.lit("")), F.lit("\n"), seq)


def _write(lines: DataFrame, path: str, one_file: bool) -> None:
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def fasta(seqs: DataFrame, path: str, order: list[Column] | None = None, one_file: bool = False) -> None:
    rows = seqs.orderBy(*order) if order else seqs
    _write(rows.select(fasta_text(F.col("name"), F.col("comment"), F.col("seq")).alias("value")), path, one_file)


def adjacency_lines(edges: DataFrame, n: int) -> DataFrame:
    """(at, value): the header and, for each source, `100 self` and then its pairs by target; ids from 1."""
    rows = edges.filter("src != dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "sim"))).alias("p"))
    ids = edges.sparkSession.range(n).select(F.col("id").alias("src"))
    pair = lambda x: F.concat(x["sim"].cast("string"), F.lit(" "), (x["dst"] + 1).cast("string"))
    own = F.concat(F.lit("100 "), (F.col("src") + 1).cast("string"))
    lines = ids.join(rows, "src", "left").select((F.col("src") + 1).alias("at"), F.concat_ws(" ", own, F.array_join(F.transform("p", pair), " ")).alias("value"))
    head = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(f"{n} {n}").alias("value"))
    return head.unionByName(lines)


def adjacency(edges: DataFrame, n: int, path: str, one_file: bool = False) -> None:
    """The list in one file, or in a folder of files whose names are in its order."""
    _write(adjacency_lines(edges, n).orderBy("at").select("value"), path, one_file)


def assignment(clusters: DataFrame, path: str, one_file: bool = False) -> None:
    """centroid, member, sim by ordinal from 1, in member order."""
    rows = clusters.orderBy("member").select((F.col("centroid") + 1).alias("c"), (F.col("member") + 1).alias("m"), "sim")
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, sep="\t")


def named_clusters(named: DataFrame, path: str, one_file: bool = False) -> None:
    """centroid, member, sim, comment by name."""
    rows = named.select(F.concat_ws("\t", "centroid", "member", F.col("sim").cast("string"), F.coalesce("comment", F.lit(""))).alias("value"))
    _write(rows, path, one_file)


def centroids(seqs: DataFrame, clusters: DataFrame) -> DataFrame:
    """The sequences that are a centroid of some member, in id order."""
    return seqs.join(clusters.select(F.col("centroid").alias("seq_id")).distinct(), "seq_id", "left_semi").orderBy("seq_id")


def centroid_fasta(seqs: DataFrame, clusters: DataFrame, path: str, one_file: bool = False) -> None:
    _write(centroids(seqs, clusters).select(fasta_text(F.col("name"), F.col("comment"), F.col("seq"), "\t").alias("value")), path, one_file)


def centroid_fasta_lines(seqs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(seq_id, value): records of the centroids, with the names of their members in the header."""
    members = clusters.join(seqs.select(F.col("seq_id").alias("member"), F.col("name").alias("_m")), "member")
    members = members.groupBy(F.col("centroid").alias("seq_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "_m"))), lambda x: x["_m"]).alias("_all"))
    rows = seqs.join(members, "seq_id")
    return rows.select("seq_id", F.concat(F.lit(">"), "name", F.lit("\t"), F.array_join("_all", "\t"), F.lit("\n"), "seq").alias("value"))


def memo(new_rows: DataFrame, path: str, run: str | None = None) -> bool:
    """Adds rows (id1, id2, tm1, tm2) to a memo table, all or none of them; False if they are there already.

    Rows are written aside, in a folder that readers leave out, and are part of the table from its one renaming on. A job that
    failed or is run again adds nothing twice: what it adds has its name, `run`, or that of its rows, their number and digest.
    """
    spark = new_rows.sparkSession
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    new_rows.select("id1", "id2", "tm1", "tm2").write.csv(aside, sep="\t")
    if run is None:
        rows = spark.read.csv(aside, sep="\t", schema="id1 string, id2 string, tm1 double, tm2 double")
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id1", "id2", "tm1", "tm2")), F.lit(0)).alias("x")).first()
        run = f"{got['n']}-{got['x'] & (1 << 64) - 1:016x}"
    return _committed(spark, aside, f"{path}/run={run}")


def _committed(spark: SparkSession, aside: str, target: str) -> bool:
    """Renames a folder to one that isn't there yet; if it is, the folder goes."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(target).getFileSystem(spark._jsc.hadoopConfiguration())
    # of two jobs that rename at once the second moves its folder into the first one's, where readers leave it out
    if not files.exists(place(target)) and files.rename(place(aside), place(target)):
        return True
    files.delete(place(aside), True)
    if not files.exists(place(target)):
        raise OSError(f"{aside} could not be renamed to {target}")
    return False


def metric_line(label: str, *names: str) -> Column:
    """A row's numbers as one line of a report."""
    return F.format_string(label + " & ".join(["%s"] * len(names)), *[F.col(n).cast("string") for n in names])
