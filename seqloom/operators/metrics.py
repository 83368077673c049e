"""Quality of clusterings: family purity, score distributions, percentiles, pair lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.functions import columns as C

from . import storage


def family_purity(clusters: DataFrame) -> DataFrame:
    """(clusters, corrupted_clusters, corrupted_members) of rows (centroid_family, centroid, member_family, member).

    A member is corrupted if its family isn't its centroid's.
    """
    bad = ~F.col("centroid_family").eqNullSafe(F.col("member_family"))
    return clusters.agg(
        F.countDistinct("centroid").alias("clusters"),
        F.countDistinct(F.when(bad, F.col("centroid"))).alias("corrupted_clusters"),
        F.count(F.when(bad, F.lit(1))).alias("corrupted_members"),
    )


def named_purity(clusters: DataFrame) -> DataFrame:
    """family_purity of clusters(centroid, member) whose names are family@name."""
    return family_purity(clusters.select(C.family(F.col("centroid")).alias("centroid_family"), "centroid", C.family(F.col("member")).alias("member_family"), "member"))


def cluster_corruption(members: DataFrame) -> DataFrame:
    """(cluster, size, corrupted): members(cluster, member, family) that are not of the family of the cluster's first member."""
    first = members.groupBy("cluster").agg(F.min_by("family", "member").alias("_f"))
    return members.join(first, "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(~F.col("family").eqNullSafe(F.col("_f")), F.lit(1))).alias("corrupted"))


def repeated_members(members: DataFrame) -> DataFrame:
    """Members of more than one cluster; empty for a clustering."""
    return members.groupBy("member").agg(F.countDistinct("cluster").alias("n")).filter("n > 1")


def sensitivity(clusters: DataFrame) -> DataFrame:
    """(sequences, clusters, sensitivity): the mean size of the clusters."""
    got = clusters.agg(F.count(F.lit(1)).alias("sequences"), F.countDistinct("centroid").alias("clusters"))
    return got.withColumn("sensitivity", F.col("sequences") / F.col("clusters"))


def group_scores(rows: DataFrame, key: str, score: str, with_list: bool = False) -> DataFrame:
    """(key, n, min_score, mean_score[, scores]) of each group."""
    aggs = [F.count(score).alias("n"), F.min(score).alias("min_score"), F.avg(score).alias("mean_score")]
    return rows.groupBy(key).agg(*aggs, *([F.sort_array(F.collect_list(score)).alias("scores")] if with_list else []))


def decile_cdf(rows: DataFrame, score: str) -> DataFrame:
    """(bin, n, cumulative) for the ten bins (0, 0.1], ..., (0.9, 1], the empty ones too.

    A score that no bin has, as 0 or one above 1, is an error; a null one is not counted.
    """
    bin_of = C.decile(F.col(score))
    wrong = F.raise_error(F.concat(F.lit("a score outside (0, 1]: "), F.col(score).cast("string"))).cast("int")
    counts = rows.filter(F.col(score).isNotNull()).select(F.when(bin_of.between(0, 9), bin_of).otherwise(wrong).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    bins = rows.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    dense = bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))  # at most ten rows
    return dense.withColumn("cumulative", F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)))


def floor_percentile(rows: DataFrame, value: str, percents: list[int], keys: list[str] | None = None) -> DataFrame:
    """([keys,] percent, value): the sorted value at position floor((n - 1) * percent / 100), 0 if there are none.

    Values are counted first, and the distinct ones dealt out by ranges; a range's first position
    is the sum of the counts in the ranges before it. No list of all values is built, and no task
    has all values of a key.
    """
    keys = keys or []
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = storage.kept(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "percentiles")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of a key
    firsts = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"), F.sum("_sum").over(W.partitionBy(*keys)).alias("_all"))
    so_far = W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = dealt.withColumn("_here", F.sum("_n").over(so_far)).join(firsts, [*keys, "_part"])
    run = run.select(*keys, value, "_n", (F.col("_first") + F.col("_here")).alias("_end"), "_all", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    at = F.floor((F.col("_all") - 1) * F.col("percent") / 100)
    found = run.filter((at < F.col("_end")) & (at >= F.col("_end") - F.col("_n"))).select(*keys, "percent", F.col(value).alias("value"))
    if keys:
        return found
    asked = rows.sparkSession.createDataFrame([(p,) for p in percents], "percent int")
    return asked.join(found, "percent", "left").select("percent", F.coalesce("value", F.lit(0).cast(rows.schema[value].dataType)).alias("value"))


def mean_with_epsilon(value: Column) -> Column:
    return F.sum(value) / (F.lit(1e-9) + F.count(value))


def canonical_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct unordered pairs as (id1, id2), the smaller first."""
    return pairs.select(F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2")).distinct()


def new_pairs(pairs: DataFrame, memo: DataFrame, a: str = "centroid", b: str = "member") -> DataFrame:
    """Pairs that memo(id1, id2, ...) doesn't have yet."""
    return canonical_pairs(pairs, a, b).join(memo.select("id1", "id2"), ["id1", "id2"], "left_anti")


def both_directions(memo: DataFrame) -> DataFrame:
    """(src, dst, score) of memo(id1, id2, tm1, tm2): tm2 from id1 to id2, tm1 back; of equal ids once."""
    there = memo.select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.col("tm2").alias("score"))
    back = memo.filter("id1 != id2").select(F.col("id2").alias("src"), F.col("id1").alias("dst"), F.col("tm1").alias("score"))
    return there.unionByName(back)


def scored_members(clusters: DataFrame, memo: DataFrame) -> DataFrame:
    """clusters(centroid, member) with the score from the centroid to the member."""
    return clusters.join(both_directions(memo).withColumnsRenamed({"src": "centroid", "dst": "member"}), ["centroid", "member"])


def member_pairs(clusters: DataFrame, with_self: bool = False) -> DataFrame:
    """(centroid, a, b): all pairs of members of each cluster.

    Its rows grow with the square of the largest cluster: it is a listing for evaluation, and no
    part of a clustering. Means over pairs are taken from sums per cluster where they can.
    """
    a, b = clusters.select("centroid", F.col("member").alias("a")), clusters.select("centroid", F.col("member").alias("b"))
    found = a.join(b, "centroid")
    return found if with_self else found.filter("a != b")
