"""Annotation with the terms of an ontology: closure, information content, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Evidence of experiments, and the set that a prediction challenge uses.
EXPERIMENTAL = ("EXP", "IDA", "IPI", "IMP", "IGI", "IEP")
CHALLENGE = ("EXP", "IDA", "IMP", "IGI", "IEP", "TAS")


def ancestors(terms: DataFrame, parents: DataFrame, most: int = 1000) -> DataFrame:
    """(term, anc): each term with itself and all it is part of, by parents(term, parent).

    Breadth first; a round joins what the last one found to its parents, and ends when nothing is new.
    """
    seen = storage.kept(terms.select("term", F.col("term").alias("anc")).distinct(), "ancestors")
    new = seen
    up = parents.select(F.col("term").alias("_t"), "parent")
    for _ in range(most):
        found = new.join(up, F.col("anc") == F.col("_t")).select("term", F.col("parent").alias("anc")).distinct()
        new = storage.kept(found.join(seen, ["term", "anc"], "left_anti"), "ancestors-new")
        if new.isEmpty():
            break
        seen = storage.kept(seen.unionByName(new), "ancestors")
    return seen


def experimental(annotations: DataFrame, evidence: tuple[str, ...] = EXPERIMENTAL) -> DataFrame:
    return annotations.filter(F.col("evidence").isin(*evidence))


def annotated_pairs(pairs: DataFrame, annotations: DataFrame, a: str = "centroid", b: str = "member") -> DataFrame:
    """pairs both sides of which have an annotation(acc, term)."""
    known = annotations.select("acc").distinct()
    return pairs.join(known.withColumnRenamed("acc", a), a, "left_semi").join(known.withColumnRenamed("acc", b), b, "left_semi")


def term_frequencies(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, freq, total): annotations of a term or of what it is an ancestor of; total is their sum."""
    freq = annotations.select("acc", "term").join(closure, "term").groupBy("anc").agg(F.count(F.lit(1)).alias("freq")).withColumnRenamed("anc", "term")
    total = freq.agg(F.sum("freq").alias("total"))
    return freq.crossJoin(F.broadcast(total))  # one row with the total


def information(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term, freq, ic) with ic = -ln(freq / total)."""
    return term_frequencies(annotations, closure).select("term", "freq", (-F.ln(F.col("freq") / F.col("total"))).alias("ic"))


def reliable(annotations: DataFrame, information_: DataFrame, least: int = 10) -> DataFrame:
    """annotations with terms of at least this frequency."""
    return annotations.join(information_.filter(F.col("freq") >= least).select("term"), "term", "left_semi")


def common_ancestors(pairs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs(t1, t2) with the most informative common ancestor (mica) and its ic; null and 0 if none has any."""
    one = pairs.select("t1", "t2").distinct()
    x = closure.select(F.col("term").alias("t1"), "anc")
    y = closure.select(F.col("term").alias("t2"), "anc")
    found = one.join(x, "t1").join(y, ["t2", "anc"]).join(ic.select(F.col("term").alias("anc"), "ic"), "anc").filter("ic > 0")
    best = found.groupBy("t1", "t2").agg(F.min(F.struct((-F.col("ic")).alias("s"), "anc")).alias("b"))
    return one.join(best, ["t1", "t2"], "left").select("t1", "t2", F.col("b.anc").alias("mica"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("mica_ic"))


def set_mica(sets: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(key, mica, mica_ic): of sets(key, term) the most informative ancestor that all terms of a set have."""
    sizes = sets.select("key", "term").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    anc = sets.select("key", "term").distinct().join(closure, "term").groupBy("key", "anc").agg(F.count(F.lit(1)).alias("_k"))
    anc = anc.join(sizes, "key").filter("_k = _n").join(ic.select(F.col("term").alias("anc"), "ic"), "anc").filter("ic > 0")
    best = anc.groupBy("key").agg(F.min(F.struct((-F.col("ic")).alias("s"), "anc")).alias("b"))
    return sizes.join(best, "key", "left").select("key", F.col("b.anc").alias("mica"), F.coalesce(-F.col("b.s"), F.lit(0.0)).alias("mica_ic"))


def lin(pairs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs(t1, t2) with sim11 = 2 ic(mica) / (ic(t1) + ic(t2)), 1 if that is over 0, within 0 and 1."""
    got = common_ancestors(pairs, closure, ic)
    a, b = ic.select(F.col("term").alias("t1"), F.col("ic").alias("_a")), ic.select(F.col("term").alias("t2"), F.col("ic").alias("_b"))
    got = got.join(a, "t1", "left").join(b, "t2", "left")
    both = F.col("_a") + F.col("_b")
    sim = F.when(F.col("mica").isNull() & (both != 0), 0.0).when(both == 0, 1.0).otherwise(2 * F.col("mica_ic") / both)
    return got.select("t1", "t2", "mica", "mica_ic", F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim)).alias("sim11"))


def best_match_average(pairs: DataFrame, annotations: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """pairs(a, b) with sim22: the mean, over the terms of both, of the best sim11 with a term of the other."""
    own = annotations.select("acc", "term").distinct()
    wide = pairs.select("a", "b").distinct().join(own.select(F.col("acc").alias("a"), F.col("term").alias("t1")), "a").join(own.select(F.col("acc").alias("b"), F.col("term").alias("t2")), "b")
    sims = wide.join(lin(wide, closure, ic).select("t1", "t2", "sim11"), ["t1", "t2"])
    left = sims.groupBy("a", "b", F.col("t1").alias("t")).agg(F.max("sim11").alias("best"))
    right = sims.groupBy("a", "b", F.col("t2").alias("t")).agg(F.max("sim11").alias("best"))
    return left.unionAll(right).groupBy("a", "b").agg((F.sum("best") / F.count(F.lit(1))).alias("sim22"))


def specificity(closure: DataFrame) -> DataFrame:
    """(term, n_anc, n_off, specificity) from a closure over all terms, a term counting among both of its own."""
    from seqloom.functions import columns as C

    n_anc = closure.groupBy("term").agg(F.count(F.lit(1)).alias("n_anc"))
    n_off = closure.groupBy(F.col("anc").alias("term")).agg(F.count(F.lit(1)).alias("n_off"))
    got = n_anc.join(n_off, "term")
    return got.withColumn("specificity", C.structural_specificity(F.col("n_off"), F.col("n_anc")))


def link_means(sims: DataFrame) -> DataFrame:
    """(centroid, a, mean) and so on are groupings of sims(centroid, a, b, sim22); here by member, without itself."""
    return sims.filter("a != b").groupBy("centroid", "a").agg(F.avg("sim22").alias("mean"))


def cluster_means(sims: DataFrame) -> DataFrame:
    """(centroid, members, mean, weight): a cluster's mean without self-pairs, weighted by its members less one."""
    got = sims.filter("a != b").groupBy("centroid").agg(F.avg("sim22").alias("mean"), F.countDistinct("a").alias("members"))
    return got.select("centroid", "members", "mean", (F.col("members") - 1).alias("weight"))


def information_loss(members: DataFrame, annotations: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(centroid, member, member_ic, cluster_ic, loss) of members(centroid, member).

    A member's ic is that of the ancestor its terms have in common, a cluster's that of the
    ancestor that those of its members have in common.
    """
    own = set_mica(members.select("member").distinct().join(annotations, F.col("member") == F.col("acc")).select(F.col("member").alias("key"), "term"), closure, ic)
    own = own.select(F.col("key").alias("member"), F.col("mica").alias("term"), F.col("mica_ic").alias("member_ic"))
    rows = members.join(own, "member")
    whole = set_mica(rows.filter("term IS NOT NULL").select(F.col("centroid").alias("key"), "term"), closure, ic)
    rows = rows.join(whole.select(F.col("key").alias("centroid"), F.col("mica_ic").alias("cluster_ic")), "centroid", "left")
    return rows.select("centroid", "member", "member_ic", F.coalesce("cluster_ic", F.lit(0.0)).alias("cluster_ic")).withColumn("loss", F.col("member_ic") - F.col("cluster_ic"))


def categories(members: DataFrame, annotations: DataFrame, closure: DataFrame, parents: DataFrame, ic: DataFrame) -> DataFrame:
    """(centroid, category) of members(centroid, member).

    1: all annotation sets are equal; 2: all members have one common ancestor as theirs; 3: those
    are the cluster's own or its children; 4: all others.
    """
    sets = annotations.groupBy("acc").agg(F.sort_array(F.collect_set("term")).alias("terms")).withColumnRenamed("acc", "member")
    rows = members.join(sets, "member")
    own = set_mica(rows.select(F.col("member").alias("key"), F.explode("terms").alias("term")).distinct(), closure, ic)
    rows = rows.join(own.select(F.col("key").alias("member"), "mica"), "member")
    whole = set_mica(rows.filter("mica IS NOT NULL").select(F.col("centroid").alias("key"), F.col("mica").alias("term")), closure, ic)
    rows = rows.join(whole.select(F.col("key").alias("centroid"), F.col("mica").alias("top")), "centroid", "left")
    near = parents.select(F.col("term").alias("mica"), F.col("parent").alias("top"), F.lit(True).alias("child")).distinct()
    rows = rows.join(near, ["mica", "top"], "left")
    close = F.coalesce((F.col("mica") == F.col("top")) | F.coalesce("child", F.lit(False)), F.lit(False))
    got = rows.groupBy("centroid").agg(F.countDistinct("terms").alias("_s"), F.countDistinct(F.coalesce("mica", F.lit(""))).alias("_m"), F.min(close).alias("_c"))
    return got.select("centroid", F.when(F.col("_s") == 1, 1).when(F.col("_m") == 1, 2).when(F.col("_c"), 3).otherwise(4).alias("category"))


def pair_details(clusters: DataFrame, annotations: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(centroid, a, b, sim22, terms_a, terms_b) of all pairs of different annotated members of each cluster."""
    from .metrics import member_pairs

    known = clusters.join(annotations.select(F.col("acc").alias("member")).distinct(), "member", "left_semi")
    pairs = member_pairs(known)
    sets = annotations.groupBy("acc").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"))
    a, b = (sets.select(F.col("acc").alias(x), F.col("terms").alias(f"terms_{x}")) for x in "ab")
    return pairs.join(best_match_average(pairs, annotations, closure, ic), ["a", "b"]).join(a, "a").join(b, "b").select("centroid", "a", "b", "sim22", "terms_a", "terms_b")


def specificity_loss(members: DataFrame, annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(n, mean_loss): how much more specific members' common ancestors are than their clusters', on average."""
    value = specificity(closure).select("term", F.col("specificity").alias("ic"))
    return information_loss(members, annotations, closure, value).agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"))


def report(values: DataFrame, value: str) -> DataFrame:
    """(n, mean, p25, p10) of a list of similarities, by the percentiles of sorted positions."""
    from .metrics import floor_percentile, mean_with_epsilon

    two = floor_percentile(values, value, [25, 10]).groupBy().agg(F.max(F.when(F.col("percent") == 25, F.col("value"))).alias("p25"), F.max(F.when(F.col("percent") == 10, F.col("value"))).alias("p10"))
    return values.agg(F.count(value).alias("n"), mean_with_epsilon(F.col(value)).alias("mean")).crossJoin(F.broadcast(two))  # one row each
