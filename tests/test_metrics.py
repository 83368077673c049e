import math
import random

import pytest

from seqloom.operators import metrics as M
from seqloom.operators import ontology as O


def test_purity(spark):
    rows = [("A@1", "A@1"), ("A@1", "B@2"), ("C@3", "C@3")]
    df = spark.createDataFrame(rows, "centroid string, member string")
    assert tuple(M.named_purity(df).first()) == (2, 1, 1)
    s = M.sensitivity(df).first()
    assert (s["sequences"], s["clusters"], s["sensitivity"]) == (3, 2, 1.5)
    members = spark.createDataFrame([(1, "a", "X"), (1, "b", "Y"), (1, "c", None), (2, "d", "Y"), (3, "d", "Y")], "cluster int, member string, family string")
    assert {(r["cluster"], r["size"], r["corrupted"]) for r in M.cluster_corruption(members).collect()} == {(1, 3, 2), (2, 1, 0), (3, 1, 0)}
    assert [r["member"] for r in M.repeated_members(members).collect()] == ["d"]


def test_percentile(spark):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2, None)], "v int")
    assert {r["percent"]: r["value"] for r in M.floor_percentile(df, "v", [0, 25, 50, 100]).collect()} == {0: 1, 25: 1, 50: 2, 100: 4}
    assert [r["value"] for r in M.floor_percentile(df.filter("v > 9"), "v", [25]).collect()] == [0]
    rng = random.Random(1)
    rows = [(k, rng.randint(0, 5)) for k in "ab" for _ in range(rng.randint(1, 30))]
    got = {(r["k"], r["percent"]): r["value"] for r in M.floor_percentile(spark.createDataFrame(rows, "k string, v int"), "v", [10, 77], ["k"]).collect()}
    for k in "ab":
        own = sorted(v for a, v in rows if a == k)
        assert all(got[k, p] == own[(len(own) - 1) * p // 100] for p in (10, 77))


def test_scores(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.51), ("b", 1.0)], "k string, s double")
    cdf = {r["bin"]: (r["n"], r["cumulative"]) for r in M.decile_cdf(df, "s").collect()}
    assert len(cdf) == 10 and cdf[4] == (1, 1) and cdf[5] == (1, 2) and cdf[9] == (1, 3) and cdf[0] == (0, 0)
    got = {r["k"]: (r["n"], r["min_score"], r["scores"]) for r in M.group_scores(df, "k", "s", True).collect()}
    assert got == {"a": (2, 0.5, [0.5, 0.51]), "b": (1, 1.0, [1.0])}
    assert df.agg(M.mean_with_epsilon(df["s"])).first()[0] == pytest.approx(0.67)


def test_memo(spark):
    memo = spark.createDataFrame([("a", "b", 0.1, 0.2), ("c", "c", 1.0, 1.0)], "id1 string, id2 string, tm1 double, tm2 double")
    pairs = spark.createDataFrame([("b", "a"), ("a", "d"), ("d", "a"), ("c", "c")], "centroid string, member string")
    assert [tuple(r) for r in M.new_pairs(pairs, memo).collect()] == [("a", "d")]
    assert sorted(tuple(r) for r in M.scored_members(pairs, memo).collect()) == [("b", "a", 0.1), ("c", "c", 1.0)]
    clusters = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "centroid int, member string")
    assert M.member_pairs(clusters).count() == 2 and M.member_pairs(clusters, True).count() == 5


PARENTS = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("e", "c"), ("f", "c")]
NOTES = [("p1", "d"), ("p1", "f"), ("p2", "e"), ("p3", "d"), ("p3", "f"), ("p4", "c"), ("p5", "a")]


@pytest.fixture
def onto(spark):
    parents = spark.createDataFrame(PARENTS, "term string, parent string")
    terms = spark.createDataFrame([(t,) for t in "abcdef"], "term string")
    notes = spark.createDataFrame(NOTES, "acc string, term string")
    closed = O.ancestors(terms, parents)
    return parents, notes, closed, O.information(notes, closed)


def up(t):
    return {t}.union(*(up(p) for c, p in PARENTS if c == t))


FREQ = {a: sum(a in up(t) for _, t in NOTES) for a in "abcdef"}
IC = {t: -math.log(n / sum(FREQ.values())) for t, n in FREQ.items() if n}


def lin(a, b):
    both = [x for x in up(a) & up(b) if IC[x] > 0]
    if not both:
        return 1.0 if IC[a] + IC[b] == 0 else 0.0
    return max(0.0, min(1.0, 2 * max(IC[x] for x in both) / (IC[a] + IC[b])))


def test_ontology(spark, onto):
    parents, notes, closed, ic = onto
    assert {(r["term"], r["anc"]) for r in closed.collect()} == {(t, a) for t in "abcdef" for a in up(t)}
    assert {r["term"]: r["freq"] for r in ic.collect()} == {t: n for t, n in FREQ.items() if n}
    assert {r["term"]: r["ic"] for r in ic.collect()} == pytest.approx(IC)
    pairs = spark.createDataFrame([(a, b) for a in "abcdef" for b in "abcdef"], "t1 string, t2 string")
    for r in O.lin(pairs, closed, ic).collect():
        assert r["sim11"] == pytest.approx(lin(r["t1"], r["t2"]))
        common = [x for x in up(r["t1"]) & up(r["t2"]) if IC[x] > 0]
        assert r["mica"] == min((x for x in common if IC[x] == max(IC[y] for y in common)), default=None)
    accs = sorted({a for a, _ in NOTES})
    terms = {a: {t for x, t in NOTES if x == a} for a in accs}
    got = O.best_match_average(spark.createDataFrame([(a, b) for a in accs for b in accs], "a string, b string"), notes, closed, ic)
    for r in got.collect():
        x, y = terms[r["a"]], terms[r["b"]]
        want = (sum(max(lin(s, t) for t in y) for s in x) + sum(max(lin(s, t) for s in x) for t in y)) / (len(x) + len(y))
        assert r["sim22"] == pytest.approx(want)
        assert x != y or r["sim22"] == pytest.approx(1)
    reliable = {r["term"] for r in O.reliable(notes, ic, 3).collect()}
    assert reliable == {t for _, t in NOTES if FREQ[t] >= 3}
    spec = {r["term"]: r["specificity"] for r in O.specificity(closed).collect()}
    for t in "abcdef":
        n_off, n_anc = sum(t in up(x) for x in "abcdef"), len(up(t))
        assert spec[t] == pytest.approx(1 - (n_off - 1) / (n_off + n_anc - 2))


def test_clusters_of_annotated(spark, onto):
    parents, notes, closed, ic = onto
    members = spark.createDataFrame([(1, "p1"), (1, "p3"), (2, "p1"), (2, "p2"), (3, "p4"), (3, "p2"), (4, "p2"), (4, "p2")], "centroid int, member string")
    assert {(r["centroid"], r["category"]) for r in O.categories(members, notes, closed, parents, ic).collect()} >= {(1, 1), (4, 1)}
    loss = {(r["centroid"], r["member"]): r for r in O.information_loss(members, notes, closed, ic).collect()}
    assert loss[3, "p4"]["loss"] == pytest.approx(0) and loss[3, "p2"]["loss"] == pytest.approx(IC["e"] - IC["c"])
    sims = spark.createDataFrame([(1, "x", "y", 0.5), (1, "y", "x", 0.7), (1, "x", "x", 1.0)], "centroid int, a string, b string, sim22 double")
    got = O.cluster_means(sims).first()
    assert (got["members"], got["weight"], got["mean"]) == (2, 1, pytest.approx(0.6))
    assert {r["a"]: r["mean"] for r in O.link_means(sims).collect()} == {"x": 0.5, "y": 0.7}
    pairs = spark.createDataFrame([("p1", "p2"), ("p1", "q")], "centroid string, member string")
    assert O.annotated_pairs(pairs, notes).count() == 1
    with_evidence = spark.createDataFrame([("a", "IDA"), ("b", "IEA"), ("c", "TAS")], "acc string, evidence string")
    assert O.experimental(with_evidence).count() == 1 and O.experimental(with_evidence, O.CHALLENGE).count() == 2


def test_details_and_reports(spark, onto):
    parents, notes, closed, ic = onto
    members = spark.createDataFrame([(1, "p1"), (1, "p3"), (1, "q"), (3, "p4"), (3, "p2")], "centroid int, member string")
    got = {(r["centroid"], r["a"], r["b"]): r for r in O.pair_details(members, notes, closed, ic).collect()}
    assert set(got) == {(1, "p1", "p3"), (1, "p3", "p1"), (3, "p4", "p2"), (3, "p2", "p4")}
    assert got[1, "p1", "p3"]["terms_a"] == "d,f" and got[1, "p1", "p3"]["sim22"] == pytest.approx(1)
    spec = {r["term"]: r["specificity"] for r in O.specificity(closed).collect()}
    loss = O.specificity_loss(spark.createDataFrame([(3, "p4"), (3, "p2")], "centroid int, member string"), notes, closed).first()
    assert loss["n"] == 2 and loss["mean_loss"] == pytest.approx((spec["e"] - spec["c"]) / 2)
    r = O.report(spark.createDataFrame([(0.1 * i,) for i in range(1, 9)], "s double"), "s").first()
    assert (r["n"], r["p25"], r["p10"]) == (8, pytest.approx(0.2), pytest.approx(0.1)) and r["mean"] == pytest.approx(0.45)


def test_percentiles_of_keys_and_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice((None, rng.randrange(50), rng.random()))) for _ in range(3000)] + [("c", None)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows], "k string, v double").repartition(5)
    for keys in (["k"], None):
        want = {}
        for k in "ab" if keys else [None]:
            own = sorted(float(v) for x, v in rows if v is not None and k in (x, None))
            want |= {(k, p): own[(len(own) - 1) * p // 100] for p in (0, 10, 50, 100)}
        got = M.floor_percentile(df, "v", [0, 10, 50, 100], keys).collect()
        assert {(r["k"] if keys else None, r["percent"]): r["value"] for r in got} == want


def test_scores_without_a_bin_are_errors(spark):
    fine = spark.createDataFrame([(0.1,), (1.0,), (None,)], "s double")
    assert [r["n"] for r in M.decile_cdf(fine, "s").collect()] == [1, *[0] * 8, 1]
    for bad in (0.0, 1.5, -1.0):
        with pytest.raises(Exception, match="outside"):
            M.decile_cdf(spark.createDataFrame([(bad,)], "s double"), "s").collect()
