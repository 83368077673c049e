import random

from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.functions import distance as D
from seqloom.plans.params import DNA, PROTEIN, RNA, Params, buckets


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["x"])
    return row.select(col.alias("r")).first()["r"]


def test_alphabet_and_hash(spark):
    assert one(spark, C.reduced(F.col("s"), 10), s="DENQFWYILMVKRST") == "DDDDFFFIIIIKKSS"
    assert one(spark, C.reduced(F.col("s"), 15), s="FYILMVKR") == "FFIIIIKK"
    assert one(spark, C.reduced(F.col("s"), 20), s="FYILMVKR") == "FYILMVKR"
    assert one(spark, C.poly_hash_of(F.col("s")), s="ABC") == 1135144328


def test_cutoffs(spark):
    p = Params().derived()
    most = lambda n: one(spark, C.max_edit_distance(F.col("n"), p.sim_base, p.sim_perc, p.sim_diff), n=n)
    assert (most(28), most(29)) == (-1, 0)
    assert one(spark, C.percent_similarity(F.col("n"), F.col("d")), n=4, d=1) == 75
    ok = lambda a, b: one(spark, C.length_ok(F.col("a"), F.col("b"), 80, 50), a=a, b=b)
    assert ok(100, 80) and not ok(100, 79) and ok(50, 100) and not ok(49, 100)


def test_other_functions(spark):
    deciles = [one(spark, C.decile(F.col("t")), t=t) for t in (0.5, 0.51, 1.0)]
    assert deciles == [4, 5, 9]
    assert one(spark, C.family(F.col("s")), s="PF1@a@b") == "PF1"
    assert one(spark, C.residue(F.col("s")), s="Gly") == "G" and one(spark, C.residue(F.col("s")), s="MSE") == "X"
    assert one(spark, C.structural_specificity(F.col("o"), F.col("a")), o=1, a=1) == 0.0
    assert one(spark, C.structural_specificity(F.col("o"), F.col("a")), o=1, a=4) == 1.0
    assert one(spark, C.normalised_words(F.col("w"), F.col("a"), F.col("b"), 4), w=10, a=20, b=30) == 6
    assert one(spark, C.log_bin(F.col("n")), n=0) == 0
    assert one(spark, C.signature_size(F.col("n"), 4), n=400) == 50 and one(spark, C.signature_size(F.col("n"), 4), n=20) == 17
    assert one(spark, C.z_similarity(C.z_value(F.col("n"), F.col("d"), F.col("p"))), n=100, d=0, p=0.5) == 110
    assert one(spark, C.z_value(F.col("n"), F.col("d"), F.col("p")), n=100, d=0, p=1.0) is None
    assert one(spark, C.sketch(F.col("h"), 2), h=[5, 65537, 65536]) == [1, 0]
    assert one(spark, C.kclust_score(F.col("i")), i=50) == 2.33


def test_parameters():
    want = {
        PROTEIN: (50, 25, 80, 80, 4, 0, 6, 10.0, 45, 2000),
        RNA: (70, 25, 80, 80, 7, 0, 4, 0.1, 35, 1010),
        DNA: (90, 0, 0, 90, 9, 20, 2, 0.001, 21, 1000),
    }
    for kind, values in want.items():
        p = Params(seqtype=kind).derived()
        got = (p.sim_perc, p.sim_base, p.len_perc_src, p.len_perc_snk, p.sign_length, p.sim_diff, p.cov_src_max, round(p.seed_evalue, 9), p.seed_mincnt, p.idxentry_itmax)
        assert got == values
    p = Params.from_options({"--sim-perc": "70", "--input-order": "length", "--zval-as-sim": 1}).derived()
    assert p.sim_perc == 70 and p.order == "length" and p.zval_as_sim and p.cov_src_max == 4
    assert Params(seed_mincnt=3).derived().seed_mincnt == 3
    assert 3 <= Params().derived().with_statistics(10**9, 9.0).seed_length <= 30
    assert buckets(0, 45) == 1 and buckets(100, 45) == 1500
    for bad in ({"--what": 1},):
        try:
            Params.from_options(bad)
        except ValueError:
            continue
        raise AssertionError


def table(p, t, first_row):
    rows = [first_row]
    for i, a in enumerate(p, 1):
        own = [i]
        for j, b in enumerate(t, 1):
            own.append(min(rows[-1][j] + 1, own[-1] + 1, rows[-1][j - 1] + (a != b)))
        rows.append(own)
    return rows[-1]


def test_distances_equal_the_table():
    rng = random.Random(3)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        infix = table(p, t, [0] * (len(t) + 1))
        other = table(p, t, list(range(len(t) + 1)))
        assert D.distance(p, t)[0] == min(infix)
        assert D.distance(p, t, D.PREFIX)[0] == min(other)
        assert D.distance(p, t, D.GLOBAL)[0] == other[-1]
        if p:
            assert D.distance(p, t)[1] == infix.index(min(infix)) and D.distance(p, t, D.PREFIX)[1] == other.index(min(other))
        d, start, end = D.located(p, t)
        assert D.distance(p, t[start:end], D.GLOBAL)[0] == d
        assert all(D.distance(p, t[s:end], D.GLOBAL)[0] > d for s in range(start))
        d, path = D.alignment(p, t)
        assert path.count("X") + path.count("I") + path.count("D") == d
        assert path.count("=") + path.count("X") + path.count("I") == len(p)
        for mode in (D.INFIX, D.GLOBAL, D.PREFIX):
            d, path = D.alignment(p, t, mode, kept=1500)
            assert d == D.distance(p, t, mode)[0] == path.count("X") + path.count("I") + path.count("D")
            assert path.count("=") + path.count("X") + path.count("I") == len(p)
        d = D.distance(p, t)[0]
        if d:
            assert D.distance(p, t, most=d - 1) == (-1, -1)


def test_golden_pairs():
    sim = lambda p, t: (len(p) - D.distance(p, t)[0]) * 100 // len(p)
    assert sim("ATGG", "ACGGT") == 75 and sim("ACGGT", "ATGG") == 60 and sim("AAAGGG", "AAACGGG") == 83
    assert D.cigar("===XII=", True) == "3=1X2I1=" and D.cigar("===XII=", False) == "4M2I1M"
    assert D.distance("abc", "xbd", bits=D.profile("abc", {"x": "a", "c": "d"}))[0] == 0
    # of the first best end, with C for the first G
    assert D.free_deletion_distance("AAAGGG", "AAACGGG", 6) == 1
    # text letters without a partner cost nothing
    assert D.alignment("AAAACDEF", "AAAATCDEF") == (1, "====D====") and D.free_deletion_distance("AAAACDEF", "GAAAATCDEF", 6) == 0
    assert D.free_deletion_distance("AAAGGG", "CCC", 3) == -1


def test_distance_columns(spark):
    rows = [("ATGG", "ACGGT", 4), ("ATGG", "ACGGT", 0), ("ATGG", "ACGGT", -1), (None, "A", 1), ("A", None, 1), ("", "A", 1)]
    df = spark.createDataFrame(rows, "p string, t string, k int")
    assert [r["d"] for r in D.distances(df, "p", "t", "k", "d").collect()] == [1, -1, -1, None, None, 0]
    assert df.columns == ["p", "t", "k"]
    assert D.distances(df.limit(0), "p", "t", None, "d").count() == 0
    assert df.limit(1).select(D.global_distance(F.col("p"), F.col("t")).alias("d")).first()["d"] == 2
