import gzip
import random

import pytest
from pyspark.sql import functions as F

from seqloom.sources import readers as R
from seqloom.sources import writers as W


def put(path, text):
    path.write_text(text)
    return str(path)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


FASTA = ">a c1 d\nACGT\nAC\n>b\nGG\n"


def test_fasta(spark, tmp_path):
    assert got(R.fasta(spark, put(tmp_path / "x.fa", FASTA))) == [("a", "c1 d", "ACGTAC"), ("b", "", "GG")]
    odd = "junk line\n>a  two\r\nAC\r\n\r\nGT \n>b>c x>y\nTT>\n\n"
    assert got(R.fasta(spark, put(tmp_path / "odd.fa", odd)))[0][::2] == ("a", "ACGT")
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(FASTA)
    assert got(R.fasta(spark, str(tmp_path / "x.fa.gz"))) == [("a", "c1 d", "ACGTAC"), ("b", "", "GG")]
    assert got(R.fasta(spark, put(tmp_path / "none.fa", ""))) == []


def test_fastq(spark, tmp_path):
    text = "@r1 first\nACGT\nAC\n+r1\nII@I\n>I\n@r2\nGG\n+\n@@\n>f only\nTT\nAA\n"
    want = [("f", "only", "TTAA"), ("r1", "first", "ACGTAC"), ("r2", "", "GG")]
    assert got(R.fastq(spark, put(tmp_path / "x.fq", text))) == want
    with gzip.open(tmp_path / "x.fq.gz", "wt") as f:
        f.write(text)
    assert got(R.fastq(spark, str(tmp_path / "x.fq.gz"), put(tmp_path / "y.fa", FASTA))) == sorted([*want, ("a", "c1 d", "ACGTAC"), ("b", "", "GG")], key=str)
    assert got(R.fastq(spark, put(tmp_path / "none.fq", ""))) == []
    with pytest.raises(ValueError, match="quality"):
        list(R.fastx_records(["@r\n", "ACGT\n", "+\n", "II\n"]))


@pytest.mark.parametrize("size", [150, 2000])
def test_fastq_in_blocks(spark, tmp_path, size, monkeypatch):
    """Files are cut anywhere; qualities begin with any mark, and records are on one line or several, or longer than a block."""
    rng, want, files = random.Random(size), [], []
    for f in range(2):
        text = ""
        for i in range(25):
            n = rng.choice((1, 7, 20, 61, 400))
            seq, quality = "".join(rng.choices("ACGTN", k=n)), "".join(rng.choices("@>+I!J", k=n))
            wrap = rng.choice((1000, 1000, 60))
            fold = lambda x: "\n".join(x[a : a + wrap] for a in range(0, len(x), wrap))
            text += f"@f{f}r{i} about {i}\n{fold(seq)}\n+\n{fold(quality)}\n"
            want.append((f"f{f}r{i}", f"about {i}", seq))
        files.append(put(tmp_path / f"{f}.fq", text))
    fasta = "".join(f">a{i}\n{'MKV' * rng.randint(1, 30)}\nMK\n" for i in range(20))
    files.append(put(tmp_path / "x.fa", fasta))
    want += [(n, "", s) for n, s in ((x.split("\n")[0], "".join(x.split("\n")[1:])) for x in fasta[1:].split("\n>"))]
    monkeypatch.setattr(R, "LINES", 64)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = got(R.fastq(spark, *files))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert found == sorted(want, key=str)



def test_stockholm(spark, tmp_path):
    text = "# STOCKHOLM 1.0\n#=GF ID   FamA\n#=GF AC   PF1.2\n\ns1/1-4   AC.-GT\ns2/2-3  ..-.TT\n#=GC x  ..\n//\n# STOCKHOLM 1.0\n#=GF ID   FamB\nt1 GG\n//\n"
    assert got(R.stockholm(spark, put(tmp_path / "x.sto", text))) == [
        ("FamA", "PF1.2", "s1/1-4", "FamA@s1/1-4", "ACGT"), ("FamA", "PF1.2", "s2/2-3", "FamA@s2/2-3", "TT"), ("FamB", "PF1.2", "t1", "FamB@t1", "GG"),
    ]


def test_uniref(spark, tmp_path):
    entry = """<UniRef100><entry id="UniRef100_A"><name>Cluster: Some protein</name><property type="member count" value="3"/><property type="common taxon" value="Homo"/>
<property type="common taxon ID" value="9606"/><representativeMember><dbReference type="UniProtKB ID" id="A_HUMAN"><property type="x" value="y"/></dbReference><sequence length="4">MK
VL</sequence></representativeMember></entry><entry id="UniRef100_B"><representativeMember><dbReference id="B"/><sequence>MM</sequence></representativeMember></entry></UniRef100>"""
    assert got(R.uniref(spark, put(tmp_path / "x.xml", entry))) == [
        ("UniRef100_A", "Some protein n=3 Tax=Homo TaxID=9606 RepID=A_HUMAN", "MKVL"), ("UniRef100_B", "None n=None Tax=None TaxID=None RepID=B", "MM"),
    ]


def pdb(date, chains, mod=""):
    lines = [f"HEADER    HYDROLASE                               {date}   1ABC              "]
    if mod:
        lines.append(f"MODRES 1ABC {mod} A    1  MET  SELENOMETHIONINE")
    for c, codes in chains:
        for i in range(0, len(codes), 13):
            lines.append(f"SEQRES {i // 13 + 1:3d} {c} {len(codes):4d}  " + " ".join(codes[i : i + 13]))
    return "\n".join(lines) + "\n"


def test_pdb(spark, tmp_path):
    long = ["MSE", "GLY"] * 9
    put(tmp_path / "1abc.ent", pdb("12-MAR-05", [("A", long)], "MSE"))
    put(tmp_path / "2late.ent", pdb("02-JAN-17", [("A", long)], "MSE"))
    put(tmp_path / "3two.ent", pdb("12-MAR-05", [("A", long), ("B", long)], "MSE"))
    put(tmp_path / "4unknown.ent", pdb("12-MAR-05", [("A", long)]))
    put(tmp_path / "5short.ent", pdb("12-MAR-05", [("A", ["GLY"] * 10)]))
    assert got(R.pdb(spark, str(tmp_path / "*.ent"))) == [("1abc_A", "MG" * 9)]


def test_cluster_files(spark, tmp_path):
    text = ">Cluster 0\n0\t100aa, >m1... at 95.50%\n1\t120aa, >c1... *\n2\t99nt, >m2... at +/91.00%\n>Cluster 1\n0\t5aa, >c2... *\n"
    assert got(R.clstr(spark, put(tmp_path / "x.clstr", text))) == [("c1", "c1", 100.0), ("c1", "m1", 95.5), ("c1", "m2", 91.0), ("c2", "c2", 100.0)]
    uc = "S 0 10 * * * * * c1 *\nH 0 9 97.5 + 0 0 9M m1 c1\nC 0 2 * * * * * c1 *\n"
    assert got(R.uc(spark, put(tmp_path / "x.uc", uc))) == [("c1", "c1", 100.0), ("c1", "m1", 97.5)]
    assert got(R.clusters(spark, put(tmp_path / "c.tsv", "UniRef100_A0\tUniRef100_U1\t90\n"))) == [("A0", "U1", 90)]
    assert got(R.memo(spark, put(tmp_path / "m.tsv", "a\tb\t0.5\t0.25\n"))) == [("a", "b", 0.5, 0.25)]


def test_ontology_and_annotations(spark, tmp_path):
    xml = "<obo><term><id>GO:1</id><alt_id>GO:9</alt_id><alt_id>GO:8</alt_id><namespace>n</namespace><is_a>GO:0</is_a></term><term><id>GO:2</id><is_obsolete>1</is_obsolete><namespace>n</namespace></term></obo>"
    assert got(R.ontology(spark, put(tmp_path / "go.xml", xml))) == [("GO:1", ["GO:9", "GO:8"], False, "n", ["GO:0"]), ("GO:2", [], True, "n", [])]
    flat = "ID   X\nAC   P1; P2;\nAC   P3;\nDR   GO; GO:1; F:binding; IDA:UniProtKB.\nDR   PDB; 1ABC.\nDR   GO; GO:2; P:x; IEA:InterPro.\n//\nAC   Q1;\nDR   GO; GO:1; C:y; EXP:X.\n//\n"
    assert got(R.annotations(spark, put(tmp_path / "sp.dat", flat))) == [("P1", "GO:1", "F", "IDA"), ("P1", "GO:2", "P", "IEA"), ("Q1", "GO:1", "C", "EXP")]


def test_written_and_read_again(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "a", "x y", "ACGT"), (1, "b", "", "GG"), (2, "c", "", "GGG")], "seq_id long, name string, comment string, seq string")
    W.fasta(seqs, str(tmp_path / "f"), [F.col("seq_id")], one_file=True)
    assert got(R.fasta(spark, str(tmp_path / "f"))) == [("a", "x y", "ACGT"), ("b", "", "GG"), ("c", "", "GGG")]
    assert next((tmp_path / "f").glob("part*")).read_text() == ">a x y\nACGT\n>b \nGG\n>c \nGGG\n"
    edges = spark.createDataFrame([(0, 0, 100), (0, 2, 91), (0, 1, 95), (1, 1, 100), (2, 2, 100)], "src long, dst long, sim int")
    W.adjacency(edges, 3, str(tmp_path / "adj"))
    text = next((tmp_path / "adj").glob("part*")).read_text()
    assert text == "3 3\n100 1 95 2 91 3\n100 2\n100 3\n"
    assert got(R.adjacency(spark, str(tmp_path / "adj"))) == [(1, 1, 100), (1, 2, 95), (1, 3, 91), (2, 2, 100), (3, 3, 100)]
    clusters = spark.createDataFrame([(0, 0, 100), (0, 1, 95), (2, 2, 100)], "centroid long, member long, sim int")
    W.assignment(clusters, str(tmp_path / "as"), one_file=True)
    assert got(R.ordinals(spark, str(tmp_path / "as"))) == [(1, 1, 100), (1, 2, 95), (3, 3, 100)]
    assert [r["name"] for r in W.centroids(seqs, clusters).collect()] == ["a", "c"]
    W.centroid_fasta(seqs, clusters, str(tmp_path / "cf"), one_file=True)
    assert next((tmp_path / "cf").glob("part*")).read_text() == ">a\tx y\nACGT\n>c\t\nGGG\n"
    assert [r["value"] for r in W.centroid_fasta_lines(seqs, clusters).orderBy("seq_id").collect()] == [">a\ta\tb\nACGT", ">c\tc\nGGG"]
    from seqloom.plans.cluster import named

    W.named_clusters(named(clusters, seqs), str(tmp_path / "n"), one_file=True)
    lines = next((tmp_path / "n").glob("part*")).read_text().splitlines()
    assert sorted(lines) == ["a\ta\t100\tx y", "a\tb\t95\t", "c\tc\t100\t"]
    rows = spark.createDataFrame([("a", "b", 0.5, 0.25)], "id1 string, id2 string, tm1 double, tm2 double")
    assert W.memo(rows, str(tmp_path / "memo")) and not W.memo(rows, str(tmp_path / "memo"))
    W.memo(rows.selectExpr("'c' AS id1", "'d' AS id2", "tm1", "tm2"), str(tmp_path / "memo"))
    assert got(R.memo(spark, str(tmp_path / "memo"))) == [("a", "b", 0.5, 0.25), ("c", "d", 0.5, 0.25)]
    assert spark.createDataFrame([(3, 0.5)], "a int, b double").select(W.metric_line("X: ", "a", "b")).first()[0] == "X: 3 & 0.5"


def test_records_that_go_over_blocks(spark, tmp_path):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        families = "".join(f"# STOCKHOLM 1.0\n#=GF ID   F{f}\n#=GF AC   P{f}.1\n" + "".join(f"m{i}/1-9   AC.D{'EFGH'[i % 4]}-\n" for i in range(9)) + "//\n" for f in range(7))
        for text in (families, families.replace("\n", "\r\n")):
            rows = got(R.stockholm(spark, put(tmp_path / "s.sto", text)))
            assert rows == sorted([(f"F{f}", f"P{f}.1", f"m{i}/1-9", f"F{f}@m{i}/1-9", "ACD" + "EFGH"[i % 4]) for f in range(7) for i in range(9)], key=str)
        clusters = "".join(f">Cluster {c}\n" + "".join(f"{i}\t10aa, >c{c}m{i}... {'*' if i == c % 5 else 'at 9' + str(i) + '%'}\n" for i in range(5)) for c in range(8))
        rows = got(R.clstr(spark, put(tmp_path / "x.clstr", clusters)))
        assert rows == sorted([(f"c{c}m{c % 5}", f"c{c}m{i}", 100.0 if i == c % 5 else float(f"9{i}")) for c in range(8) for i in range(5)], key=str)
        records = "".join(f"ID   X{r}\nAC   A{r}; B{r};\nAC   C{r};\nDR   GO; GO:000{r}; F:some; IEA:x.\n//\n" for r in range(9))
        for text in (records, records.replace("\n", "\r\n")):
            assert [x[:3] for x in got(R.annotations(spark, put(tmp_path / "u.dat", text)))] == [(f"A{r}", f"GO:000{r}", "F") for r in range(9)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_list_in_several_files(spark, tmp_path):
    edges = spark.createDataFrame([(s, d, 50 + d) for s in range(30) for d in range(s, 30, 7)], "src long, dst long, sim int")
    W.adjacency(edges, 30, str(tmp_path / "list"))
    want = sorted([(s + 1, d + 1, 50 + d if s != d else 100) for s in range(30) for d in range(s, 30, 7)], key=str)
    assert got(R.adjacency(spark, str(tmp_path / "list"))) == want


def test_memo_is_added_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "memo")
    rows = spark.createDataFrame([(f"a{i}", f"b{i}", i / 7, 1.0) for i in range(50)], "id1 string, id2 string, tm1 double, tm2 double")
    with monkeypatch.context() as m:  # the job ends between writing and renaming
        m.setattr(W, "_committed", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            W.memo(rows.limit(30), path)
    (tmp_path / "memo" / "run=broken").mkdir()
    assert R.memo(spark, path).count() == 0
    assert W.memo(rows.limit(30), path) and R.memo(spark, path).count() == 30
    assert not W.memo(rows.limit(30).repartition(5), path) and R.memo(spark, path).count() == 30
    assert W.memo(rows.filter("id1 > 'a5'"), path, run="second") and not W.memo(rows, path, run="second")
    assert W.memo(rows.limit(0), path) and R.memo(spark, path).count() == 30 + rows.filter("id1 > 'a5'").count()


def test_ordinals_from_zero(spark, tmp_path):
    path = put(tmp_path / "o.tsv", "3\t2\t90\n1\t1\t100\n0\t0\t80\n2\t1\t70\n")
    assert got(R.ordinals(spark, path, either=True)) == [(1, 1, 100), (1, 1, 80), (3, 2, 70), (3, 2, 90)]
    assert got(R.ordinals(spark, put(tmp_path / "one.tsv", "1\t2\t90\n"), either=True)) == [(1, 2, 90)]
