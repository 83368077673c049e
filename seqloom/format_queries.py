"""Registered queries of readers, writers and reports, and their SQL.

Those of formats write a table in the format, in shared storage, and read it again; each row of the
table makes records of its own, so that no group is gathered to write one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions import columns as C
from seqloom.operators import metrics, ontology, storage
from seqloom.queries import _BMA, _EDGES, _ONT, _PART_PARAMS, _ontology, _part_edges, part_names, query, table
from seqloom.sources import readers, writers


def _place(spark, name: str) -> str:
    return f"{storage.folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(lines, name: str, codec: str | None = None) -> str:
    """The folder that a column of text is written to, a value a line or, if it has line ends, several."""
    path = _place(lines.sparkSession, name)
    lines.write.text(path, compression=codec)
    return path


def _document(lines, name: str, tag: str) -> str:
    """The file that a column of a few elements is written to as one XML document, below this tag."""
    spark = lines.sparkSession
    mark = lambda x: spark.range(1).select(F.lit(x))
    return _written(mark(f"<{tag}>").unionAll(lines).unionAll(mark(f"</{tag}>")).coalesce(1), name)


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", " ", "").alias("one"), F.translate("p_type", " ", "").alias("two"), F.translate("p_brand", " #", "").alias("brand"))


_P = "p AS (SELECT p_partkey, translate(p_name, ' ', '') AS one, translate(p_type, ' ', '') AS two, translate(p_brand, ' #', '') AS brand FROM part)"


@query(f"WITH {_P} SELECT 'p' || p_partkey AS name, brand AS comment, one AS seq FROM p")
def fasta_gzip(spark, sf_dir):
    p = _parts(spark, sf_dir)
    lines = p.select(writers.fasta_text(F.concat(F.lit("p"), "p_partkey"), F.col("brand"), F.col("one")))
    return readers.fasta(spark, _written(lines, "fasta-gzip", "gzip"))


@query(f"""WITH {_P} SELECT 'F' || p_partkey AS family, 'A' || p_partkey || '.1' AS accession, m AS member, 'F' || p_partkey || '@' || m AS name, seq FROM
(SELECT p_partkey, 'm1/1-9' AS m, one AS seq FROM p UNION ALL SELECT p_partkey, 'm2', two FROM p)""")
def stockholm_read(spark, sf_dir):
    p = _parts(spark, sf_dir)
    rest = "\n#=GC SS  ..\nm1/1-9   .-%s..\nm2  %s\n//"
    lines = p.select(F.format_string("# STOCKHOLM 1.0\n#=GF ID   F%d\n#=GF AC   A%d.1\n" + rest, "p_partkey", "p_partkey", "one", "two"))
    return readers.stockholm(spark, _written(lines, "stockholm"))


@query(f"""WITH {_P} SELECT 'c' || p_partkey AS centroid, 'c' || p_partkey AS member, 100.0::DOUBLE AS identity FROM p
UNION ALL SELECT 'c' || p_partkey, 'm' || p_partkey, (90 + p_partkey % 10)::DOUBLE FROM p""")
def clstr_read(spark, sf_dir):
    p = _parts(spark, sf_dir)
    lines = p.select(F.format_string(">Cluster %d\n0\t9aa, >m%d... at 9%d.00%%\n1\t9aa, >c%d... *", "p_partkey", "p_partkey", F.col("p_partkey") % 10, "p_partkey"))
    return readers.clstr(spark, _written(lines, "clstr"))


@query(f"""WITH {_P} SELECT 'c' || p_partkey AS centroid, 'c' || p_partkey AS member, 100.0::DOUBLE AS identity FROM p
UNION ALL SELECT 'c' || p_partkey, 'm' || p_partkey, (90 + p_partkey % 10)::DOUBLE FROM p""")
def uc_read(spark, sf_dir):
    p = _parts(spark, sf_dir)
    lines = p.select(F.format_string("S\t0\t9\t*\t*\t*\t*\t*\tc%d\t*\nH\t0\t9\t9%d.0\t+\t0\t0\t9M\tm%d\tc%d\nC\t0\t2\t*\t*\t*\t*\t*\tc%d\t*", "p_partkey", F.col("p_partkey") % 10, "p_partkey", "p_partkey", "p_partkey"))
    return readers.uc(spark, _written(lines, "uc"))


@query(f"WITH {_EDGES} SELECT src + 1 AS src, dst + 1 AS dst, sim FROM e")
def adjacency_roundtrip(spark, sf_dir):
    """The covers graph as an adjacency list in a folder of files, read again."""
    edges, path = storage.kept(_part_edges(spark, sf_dir), "edges"), _place(spark, "adjacency")
    writers.adjacency(edges, part_names(spark, sf_dir).count(), path)
    return readers.adjacency(spark, path)


_FAMILIES = "f AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand) - 1 AS centroid, p_partkey - 1 AS member, p_size AS sim, 'p' || p_partkey AS name, p_type AS comment FROM part)"


def _families(spark, sf_dir):
    """Parts as members of their brand's first part, with their size as similarity."""
    p = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") - 1).alias("member"), F.col("p_size").cast("int").alias("sim"), F.concat(F.lit("p"), "p_partkey").alias("name"), F.col("p_type").alias("comment"))
    first = p.groupBy("p_brand").agg(F.min("member").alias("centroid"))
    return p.join(first, "p_brand").select("centroid", "member", "sim", "name", "comment")


@query(f"WITH {_FAMILIES} SELECT (centroid + 1)::BIGINT AS centroid, (member + 1)::BIGINT AS member, sim::INT AS sim FROM f")
def assignment_roundtrip(spark, sf_dir):
    path = _place(spark, "assignment")
    writers.assignment(_families(spark, sf_dir), path)
    return readers.ordinals(spark, path)


@query(f"WITH {_FAMILIES} SELECT 'p' || (centroid + 1) AS centroid, 'p' || (member + 1) AS member, sim::INT AS sim FROM f")
def named_clusters_roundtrip(spark, sf_dir):
    path = _place(spark, "clusters")
    rows = _families(spark, sf_dir).select(F.concat(F.lit("UniRef100_p"), (F.col("centroid") + 1).cast("string")).alias("centroid"), F.concat(F.lit("UniRef100_"), "name").alias("member"), "sim", "comment")
    writers.named_clusters(rows, path)
    return readers.clusters(spark, path)


@query(f"""WITH {_FAMILIES}, c AS (SELECT DISTINCT centroid FROM f) SELECT m.name, translate(m.comment, ' ', '') AS comment, m.comment AS seq FROM f m JOIN c ON c.centroid = m.member""")
def centroid_sequences(spark, sf_dir):
    f = _families(spark, sf_dir)
    seqs = f.select(F.col("member").alias("seq_id"), "name", F.translate("comment", " ", "").alias("comment"), F.col("comment").alias("seq"))
    return writers.centroids(seqs, f).select("name", "comment", "seq")


@query("SELECT 'a' || p_partkey AS id1, 'b' || p_partkey AS id2, p_retailprice::DOUBLE AS tm1, p_size::DOUBLE AS tm2 FROM part UNION ALL SELECT 'c' || p_partkey, 'd' || p_partkey, p_size::DOUBLE, p_retailprice::DOUBLE FROM part")
def memo_roundtrip(spark, sf_dir):
    """A memo table of pairs that rows are added to twice."""
    p, path = table(spark, sf_dir, "part"), _place(spark, "memo")
    name = lambda x: F.concat(F.lit(x), F.col("p_partkey").cast("string"))
    one, two = F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")
    writers.memo(p.select(name("a").alias("id1"), name("b").alias("id2"), one.alias("tm1"), two.alias("tm2")), path)
    writers.memo(p.select(name("c").alias("id1"), name("d").alias("id2"), two.alias("tm1"), one.alias("tm2")), path)
    return readers.memo(spark, path)


@query("SELECT 'G' || n_nationkey AS id, 'H' || n_nationkey AS alt, n_nationkey % 3 = 0 AS obsolete, n_name AS namespace, 'R' || n_regionkey AS parent FROM nation")
def ontology_read(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    gone = F.when(F.col("n_nationkey") % 3 == 0, "<is_obsolete>1</is_obsolete>").otherwise("")
    lines = n.select(F.format_string("<term><id>G%d</id><alt_id>H%d</alt_id>%s<namespace>%s</namespace><is_a>R%d</is_a></term>", "n_nationkey", "n_nationkey", gone, "n_name", "n_regionkey"))
    got = readers.ontology(spark, _document(lines, "ontology", "obo"))
    return got.select("id", F.get("alt_ids", F.lit(0)).alias("alt"), "obsolete", "namespace", F.get("is_a", F.lit(0)).alias("parent"))


_EVIDENCE = "CASE c_custkey % 3 WHEN 0 THEN 'IDA' WHEN 1 THEN 'IEA' ELSE 'TAS' END"


def _annotations(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    evidence = F.when(F.col("c_custkey") % 3 == 0, "IDA").when(F.col("c_custkey") % 3 == 1, "IEA").otherwise("TAS")
    lines = c.select(F.format_string("ID   X\nAC   A%d; B%d;\nAC   C%d;\nDR   GO; N%d; F:some; %s:x.\nDR   PDB; 1ABC.\n//", "c_custkey", "c_custkey", "c_custkey", "c_nationkey", evidence))
    return readers.annotations(spark, _written(lines, "annotations"))


@query(f"SELECT 'A' || c_custkey AS acc, 'N' || c_nationkey AS term, 'F' AS aspect, {_EVIDENCE} AS evidence FROM customer")
def annotations_read(spark, sf_dir):
    return _annotations(spark, sf_dir)


@query(f"SELECT 'A' || c_custkey AS acc, 'N' || c_nationkey AS term, {_EVIDENCE} AS evidence FROM customer WHERE {_EVIDENCE} IN ('IDA', 'TAS')")
def experimental_annotations(spark, sf_dir):
    return ontology.experimental(_annotations(spark, sf_dir), ontology.CHALLENGE).select("acc", "term", "evidence")


@query("""SELECT 'U' || n_nationkey AS name, n_name || ' n=' || n_nationkey || ' Tax=T' || n_regionkey || ' TaxID=' || n_regionkey || ' RepID=R' || n_nationkey AS comment, translate(n_name, '_ ', '') || 'MK' AS seq FROM nation""")
def uniref_read(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    prop = '<property type="%s" value="%s"/>'
    text = '<entry id="U%d"><name>Cluster: %s</name>' + prop % ("member count", "%d") + prop % ("common taxon", "T%d") + prop % ("common taxon ID", "%d")
    text += '<representativeMember><dbReference id="R%d" type="x">' + prop % ("y", "z") + "</dbReference><sequence>%s\n MK</sequence></representativeMember></entry>"
    lines = n.select(F.format_string(text, "n_nationkey", "n_name", "n_nationkey", "n_regionkey", "n_regionkey", "n_nationkey", F.translate("n_name", "_ ", "")))
    return readers.uniref(spark, _document(lines, "uniref", "UniRef100"))


_SIMS = "s AS (SELECT l_suppkey AS centroid, l_partkey AS a, l_partkey + l_linenumber - 1 AS b, l_discount AS sim22 FROM lineitem)"


def _sims(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("centroid"), F.col("l_partkey").alias("a"), (F.col("l_partkey") + F.col("l_linenumber") - 1).alias("b"), F.col("l_discount").alias("sim22"))


@query(f"WITH {_SIMS} SELECT centroid, a, round(avg(sim22), 9) AS mean FROM s WHERE a <> b GROUP BY 1, 2")
def link_means(spark, sf_dir):
    return ontology.link_means(_sims(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query(f"WITH {_SIMS} SELECT centroid, count(DISTINCT a)::BIGINT AS members, round(avg(sim22), 9) AS mean, (count(DISTINCT a) - 1)::BIGINT AS weight FROM s WHERE a <> b GROUP BY 1")
def cluster_means(spark, sf_dir):
    return ontology.cluster_means(_sims(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query("""WITH v AS (SELECT list_sort(list(l_extendedprice)) AS v, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem)
SELECT n::BIGINT AS n, round(s / (1e-9 + n), 3) AS mean, v[((n - 1) * 25 // 100) + 1] AS p25, v[((n - 1) * 10 // 100) + 1] AS p10 FROM v""")
def similarity_report(spark, sf_dir):
    return ontology.report(table(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("mean", F.round("mean", 3))


@query("SELECT l_partkey AS member, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def repeated_members(spark, sf_dir):
    return metrics.repeated_members(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("cluster")))


@query("SELECT a.n_regionkey AS centroid, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def member_pairs(spark, sf_dir):
    return metrics.member_pairs(table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("centroid"), F.col("n_name").alias("member")))


@query(f"WITH {_ONT} SELECT acc, term FROM note JOIN ic USING (term) WHERE freq >= 50")
def reliable_annotations(spark, sf_dir):
    notes, _, _, ic = _ontology(spark, sf_dir)
    return ontology.reliable(notes, ic, 50).select("acc", "term")


@query(f"""{"WITH " + _BMA}, x AS (SELECT a, b, sum(m) / count(*) AS sim22 FROM best GROUP BY a, b), t AS (SELECT acc, string_agg(term, ',' ORDER BY term) AS terms FROM own GROUP BY acc)
SELECT 0 AS centroid, a, b, round(sim22, 9) AS sim22, p.terms AS terms_a, q.terms AS terms_b FROM x JOIN t p ON p.acc = a JOIN t q ON q.acc = b WHERE a <> b""")
def pair_details(spark, sf_dir):
    """Regions, annotated with their nations, as the members of one cluster."""
    notes, _, closed, ic = _ontology(spark, sf_dir)
    own = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("acc"), F.concat(F.lit("N"), "n_nationkey").alias("term")).join(notes.select("term").distinct(), "term", "left_semi")
    members = own.select(F.lit(0).alias("centroid"), F.col("acc").alias("member")).distinct()
    return ontology.pair_details(members, own, closed, ic).withColumn("sim22", F.round("sim22", 9))


@query("""SELECT p_partkey, floor(10 * ln(p_size + 1 + 1e-9))::INT AS log_bin, least(greatest(32, p_size // 8), p_size - 2)::BIGINT AS signature, round((-0.68506329113924050632)::DOUBLE + p_size * 0.06025316455696202531::DOUBLE, 2) AS score,
  (p_size * 50 <= p_partkey * 100 AND p_partkey * 80 <= p_size * 100) AS close FROM part""")
def scalar_functions(spark, sf_dir):
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select("p_partkey", C.log_bin(size).alias("log_bin"), C.signature_size(size, 3).cast("long").alias("signature"), C.kclust_score(size).alias("score"), C.length_ok(size, F.col("p_partkey"), 50, 80).alias("close"))


@query()
def cluster_part_names_greedy(spark, sf_dir):
    """First come, first served, longest first, with the parameters of similarity_edges."""
    from seqloom.plans import cluster

    return cluster.greedy(part_names(spark, sf_dir), _PART_PARAMS)


@query(f"WITH {_P} SELECT 'p' || p_partkey AS name, brand || ' x' AS comment, one AS seq FROM p")
def fastq_blocks(spark, sf_dir):
    """Parts as FASTQ records, whose qualities begin with marks of records, in a file that is read in blocks of 16 KB."""
    p = _parts(spark, sf_dir)
    quality = F.concat(F.when(F.col("p_partkey") % 3 == 0, "@").when(F.col("p_partkey") % 3 == 1, ">").otherwise("+"), F.repeat(F.lit("I"), F.length("one") - 1))
    lines = p.select(F.concat(F.lit("@p"), F.col("p_partkey").cast("string"), F.lit(" "), "brand", F.lit(" x\n"), "one", F.lit("\n+\n"), quality))
    path = _place(spark, "fastq")
    lines.coalesce(1).write.text(path)  # one file, so that blocks have borders
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("16k", "0"), strict=True):
            spark.conf.set(n, v)
        return readers.fastq(spark, path)
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


_SWEEP = f"""WITH RECURSIVE {_EDGES}, cut AS (SELECT unnest([60, 75, 90]) AS c),
ce AS (SELECT c, src, dst, sim FROM (SELECT c, m.src, m.dst, m.len, x.len AS own, d, ((m.len - d) * 100 // m.len)::INT AS sim FROM m JOIN n x ON x.id = m.src, cut)
  WHERE len * c <= own * 100 AND d <= len - ceil((1 - 1e-9) * sqrt(25 + (len * (c / 100)) * (len * (c / 100)))) AND sim >= c UNION ALL SELECT c, id, id, 100 FROM n, cut),
cov(c, src, dst, size) AS (SELECT DISTINCT c, src, dst, 0::BIGINT FROM ce UNION ALL
  (WITH l AS (SELECT c, src, dst FROM cov WHERE size = 0), s AS (SELECT c, src, count(*) AS n FROM l GROUP BY c, src), pick AS (SELECT c, src, n FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY n DESC, src) = 1),
   gone AS (SELECT l.c, l.dst FROM l JOIN pick USING (c, src))
   SELECT l.c, l.src, l.dst, 0::BIGINT FROM l LEFT JOIN gone ON gone.c = l.c AND gone.dst = l.dst WHERE gone.c IS NULL UNION ALL SELECT c, src, -1, n FROM pick))
SELECT c AS cutoff, src AS centroid, dst AS member, sim FROM ce JOIN (SELECT c, src FROM cov WHERE size > 0) USING (c, src) QUALIFY row_number() OVER (PARTITION BY c, dst ORDER BY sim DESC, src) = 1"""


@query(_SWEEP)
def cutoff_sweep(spark, sf_dir):
    """Part names clustered at three cutoffs, from one search."""
    from seqloom.plans import cluster

    return cluster.swept(part_names(spark, sf_dir), [60, 75, 90], _PART_PARAMS)


@query(f"""WITH {_FAMILIES}, g AS (SELECT centroid, string_agg(name, chr(9) ORDER BY member) AS names FROM f GROUP BY centroid)
SELECT m.member AS seq_id, '>' || m.name || chr(9) || g.names || chr(10) || m.comment AS value FROM g JOIN f m ON m.member = g.centroid""")
def centroid_headers(spark, sf_dir):
    f = _families(spark, sf_dir)
    return writers.centroid_fasta_lines(f.select(F.col("member").alias("seq_id"), "name", F.col("comment").alias("seq")), f)


_CODES = ["ALA", "arg", "ASN", "ASP", "CYS", "GLN", "GLU", "Gly", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", " VAL", "MSE", ""]


@query(f"SELECT p_partkey, {_CODES}[p_partkey % 22 + 1] AS code, substr('ARNDCQEGHILKMFPSTWYVXX', (p_partkey % 22 + 1)::BIGINT, 1) AS letter FROM part")
def residue_letters(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(x) for x in _CODES]), (F.col("p_partkey") % 22 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), C.residue(code).alias("letter"))


_KEPT = """k AS (SELECT c_custkey AS member, 'N' || c_nationkey AS term, CASE WHEN c_custkey % 2 = 0 THEN n_regionkey ELSE 100 + c_nationkey END AS centroid FROM customer JOIN nation ON n_nationkey = c_nationkey),
t AS (SELECT DISTINCT centroid, term FROM k), z AS (SELECT centroid, count(*) AS n FROM t GROUP BY 1), a AS (SELECT centroid, anc, count(*) AS c FROM t JOIN cl USING (term) GROUP BY ALL)"""


def _kept_clusters(spark, sf_dir):
    """Customers with even keys as members of their region, others of their nation; (members, annotations, parents, closure, information)."""
    notes, parents, closed, ic = _ontology(spark, sf_dir)
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    centroid = F.when(F.col("c_custkey") % 2 == 0, F.col("n_regionkey")).otherwise(100 + F.col("c_nationkey"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(centroid.alias("centroid"), F.col("c_custkey").alias("member")), notes, parents, closed, ic  # 25 nations


@query(f"""WITH {_ONT}, {_KEPT}, top AS (SELECT a.centroid, max(ic.ic) AS ic FROM a JOIN z ON z.centroid = a.centroid AND n = c JOIN ic ON ic.term = anc WHERE ic.ic > 0 GROUP BY 1)
SELECT k.centroid, member, round(own.ic, 9) AS member_ic, round(coalesce(top.ic, 0), 9) AS cluster_ic, round(own.ic - coalesce(top.ic, 0), 9) AS loss FROM k JOIN ic own ON own.term = k.term LEFT JOIN top ON top.centroid = k.centroid""")
def information_loss(spark, sf_dir):
    members, notes, _, closed, ic = _kept_clusters(spark, sf_dir)
    found = ontology.information_loss(members, notes, closed, ic)
    return found.select("centroid", "member", *[F.round(c, 9).alias(c) for c in ("member_ic", "cluster_ic", "loss")])


@query(f"""WITH {_ONT}, {_KEPT}, top AS (SELECT a.centroid, anc FROM a JOIN z ON z.centroid = a.centroid AND n = c JOIN ic ON ic.term = anc WHERE ic.ic > 0 QUALIFY row_number() OVER (PARTITION BY a.centroid ORDER BY ic.ic DESC, anc) = 1)
SELECT t.centroid, CASE WHEN any_value(n) = 1 THEN 1 WHEN bool_and(coalesce(t.term = top.anc OR par.parent = top.anc, false)) THEN 3 ELSE 4 END AS category FROM t JOIN z USING (centroid) LEFT JOIN top ON top.centroid = t.centroid LEFT JOIN par ON par.term = t.term GROUP BY 1""")
def cluster_categories(spark, sf_dir):
    members, notes, parents, closed, ic = _kept_clusters(spark, sf_dir)
    return ontology.categories(members, notes, closed, parents, ic)


@query(f"""WITH {_ONT}, {_KEPT}, x AS (SELECT term, count(*) AS up FROM cl GROUP BY 1), y AS (SELECT anc AS term, count(*) AS off FROM cl GROUP BY 1),
sp AS (SELECT term, CASE WHEN up + off = 2 THEN 0 ELSE 1 - (off - 1) / (up + off - 2) END AS s FROM x JOIN y USING (term)),
top AS (SELECT a.centroid, max(s) AS s FROM a JOIN z ON z.centroid = a.centroid AND n = c JOIN sp ON sp.term = anc WHERE s > 0 GROUP BY 1),
own AS (SELECT cl.term, max(s) AS s FROM cl JOIN sp ON sp.term = cl.anc GROUP BY 1)
SELECT count(*)::BIGINT AS n, round(avg(own.s - coalesce(top.s, 0)), 9) AS mean_loss FROM k JOIN own ON own.term = k.term LEFT JOIN top ON top.centroid = k.centroid""")
def specificity_loss(spark, sf_dir):
    members, notes, _, closed, _ = _kept_clusters(spark, sf_dir)
    return ontology.specificity_loss(members, notes, closed).withColumn("mean_loss", F.round("mean_loss", 9))
