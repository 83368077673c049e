"""Scalar functions of sequences as columns; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE, MODULUS = 48271, 2**31 - 1
#: Letters of a class become its first letter.
CLASSES = {10: ("DENQ", "FWY", "ILMV", "KR", "ST"), 15: ("FY", "ILMV", "KR")}
# Three-letter codes of residues.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}
EPSILON = 1e-9


def reduced(seq: Column, size: int) -> Column:
    """seq in an alphabet of 10 or 15 letters; other sizes leave it."""
    pairs = [(c, group[0]) for group in CLASSES.get(size, ()) for c in group[1:]]
    return F.translate(seq, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else seq


def codes(seq: Column) -> Column:
    """The code points of a sequence as longs, in one pass over it."""
    return F.transform(F.array_remove(F.split(seq, ""), ""), lambda c: F.ascii(c).cast("long"))


def poly_hash(at, k: int) -> Column:
    """The polynomial hash of k codes, at(i) the i-th: h = (h * BASE + code) mod MODULUS."""
    h = at(0) % MODULUS
    for i in range(1, k):
        h = (h * BASE + at(i)) % MODULUS
    return h


def poly_hash_of(seq: Column) -> Column:
    """The polynomial hash of a whole string."""
    return F.aggregate(codes(seq), F.lit(0).cast("long"), lambda h, c: (h * BASE + c) % MODULUS)


def length_ok(src_len: Column, snk_len: Column, perc_src: int, perc_snk: int) -> Column:
    """Whether the lengths of a source and a member are close enough."""
    return (src_len * perc_src <= snk_len * 100) & (snk_len * perc_snk <= src_len * 100)


def max_edit_distance(snk_len: Column, sim_base: int, sim_perc: int, sim_diff: int = 0) -> Column:
    """The most edits with which a member counts as covered; -1 where none would do."""
    part = snk_len * ((sim_perc - sim_diff) / 100)
    most = (snk_len - F.ceil((1 - EPSILON) * F.sqrt(F.lit(float(sim_base**2)) + part * part))).cast("int")
    return F.when(most < 0, -1).otherwise(most)


def percent_similarity(snk_len: Column, distance: Column) -> Column:
    return F.floor((snk_len - distance) * 100 / snk_len).cast("int")


def z_value(snk_len: Column, distance: Column, match_probability: Column) -> Column:
    """How many standard deviations the matches are above what chance gives; null where all letters are equal."""
    p = match_probability
    return F.when(p < 1, ((snk_len - distance) - snk_len * p) / F.sqrt(snk_len * p * (1 - p)))


def z_similarity(z: Column) -> Column:
    """At most 200; null where there is no z-value."""
    return F.when(z.isNotNull(), F.least(F.lit(200), 100 + F.floor(z)).cast("int"))


def normalised_words(shared: Column, src_len: Column, snk_len: Column, k: int) -> Column:
    """Shared words scaled to the source's length, at most its number of words."""
    return F.least(src_len - k + 1, F.floor(shared * src_len / snk_len))


def signature_size(length: Column, k: int) -> Column:
    return F.least(F.greatest(F.lit(32), F.floor(length / 8)), length - k + 1)


def log_bin(size: Column) -> Column:
    return F.floor(10 * F.ln(size + 1 + EPSILON)).cast("int")


def decile(score: Column) -> Column:
    return (F.ceil(score * 10) - 1).cast("int")


def family(name: Column) -> Column:
    return F.split_part(name, F.lit("@"), F.lit(1))


def information_content(freq: Column, total: Column) -> Column:
    return -F.ln(freq / total)


def structural_specificity(n_descendants: Column, n_ancestors: Column) -> Column:
    """0 for a term without ancestors and descendants but itself, else 1 - (n_off - 1) / (n_off + n_anc - 2)."""
    rest = n_descendants + n_ancestors - 2
    return F.when(rest == 0, F.lit(0.0)).otherwise(1 - (n_descendants - 1) / rest)


def residue(code: Column) -> Column:
    """One letter of a three-letter residue code, X if it is unknown."""
    known = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.upper(F.trim(code))), F.lit("X"))


def sketch(hashes: Column, size: int = 32) -> Column:
    """The `size` largest hashes, cut to 16 bits, in descending order."""
    return F.sort_array(F.transform(F.slice(F.sort_array(hashes, asc=False), 1, size), lambda h: h % 65536), asc=False)


def kclust_score(identity: Column) -> Column:
    """The score per column that stands for a sequence identity in percent. Its two numbers are fixed values."""
    return F.round(F.lit(-0.68506329113924050632) + identity * 0.06025316455696202531, 2)
