import hashlib
import random
import re

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from seqloom.llm import infill
from seqloom.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


def brute(doc, text, rate=100, first=50):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(seed, count, most):
    rng = random.Random(seed)
    parts = ["\n", "\n\n", "a", "é", "東京", "😀", "<", "<P", ">", "P>", "<<S", "word ", "x" * 40]
    return ["".join(rng.choices(parts + ["<M>"] * (i % 7 == 0), k=rng.randint(0, most))) for i in range(count)]


@pytest.mark.parametrize("chunk", [1, 3, 64, 1 << 16])
def test_chunks_equal_brute_force(spark, docs, chunk):
    rows = list(enumerate(texts(chunk, 60, 40))) + [(None, "a\nb\nc"), (None, None), (70, ""), (71, None), (3, "again\nx\n"), (3, "again\nx\n"), (72, "é" * 5000 + "\n" + "<" * 300 + "\n"), (73, "no\nlines <P"), (74, "\n" * 200)]
    table = docs(rows).selectExpr("*", "lang as n", "lang as form", "lang as chunk", "lang as raw", "lang as text_hash", "lang as d0")
    found = infill.transformed(table, chunk=chunk).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=str)
    assert got == sorted(((d, t or "", *brute(d, t)) for d, t in rows), key=str)
    assert all(r["back"] == r["text"] for r in found) and {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_rates(spark, docs):
    rows = [(i, "a\nb\nc\n") for i in range(60)]
    found = infill.transformed(docs(rows), rate=50, suffix_first=20).collect()
    assert {(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found} == {(d, *brute(d, t, 50, 20)) for d, t in rows}


def test_composing_is_reading_on():
    machine = infill.Automaton()
    for text in texts(5, 40, 60):
        raw = np.frombuffer(text.encode(), np.uint8)
        whole = machine.function(raw)
        parts = [machine.function(raw[i : i + 5]) for i in range(0, len(raw), 5)] or [machine.function(raw)]
        ends, units = infill.resolved(np.array([x for x, _ in parts]), np.array([x for _, x in parts]))
        assert (ends[-1], units[-1]) == (whole[0][0], whole[1][0])
        state, n = 0, 0
        for c in raw:  # one step after another
            n += machine.begins[state]
            state = int(machine.ends[machine.classes[c], state])
        assert (state, n) == (whole[0][0], whole[1][0]) and (state >= machine.found) == any(x in text for x in infill.MARKERS)


def test_other_markers():
    machine = infill.Automaton(("aab", "ab\n", "b"))
    for text in ("aaab", "aa", "xa\nb", "aac\n", "ab\n", "b\n", "a"):
        got = machine.function(np.frombuffer(text.encode(), np.uint8))
        assert (got[0][0] >= machine.found) == any(x in text for x in ("aab", "ab\n", "b")) and got[1][0] == len(re.findall(r"[^\n]*\n|[^\n]+", text))


def test_empty(docs):
    found = infill.transformed(docs([]))
    assert found.collect() == [] and found.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_query_equals_sql(spark):
    same(spark, QUERIES["op12_infill"], ORACLE_SQL["op12_infill"], D)
