import hashlib
import re

from oracle import same

from seqloom.llm import decontaminate
from seqloom.llm.queries import ORACLE_SQL, QUERIES


def brute_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, items):
    w, hit, ids = brute_words(doc), set(), set()
    for i, t in items:
        b = brute_words(t)
        n = min(10, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit |= set(range(p, p + n))
                    ids.add(i)
    return len(w), len(hit), sorted(ids)


def check(spark, docs, rows, items):
    table = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, s string")
    got = decontaminate.decontaminate(docs(rows).selectExpr("*", "lang AS w", "lang AS span"), table).collect()
    want = sorted(((d, *brute(t, [x for x in items if x[0] is not None])) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"] or []) for r in got), key=str) == want
    assert all(sum(s["e"] - s["s"] for s in r["spans"] or []) == r["n_hit"] for r in got)
    kept = decontaminate.clean(docs(rows), table)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[2]), key=str)


def test_small_cases(spark, docs):
    w = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(w[:12])), (2, "Short Item"), (3, " ".join(w[20:31])), (3, "again " * 12), (4, None), (5, ""), (None, "never named ever"), (6, "one"), (10, " ".join(w[:12]))]
    rows = [
        (1, " ".join(["x"] + w[:12] + ["y"])),
        (2, " ".join(w[:11] + ["short", "item"])),
        (3, " ".join(w[2:10])),
        (4, "AGAIN " * 30),
        (5, None),
        (6, ""),
        (7, "...!!!"),
        (8, "short, ITEM! É one"),
        (8, "short, ITEM! É one"),
        (8, "another text"),
        (None, "one"),
        (None, None),
        (9, "z " * 30000 + " ".join(w)),
    ]
    check(spark, docs, rows, items)


def test_empty_tables(spark, docs):
    check(spark, docs, [(1, "some words here")], [])
    check(spark, docs, [], [(1, "some words here")])


def test_query_equals_sql(spark):
    same(spark, QUERIES["op4_decontaminate"], ORACLE_SQL["op4_decontaminate"], "/root/testdata/sf0.001")
    assert hashlib.sha256(b"").hexdigest() in {r["items_sha256"] for r in QUERIES["op4_decontaminate"](spark, "/root/testdata/sf0.001").collect()}
