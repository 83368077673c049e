import random
import zlib
from collections import Counter

import pytest
from oracle import same

from seqloom.llm import variants
from seqloom.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


def near(a, b):
    """One added, removed or exchanged letter, letter by letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=5):
    out = {}
    for w, n in counts.items():
        others = [(-counts[o], o.encode(), o) for o in counts if near(w, o)]
        best = min(others, default=None)
        form = best[2] if best and -best[0] >= factor * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    for w, row in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w] = (row[0], at, *row[1:])
    return out


def held(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()}


@pytest.mark.parametrize("letters, size", [("ab", 260), ("abéÿ", 300), ("abcdefghijklmnop", 300)])
def test_random_words_equal_brute_force(spark, letters, size):
    rng, counts = random.Random(size), {}
    words = ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(size // 3)]
    while len(words) < size:  # near ones, and near ones of those
        w = rng.choice(words)
        i, c = rng.randrange(len(w)), rng.choice(letters)
        words.append(rng.choice((w[:i] + c + w[i:], w[:i] + w[i + 1 :] or c, w[:i] + c + w[i + 1 :], w[::-1])))
    for w in words:
        counts[w] = 5 ** rng.randint(0, 5) + rng.randint(0, 2)
    found = variants.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))
    want = brute(counts)
    assert held(found) == want and any(x[2] for x in want.values())
    if letters != "abcdefghijklmnop":
        assert any(x[1] not in (w, x[0]) for w, x in want.items())  # forms of forms


def test_anagrams_are_not_near(spark):
    rows = [("listen", 90), ("silent", 10), ("enlist", 10), ("listed", 10), ("a" * 50000 + "b", 50), ("a" * 50001 + "b", 5), ("a" * 50000, 5), ("a" * 50000 + "c", 9), ("é" + "a" * 49999 + "b", 9), ("ab" * 40, 10), ("ab" * 39 + "ba", 10), ("ab" * 39 + "bb", 99), ("ab" * 40 + "é", 2)]
    assert held(variants.grouped(spark.createDataFrame(rows, "word string, n long"))) == brute(dict(rows))


def test_runs_with_slips(spark, docs):
    text = "Naïve×Straße ÀÉéé under_scored words words2wordsĀother ABCDEF " + "x" * 30000
    rows = [(i, text) for i in range(40)] + [(7, text), (None, text), (3, None), (4, ""), (5, "12 ab")]
    want = Counter()
    for d, t in rows:
        run = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
                if len(word) >= 6:
                    want[word] += 1
            run = ""
    table = docs(rows).selectExpr("*", "lang as word", "lang as n", "lang as w", "lang as d")
    found = variants.counted(variants.runs_with_slips(table), 1)
    assert {r["word"]: r["n"] for r in found.collect()} == dict(want)
    assert len(want) > 4 and min(want.values()) == 1  # with some letters lost
    assert {r["word"]: r["n"] for r in variants.counted(variants.runs_with_slips(table)).collect()} == {w: n for w, n in want.items() if n >= 5}


def test_empty(docs):
    found = variants.grouped(variants.counted(variants.runs_with_slips(docs([]))))
    assert found.collect() == [] and found.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_equals_sql(spark):
    same(spark, QUERIES["op11_variants"], ORACLE_SQL["op11_variants"], D)


def test_keys_of_many_words_are_not_broadcast(spark, tmp_path):
    # a small file of words makes many keys, each some hundred bytes in a driver that broadcasts them
    spark.range(20_000).selectExpr("concat('wort', lower(hex(id * 7919 % 1048573)), 'ende') AS word", "id % 9 + 5 AS n").write.parquet(str(tmp_path / "words"))
    words = spark.read.parquet(str(tmp_path / "words"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = variants.formed(words)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 2
