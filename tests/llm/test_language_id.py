import zlib

import numpy as np

from seqloom.llm import language_id as li
from seqloom.llm.queries import QUERIES


def test_counts_are_those_of_the_ngrams():
    def grams(text):
        t = "".join(c if c.isalpha() or c >= "\x80" else " " for c in f" {text.lower()} ")
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    a, b = "Die Straße, 12!", "dié straße  die"
    for text in (a, b, "x", ""):
        at, n = li.counts(text)
        assert n.sum() == len(grams(text)) and len(at) <= len(set(grams(text)))
    # equal n-grams meet in a bucket, and nearly all others don't
    many = " ".join(a + str(i) for i in range(5)) + b
    assert abs(len(li.counts(many)[0]) - len(set(grams(many)))) <= 2


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        y = i % 3
        at = np.array([y, 3 + rng.integers(0, 40), 43])
        rows.append((at, np.array([0.7, 0.7, 1.0]), y))
    w = li.ftrl(rows, 44, 3, l1=0.5)
    assert all(np.argmax(x @ w[at]) == y for at, x, y in rows)
    assert (w[3:43] == 0).mean() > 0.3


def test_temperature_is_the_minimum():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(500, 3)) * 3
    y = np.array([rng.choice(3, p=li.softmax(r / 2.5)) for r in z])
    loss = lambda t: -np.log(li.softmax(z / t)[np.arange(500), y]).mean()
    best = li.temperature(z, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.linspace(0.1, 10, 200))


def test_documents(spark, docs):
    rows = [(i, f"the house and the garden {i}" if i % 2 else f"das haus und der garten {i}", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "12 !! 34", "en"), (103, "the garden", None), (104, "den garten und haus " * 5000, "de"), (104, "den garten und haus " * 5000, "de"), (None, "the and", "en")]
    found = li.identify(docs(rows + odd).selectExpr("*", "lang AS lang_pred", "lang AS held_out")).collect()
    assert len(found) == len(rows + odd)
    got = {}
    for r in found:
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2)
        assert 0 <= r["score"] <= 1
    assert all(got[i] == [("und", 0.0)] for i in (100, 101, 102))
    assert got[103][0][0] == "en" and [x[0] for x in got[104]] == ["de", "de"]
    assert all(got[i][0][0] == lang for i, _, lang in rows)
    assert {r["lang_pred"] for r in li.identify(docs([(1, "a b", None)])).collect()} == {"und"}
    assert li.identify(docs([])).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = QUERIES["op3_language"](spark, d).collect()
    held = [r for r in found if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]] for r in held]
    assert len(found) == len(truth) and np.mean(right) > 0.97
    assert abs(np.mean([r["score"] for r in held]) - np.mean(right)) < 0.05
