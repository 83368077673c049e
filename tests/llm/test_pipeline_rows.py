"""The whole pipeline against brute force, near copies at 0.8 on five-word shingles."""

import pytest
from test_decontaminate import brute_words
from test_near_copies import brute_survivors
from test_packing import packed_well

import corpus_pipeline as cp
from seqloom.llm import language_id, secret_scan

D = "/root/testdata/sf0.01"
CLASHING = ["fp", "root", "component_id", "text_hash", "bands", "shingles", "n_words", "n_hit", "item_ids", "lang_pred", "score", "spans", "n_assign", "length", "piece", "sequence_id", "offset", "start", "ids_crc32"]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.train(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    spoken = [(i, t) for i, t in rows.items() if (p := model.predict(t))[0] != "und" and p[1] >= cp.MIN_LANGUAGE_SCORE]
    windows = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        b = brute_words(r["text"])
        assert len(b) >= 10
        windows |= {tuple(b[s : s + 10]) for s in range(len(b) - 9)}
    clean = []
    for i in sorted(brute_survivors(spoken)):
        w = brute_words(rows[i])
        if not any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9)):
            clean.append((i, secret_scan.redacted_text(rows[i])))
    assert len(rows) >= len(spoken) > len(clean) > 0.8 * len(rows)
    n, least = packed_well(cp.run(spark, D).collect(), clean)
    assert n <= least + 1


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_other_columns_with_names_of_results(spark, docs, name, stage):
    rows = [(i, f"the quick brown fox jumps over the lazy dog number {i % 7} and goes home again password: hunter{i}xyz") for i in range(20)] + [(20, None), (21, ""), (None, "some words")]
    plain = docs(rows)
    wide = plain.selectExpr("*", *[f"cast(doc_id as string) as {c}" for c in CLASHING])
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want, got = stage(spark, plain, D), stage(spark, wide, D)
    if name != "packing":
        assert want.columns == plain.columns and got.columns == wide.columns
        assert all(r["fp"] == (None if r["doc_id"] is None else str(r["doc_id"])) for r in got.collect())
    assert key(got.select(*want.columns).drop("sequence_id", "offset")) == key(want.drop("sequence_id", "offset"))
