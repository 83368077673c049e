import random

import numpy as np
import xxhash

from seqloom.llm import simhash


def brute_fp(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    items = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in items]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, bits=3):
    """rows: (doc_id, fp); the least doc_id of each row's component."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(f):
        while up[f] != f:
            up[f] = up[up[f]]
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                up[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f): least.get(find(f)) for d, f in rows}


def test_fingerprint_equals_brute_force():
    for text in [None, "", " \t", "One", "one two", "One Two THREE", "a b c d e f a b c", "É é Ünder 東京 x\x0by\x1cz " * 9, "w" * 50000]:
        assert simhash.fingerprint(text) == brute_fp(text)


def test_trie_pairs_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * 2 + 1
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(5)]))
    half = len(fps) // 2
    lo, hi = np.array([0, half]), np.array([half, len(fps)])
    i, j = simhash.trie_pairs(fps.view(np.int64), lo, hi, 3)
    got = {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = {frozenset((a, b)) for l, h in zip(lo, hi, strict=True) for a in range(l, h) for b in range(l, a) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert got == want and len(i) == len(want)


def test_groups_with_splitting_equal_brute_force(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.links(nodes, 3, group_rows=16)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(simhash._signed(f), simhash._signed(f)), set()).add(f)
    want = {}
    for (_, f), c in brute_components([(f, f) for f in fps]).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents(spark, docs):
    words = [f"w{i}" for i in range(120)]
    near = words[:60] + ["other"] + words[61:]
    rows = [(1, " ".join(words)), (7, " ".join(words)), (3, " ".join(near)), (4, None), (5, ""), (6, "x y"), (6, "x y"), (None, "x y"), (None, "lone text here"), (9, "Some " * 20000)]
    got = simhash.near_duplicates(docs(rows).selectExpr("*", "lang AS root", "lang AS fp")).collect()
    want = brute_components([(d, brute_fp(t)) for d, t in rows])
    assert sorted(((r["doc_id"], r["fp"] & simhash.MASK64, r["component_id"]) for r in got), key=str) == sorted(((d, brute_fp(t), want[d, brute_fp(t)]) for d, t in rows), key=str)
    kept = simhash.survivors(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    groups = {want[d, brute_fp(t)] if d is not None or want[d, brute_fp(t)] is not None else None for d, t in rows}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(groups, key=str)


def test_empty(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.survivors(docs([])).count() == 0


def test_query_equals_brute_force(spark):
    from seqloom.llm.queries import QUERIES

    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], brute_fp(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash"](spark, d).collect()}
    assert got == {(i, f"{f:016x}", want[i, f]) for i, f in rows}
