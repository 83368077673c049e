import itertools
import random

import numpy as np
import xxhash

import corpus_pipeline as cp
from seqloom.llm import near_copies

D = "/root/testdata/sf0.01"


def brute_set(text, words=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_survivors(rows):
    """The least doc_id of each component of texts at 0.8 or more, by comparing all pairs."""
    sets = {i: brute_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 5 * both >= 4 * (len(x) + len(y) - both):
                a_, b_ = find(a), find(b)
                up[max(a_, b_)] = min(a_, b_)
    return {find(i) for i in ids}


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_survivors(rows)
    assert 1 in want and 255 not in want and 56 not in want  # near copies at 0.831 and 0.967
    kept = cp.near_duplicates(spark, docs, D)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(want)


def test_edges_of_the_threshold(spark, docs):
    base = [f"w{i}" for i in range(49)]  # 45 shingles
    # 40 of 50 are 0.8, 39 of 51 less; a chain goes on beyond the first one's neighbours
    rows = [(1, " ".join(base)), (2, " ".join(base[:44] + ["x"] * 1 + [f"y{i}" for i in range(4)])), (3, " ".join(base[:43] + [f"z{i}" for i in range(6)])), (5, " ".join(f"y{i}" for i in range(3)))]
    rows += [(10 + k, " ".join(f"v{i}" for i in range(5 * k, 5 * k + 60))) for k in range(9)]
    want = brute_survivors(rows)
    assert want == {1, 3, 5, 10}
    assert {r["doc_id"] for r in near_copies.survivors(docs(rows)).collect()} == want


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "x y"), (4, "x y"), (None, "x y"), (None, "lone text here"), (6, "X  Y")]
    assert sorted((r["doc_id"] for r in near_copies.survivors(docs(rows)).collect()), key=str) == [1, 4, None]
    assert near_copies.survivors(docs([])).count() == 0


def test_large_groups_are_dealt_out(spark, docs):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # near copies of one text, from one to eight words changed
        words = list(base)
        for _ in range(rng.choice((1, 1, 2, 8))):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    rows += [(i, rows[i - 100][1]) for i in range(100, 120)]
    want = brute_survivors(rows)
    assert 3 < len(want) < 60
    for cell in (4, 16, 512):
        found = near_copies.near_copies(docs(rows), cell=cell).filter("doc_id = component_id").select("doc_id")
        assert {r["doc_id"] for r in found.collect()} == want


def test_pairs_equal_brute_force():
    rng = random.Random(5)
    for n in (2, 3, 40):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 30))), np.uint64) for _ in range(n)]
        want = [(i, j) for j in range(n) for i in range(j) if 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})]
        assert sorted(zip(*(x.tolist() for x in near_copies.near_pairs(sets)), strict=True)) == sorted(want)


def test_of_repeated_rows_the_least_by_hash_stays(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (1, "a b c", "y"), (1, "other text", "z"), (2, "a b c", "w")]
    one = lambda rows: [tuple(r) for r in near_copies.survivors(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()]
    kept = one(rows)
    assert sorted(kept) == sorted(one(rows[::-1])) and [r[:2] for r in sorted(kept)] == [(1, "a b c"), (1, "other text")]


def brute_sim(shingles):
    hashes = [xxhash.xxh64_intdigest(" ".join(x), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_trie_join_of_simhashes_and_its_exact_check(spark, docs):
    rng = random.Random(9)
    rows = [(0, None)]
    for n, changes, places in ((12, 1, range(12)), (40, 1, [20]), (200, 1, range(200)), (200, 9, range(200))):
        base = [f"w{n}x{changes}x{i}" for i in range(n)]  # copies of one text, at 0.756 where the same word of 40 is another
        for _ in range(40):
            words = list(base)
            for _ in range(changes):
                words[rng.choice(places)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    sets = {brute_set(t) for _, t in rows}
    sims = {x: brute_sim(x) for x in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if (sims[a] ^ sims[b]).bit_count() <= near_copies.BITS]
    alike = [5 * len(a & b) >= 4 * len(a | b) for a, b in pairs]
    assert any(alike) and not all(alike)

    def parts(links):
        up = {x: x for x in sets}
        for a, b in links:
            old, new = up[a], up[b]
            up = {x: new if r == old else r for x, r in up.items()}
        found = {}
        for x, r in up.items():
            found.setdefault(r, set()).add(x)
        return sorted(sorted(names[x] for x in p) for p in found.values() if len(p) > 1)

    table = docs(rows)
    prints = near_copies._prints(table, 5)
    names = {brute_set(rows[r["doc_id"]][1]): r["fp"] for r in prints.collect()}
    back = {v: k for k, v in names.items()}
    groups = near_copies.trie_groups(prints)
    got = {}
    for r in groups.collect():
        got.setdefault((r["band"], r["n"]), []).append(r["fp"])
    want = parts(pairs)
    assert sorted(sorted(x) for x in got.values()) == want and all(n == len(x) for (_, n), x in got.items())
    # the links of a group are those of its pairs that are similar enough
    ones = prints.groupBy("fp").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").join(prints.select("doc_id", "text_hash"), "doc_id")
    held = near_copies._sets(table, ones.select("doc_id", "text_hash", "fp"), 5)
    edges = near_copies._compared(near_copies._cells(groups, 16).join(held, "fp"), near_copies.LEAST).collect()
    inside = [(a, b) for p in want for a, b in itertools.combinations([back[x] for x in p], 2) if 5 * len(a & b) >= 4 * len(a | b)]
    assert parts([(back[r["u"]], back[r["v"]]) for r in edges]) == parts(inside)
    # and bands that they have joined are left out without a loss
    bands = near_copies.band_groups(prints)
    assert 0 < near_copies._open(bands, spark.createDataFrame([(r["u"], r["v"]) for r in edges], "u long, v long")).count() < bands.count()
    assert {r["doc_id"] for r in near_copies.survivors(table).collect()} == brute_survivors(rows)
