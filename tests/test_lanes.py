"""The lane kernel against tables of distances, and what a bound leaves of them."""

import random

import numpy as np

from seqloom.functions import lanes as L


def last_row(p, t, mode):
    prev = [0] * (len(t) + 1) if mode == L.INFIX else list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        own = [i]
        for j, b in enumerate(t, 1):
            own.append(min(prev[j] + 1, own[j - 1] + 1, prev[j - 1] + (a != b)))
        prev = own
    return prev


def some_pairs(rng, count):
    out = []
    for _ in range(count):
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnopé東😀"])
        p = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 63, 64, 65, 130, 200])))
        if rng.random() < 0.6:
            t = list(p)
            for _ in range(rng.randint(0, max(1, len(p) // 8))):
                if t:
                    x = rng.randrange(len(t))
                    t[x : x + rng.randint(0, 1)] = rng.choice(letters) if rng.random() < 0.7 else ""
            t = "".join(rng.choices(letters, k=rng.choice([0, 0, 50, 150]))) + "".join(t) + "".join(rng.choices(letters, k=rng.choice([0, 0, 50])))
        else:
            t = "".join(rng.choices(letters, k=rng.choice([0, 1, 30, 64, 100, 250])))
        out.append((p, t, rng.choice([0, 1, 5, 20, 40, 70, 100, 1000])))
    return out


def test_distances_equal_the_table():
    rng = random.Random(1)
    for _ in range(12):
        pairs = some_pairs(rng, 12)
        for mode, last in ((L.GLOBAL, False), (L.PREFIX, False), (L.PREFIX, True), (L.INFIX, False), (L.INFIX, True)):
            edits, end = L.distances([L.coded(p) for p, _, _ in pairs], [L.coded(t) for _, t, _ in pairs], [k for *_, k in pairs], mode, last)
            for (p, t, k), got in zip(pairs, zip(edits.tolist(), end.tolist(), strict=True), strict=True):
                row = last_row(p, t, mode)
                low = min(row) if mode != L.GLOBAL else row[-1]
                at = len(t) if mode == L.GLOBAL else len(row) - 1 - row[::-1].index(low) if last else row.index(low)
                assert got == ((low, at) if low <= k else (-1, -1)), (mode, last, p, t, k)


def test_cells_fall_with_the_bound():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(20)]
    near = ["".join(c if rng.random() > 0.01 else "x" for c in t) for t in texts]
    other = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in texts]
    whole = 20 * 2000 * 2000
    for patterns, shares in ((near, (0.12, 0.2)), (other, (0.05, 0.4))):
        seen = []
        for most in (20, 200, 2000):
            cells = []
            L.distances([L.coded(p) for p in patterns], [L.coded(t) for t in texts], [most] * 20, cells=cells)
            seen.append(cells[0] / whole)
        assert seen[0] < shares[0] and seen[1] < shares[1] and seen[0] <= seen[1] <= seen[2]


def test_pairs_in_parts_are_the_same(monkeypatch):
    pairs = some_pairs(random.Random(3), 60)
    args = [L.coded(p) for p, _, _ in pairs], [L.coded(t) for _, t, _ in pairs], [k for *_, k in pairs]
    want = L.distances(*args)
    monkeypatch.setattr(L, "TOGETHER", 3)
    monkeypatch.setattr(L, "MASK_BYTES", 100)
    got = L.distances(*args)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert [len(x) for x in L.distances([], [])] == [0, 0]
