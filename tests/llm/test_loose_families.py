"""Families whose members are mostly below the threshold: components as brute force has them, with few links."""

import itertools
import random

import numpy as np
import pytest

from marketloom.llm import minhash


def shingles(text):
    w = text.lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)), strict=False))


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(60))) for i in range(300, 400)]
    rows += [(i, rows[i - 400][1] + " tail") for i in range(400, 430)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets = {i: shingles(t) for i, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return rows, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [1024, 32])
def test_against_brute_force(spark, family, block):
    rows, want = family
    assert len(set(want.values())) > 120
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, block=block).collect()} == want


def test_a_group_returns_a_forest():
    rng = np.random.default_rng(4)
    sig = np.repeat(rng.integers(0, 256, (3, 64)).astype(np.uint8), 1000, axis=0)
    least = minhash.least_matches(0.75, 64, 1e-6)
    links = list(minhash.forest(np.arange(3000), np.arange(3000), np.arange(3000), sig, least))
    assert len(links) == 2997 and all(i // 1000 == j // 1000 for i, j in links)
    exact = list(minhash.forest(np.arange(3000), np.arange(3000), np.arange(3000), sig, least, lambda i, j: i // 500 == j // 500))
    assert len(exact) == 2994
