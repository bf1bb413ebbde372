"""Frequent bigrams scored where the texts are, and buckets that grow with the bytes of the texts."""

import random

import pytest

from marketloom.llm import lm, substrings

SCHEMA = "doc_id long, text string"


def make(rng, i):
    words = [rng.choice(["red", "Blue", "green", "x%d" % rng.randrange(40)]) for _ in range(rng.randrange(0, 60))]
    return (i, None if i == 7 else " ".join(["of the people"] * (i % 4) + words))


def test_frequent_bigrams_change_no_score(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([make(rng, i) for i in range(80)] + [(None, "of the people"), (3, "of the people")], SCHEMA)
    seen = []
    for least in (10**9, 3, 1):
        monkeypatch.setattr(lm, "FREQUENT_LEAST", least)
        monkeypatch.setattr(lm, "FREQUENT", 1 << 40)
        seen.append(sorted(map(tuple, lm.score_documents(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2])))
    for other in seen[1:]:
        assert len(other) == len(seen[0])
        for a, b in zip(seen[0], other, strict=True):
            assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_more_buckets_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    run = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"w{rng.randrange(500)}" for _ in range(rng.randrange(40))), *run[i % 9 : i % 9 + 18]])) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    get = lambda: sorted((r["doc_id"], r["pos"]) for r in substrings.repeated_windows(docs).collect())
    few = get()
    monkeypatch.setattr(substrings, "BUCKET_TEXT", 32)
    assert few and get() == few
