"""Every query gets min(k, candidates) neighbours, outliers and small tables too."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import mih


def found(spark, ids, x, every, k, **more):
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in mih.nearest(df, F.col("vec_id") % every == 0, k=k, **more).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in got.items()}


def test_outliers_get_all_their_neighbours(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 16)) * 0.05 + np.eye(16)[0]
    x[::50] = -x[::50] + rng.normal(size=(18, 16))  # queries far from all rows
    x[7] *= 1000  # one very large norm
    got = found(spark, range(900), x, 10, 20, block=200, query_block=16)
    assert set(got) == set(range(0, 900, 10))
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 21)) and len({v for _, v, _ in rows} - {q}) == 20
        assert all(s == pytest.approx(float(x[v] @ x[q]), abs=1e-9) for _, v, s in rows)


@pytest.mark.parametrize("n", [2, 5, 12, 20])
def test_small_tables_lose_no_pair(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8)) * rng.choice([1, 30], size=(n, 1))
    got = found(spark, range(n), x, 1, 20)
    want = {q: {(i, round(float(x[i] @ x[q]), 6)) for i in range(n) if i != q} for q in range(n)}
    assert {q: {(v, round(s, 6)) for _, v, s in rows} for q, rows in got.items()} == want


def test_rows_that_share_an_id():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    ids = np.repeat(np.arange(12), 5)
    block = mih.Block(ids, x, np.zeros((60, 8), dtype=np.uint16))
    got, scores = block.best(0, x[0], np.zeros(8, dtype=np.uint16), 0, 10, 10)
    top = sorted(((float(max(x[ids == i] @ x[0])), i) for i in range(1, 12)), reverse=True)[:10]
    assert got.tolist() == [i for _, i in top] and scores == pytest.approx([s for s, _ in top])
