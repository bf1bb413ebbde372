"""Connected components: one task for small tables, steps on tables beyond, the same answer from both."""

import hashlib
import random

import pytest

from marketloom.llm import graph


def digest(i):
    return hashlib.blake2b(str(i).encode(), digest_size=16).digest()


def brute_force(edges):
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.fixture(scope="module")
def edges():
    rng = random.Random(8)
    out = [(i, i + 1) for i in range(60)]  # a path
    out += [(a, b) for a in range(100, 220) for b in range(100, a)]  # all pairs, some of them again
    out += [(300, i) for i in range(301, 340)] + [(i, 300) for i in range(320, 330)]
    out += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(45)]
    return [(digest(a), digest(b)) for a, b in rng.sample(out, len(out)) if a != b] + [(digest(600), digest(600))]


@pytest.mark.parametrize("task_bytes", [graph.TASK_BYTES, 30_000, 0])
def test_against_brute_force(spark, edges, task_bytes):
    got = graph.connected_components(spark.createDataFrame(edges, "a binary, b binary").repartition(3), task_bytes=task_bytes).collect()
    want = brute_force([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {bytes(r["v"]): bytes(r["root"]) for r in got} == want


@pytest.mark.parametrize("task_bytes", [graph.TASK_BYTES, 0])
def test_no_edges_and_signed_numbers(spark, task_bytes):
    assert graph.connected_components(spark.createDataFrame([], "a binary, b binary"), task_bytes=task_bytes).count() == 0
    got = graph.connected_components(spark.createDataFrame([(5, -7), (5, 2**40), (9, 8)], "a long, b long"), task_bytes=task_bytes)
    assert {(r["v"], r["root"]) for r in got.collect()} == {(-7, -7), (5, -7), (2**40, -7), (9, 8), (8, 8)}


def test_a_long_path_in_a_small_table_costs_two_jobs(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    spark.sparkContext.setJobGroup("path", "path")
    try:
        out = graph.connected_components(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("path"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.filter("root = 0").count() == 501
    assert jobs <= 2
