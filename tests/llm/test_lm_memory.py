"""Memory that a task of the LM scoring holds for a token: what all its steps add up to decides whether an executor lives."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import lm

SUMS = lm._Sums(1_000_000, 60_000, lm.fit_weights([]))
HOT = np.array([[5, 70, 80, 90]], dtype=np.uint64)
TEXTS, WORDS = 400, 1500


def batch(seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    texts = [" ".join(map("w{}".format, rng.zipf(1.3, WORDS) % 60_000)) for _ in range(TEXTS)]
    ids = list(range(seed * TEXTS, (seed + 1) * TEXTS))
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array([x % 5 == 1 for x in ids]), pa.array(texts)], names=["rid", "doc_id", "held_out", "text"])


def peak(run):
    """Bytes held at most while ``run`` works, beside what was there."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def drain(batches):
    for _ in batches:
        pass


@pytest.mark.parametrize("scoring", [(), (SUMS, HOT)], ids=["fit", "score"])
def test_packing_holds_few_copies_of_a_chunk(scoring):
    source = batch(1)
    run = lambda: drain(lm._token_blocks(2, *scoring)(iter([source])))
    run()  # fills the tables of powers, which stay
    assert peak(run) < 80 * TEXTS * (WORDS + 1)


@pytest.mark.parametrize("kind", ["fit", "score"])
def test_a_cell_unpacks_one_block_at_a_time(kind):
    scoring = (SUMS, HOT) if kind == "score" else ()
    rows = [r for k in range(6) for b in lm._token_blocks(1, *scoring)(iter([batch(k)])) for r in b.to_pylist()]
    tokens = sum(int(lm._unpack(r["e"])[0][1].sum()) for r in rows if r["kind"] == lm.TOKENS)
    source = [pa.RecordBatch.from_pylist([r], pa.schema(list(zip(lm._NAMES, lm._TYPES, strict=True)))) for r in rows]
    step = lm._cell_scores(SUMS) if kind == "score" else lm._histogram(1_000_000, 60_000)
    assert peak(lambda: drain(step(iter(source)))) < 70 * tokens


def test_batches_of_packed_rows_are_bounded_by_bytes():
    row = (0, lm.TOKENS, 0, bytes(1 << 20), b"", b"", b"", b"")
    sizes = [b.num_rows for b in lm._batches(iter([row] * 21))]
    assert sum(sizes) == 21 and max(sizes) * (1 << 20) <= 4 << 20


def test_plans_read_batches_bounded_by_bytes(spark):
    lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
