"""Connected components of an edge table: in one task while the table is small, else by steps on tables.

A table of at most ``TASK_BYTES`` is joined up in a single task, in one pass, however long its paths are: steps cost a
few stages each, which on a small table is nothing but the start of tasks.  A larger one goes through alternating
large-star and small-star steps, until it is done or small enough.

Each step is a grouped minimum (with map-side combine), written, and a join of the edges with it: a broadcast below
the size limit, beyond it a join of two plain exchanges, where adaptive execution splits a hub with many edges over
tasks.  Edges stay in the shared folder between steps; only counters come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, checked, drop, save, table_bytes

#: Bytes on disk up to which one task takes all edges (some hundred thousand of digests).
TASK_BYTES = BROADCAST_BYTES


def _star(near: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """near: (u, v) with v a neighbour of u.  Large: neighbours above u go to the least; small: all below go to it.
    Also the table of minima, which can go when the step is written."""
    low = save(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least", rows=10000)
    both = near.join(checked(low), "u")
    if large:
        return both.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), low
    return both.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), low


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of all edges (a, b) of the stream: union-find, where the lesser root always stays."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    values = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    values = values.take(pc.sort_indices(values))
    parent = list(range(len(values)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*(pc.index_in(edges[c], values).to_pylist() for c in ("a", "b")), strict=True):
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([find(x) for x in range(len(values))])
    for first in range(0, len(values), 10000):
        yield pa.RecordBatch.from_arrays([values[first : first + 10000], values.take(pa.array(roots[first : first + 10000]))], names=["v", "root"])


def connected_components(edges: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b); root is the least vertex of its component."""
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = save(edges.filter("a <> b").select(hi.alias("a"), lo.alias("b")), "edges", rows=10000)
    size = lambda df: table_bytes(df.sparkSession, df._marketloom_path)
    if size(now) > task_bytes:
        now, repeated = save(now.distinct(), "edges"), now
        drop(repeated)
    state = None
    while size(now) > task_bytes:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide, low = _star(both, True)
        wide = save(wide, "edges")
        small, lower = _star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        nxt = save(small, "edges")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("bigint")).alias("h"), F.sum(F.hash("b", "a").cast("decimal(38,0)") * F.lit(3)).alias("g")).first()
        drop(now, wide, low, lower)
        now = nxt
        if (found := (row["n"], row["h"], row["g"])) == state:
            out = now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
            break
        state = found
    else:
        kind = now.schema["a"].dataType.simpleString()
        out = now.coalesce(1).mapInArrow(_joined, f"v {kind}, root {kind}")
    out = save(out, "components", rows=10000)
    drop(now)
    return out
