"""Packed blocks: what tasks send each other in place of one row an entry.

A map task gathers texts until it has ``CHUNK`` bytes, works on the whole chunk in numpy, and sends each bucket one
row whose binary columns hold arrays.  Repeated content within a chunk is resolved there, so a passage that every
document has costs one entry a chunk, not one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that a task works on at once (a longer text is a chunk of its own).
CHUNK = 8 << 20


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK) -> Iterator[pa.Table]:
    """The rows in tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lens = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_string(column.type) else np.int64)[column.offset : column.offset + len(column) + 1])
        ends, first = np.cumsum(lens.astype(np.int64)), 0
        while first < batch.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = int(np.searchsorted(ends, done + max(limit - size, 1), "right"))
            last = min(batch.num_rows, max(first + 1, last) if not held else max(first, last))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - done
            if last < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            first = last
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a stream sorted by ``key``, group by group."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now:
                if rows:
                    yield now, rows
                now, rows = row[key], []
            rows.append(row)
    if rows:
        yield now, rows
