"""Substring dedup by seed and extend: winnowed anchors, extension to whole windows, maximal repeats.

1. Seeds.  Of every 8 consecutive 6-word hashes of a document the least (rightmost on ties) is an anchor, so any 13
   words that two documents share hold an anchor at the same place in both.  Anchors are joined on their hash; those
   of one document only are dropped.
2. Extension.  Each shared anchor is extended left and right to every window of ``size`` words that holds it (8 of
   them for 13 words).  Equal extensions meet by their 128-bit hash, and the least doc_id among them is found: a passage
   in m documents costs m entries, never pairs.
3. A word is removed if one of these windows covers it and a smaller doc_id has the same window; touching windows make
   the maximal repeats.

Entries travel in packed blocks, in buckets whose number goes by the bytes of all texts.  Within a chunk of texts repeated anchors and windows are settled on the spot and sent
once, so a passage that a third of all documents hold is a few entries a chunk.

Defined cases: null texts have no words; null ids rank above all others; rows that share an id are one document (none
removes words of the other) but keep their own texts; repeated rows give equal results; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .blocks import groups, partitions, text_chunks
from .common import drop, save, text_key

GRAM = 6
#: Finds that a task gathers before it sends them on (20 bytes each).
FINDS = 2_000_000
#: Bytes of text whose entries one bucket gets on average: a task holds a bucket at a time.
BUCKET_TEXT = 16 << 20
NO_ID = 2**63 - 1
BLOCK = "bucket int, settled boolean, h binary, g binary, doc binary, pos binary, many binary, ids binary, keys binary"
PART = "part int, ids binary, keys binary, counts binary, pos binary"
FOUND = "doc_id bigint, tkey bigint, pos binary"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_TYPES = [pa.int32(), pa.bool_(), *[pa.binary()] * 7]


def winnow(gram: np.ndarray, at: np.ndarray, text: np.ndarray, span: int) -> np.ndarray:
    """Numbers (into ``at``) of the anchors: the least of every ``span`` consecutive hashes of a text."""
    n = len(gram) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least, where = gram[:n].copy(), np.arange(n)
    for k in range(1, span):
        nxt = gram[k : k + n]
        less = nxt <= least
        least = np.where(less, nxt, least)
        where = np.where(less, np.arange(k, k + n), where)
    whole = text[at[:n]] == text[at[span - 1 :]]
    chosen = np.zeros(len(gram), dtype=bool)
    chosen[where[whole]] = True
    return np.flatnonzero(chosen)


class _Chunk:
    """Words of a chunk of documents: word hashes, document of each word, place of each word in its document."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], dtype=np.int64)
        self.keys = table["tkey"].to_numpy().astype(np.int64)
        hs, docs = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for first, _, buf, offs in tk.chunks(table["text"]):
            starts, ends, text = tk.spans(buf, offs)
            hs.append(tk.hashes(buf, starts, ends, lower=False))
            docs.append(text + first)
        self.h, self.doc = np.concatenate(hs), np.concatenate(docs)
        counts = np.bincount(self.doc, minlength=len(self.ids))
        self.counts = counts
        self.head = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.place = np.arange(len(self.h)) - self.head[self.doc]


def _row(bucket: int, settled: bool, h, g, doc, pos, many, c: _Chunk) -> tuple:
    used, local = np.unique(doc, return_inverse=True)
    z = lambda a, t: np.ascontiguousarray(a, dtype=t).tobytes()
    return (bucket, settled, z(h, np.uint64), z(g, np.uint64), z(local, np.uint32), z(pos, np.uint32), z(many, np.uint8), z(c.ids[used], np.int64), z(c.keys[used], np.int64))


def _send(c: _Chunk, h: np.ndarray, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int, by_least: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of a chunk's entries (h, g: 128-bit key).  Keys of several documents of the chunk are settled here:
    all of them are found (anchors), or all but those of the least doc_id (windows); one entry, or the least's, goes on."""
    order = np.lexsort((c.ids[doc], g, h))
    h, g, doc, pos = h[order], g[order], doc[order], pos[order]
    ids = c.ids[doc]
    n = len(h)
    new = np.ones(n, dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = ids[heads], ids[np.concatenate([heads[1:], [n]]) - 1]
    several = (low != high)[group]
    if by_least:
        here = several & (ids != low[group])
        send = ~here
    else:
        here = several
        send = ~several | new
    rows = []
    if here.any():
        none = np.zeros(0)
        rows.append(_row(int(c.keys[0] % buckets), True, none, none, doc[here], pos[here], none, c))
    h, g, doc, pos, many = h[send], g[send], doc[send], pos[send], several[send]
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        at = order[cuts[b] : cuts[b + 1]]
        if len(at):
            rows.append(_row(b, False, h[at], g[at], doc[at], pos[at], many[at], c))
    for first in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[first : first + 64], strict=True), _TYPES, strict=True)], names=_NAMES)


def _anchors(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches, "text"):
            c = _Chunk(table)
            gram, at = tk.windows(c.h, c.doc, GRAM)
            chosen = winnow(gram, at, c.doc, size - GRAM + 1)
            if len(chosen):
                word = at[chosen]
                yield from _send(c, gram[chosen], np.zeros(len(chosen), dtype=np.uint64), c.doc[word], c.place[word], buckets, False)

    return run


def _extend(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_chunks(batches, "text"):
            c = _Chunk(table)
            if len(c.h) < size:
                continue
            edge = np.zeros(len(c.h) + 1, dtype=np.int64)
            for i, packed in enumerate(table["seeds"].to_pylist()):
                seeds = np.frombuffer(packed, dtype=np.uint32).astype(np.int64)
                np.add.at(edge, c.head[i] + np.maximum(seeds - (size - GRAM), 0), 1)
                np.add.at(edge, c.head[i] + seeds + 1, -1)
            wanted = np.cumsum(edge)[: len(c.h)] > 0
            h, at = tk.windows(c.h, c.doc, size)
            g, _ = tk.windows(c.h, c.doc, size, tk.STEP2)
            keep = wanted[at]
            h, g, at = h[keep], g[keep], at[keep]
            if len(at):
                yield from _send(c, h, g, c.doc[at], c.place[at], buckets, True)

    return run


def _settle(by_least: bool, parts: int):
    """What each bucket finds: anchors of several documents, or windows that a smaller doc_id has; packed by the part
    that the documents hash to."""

    def rows_of(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        part = (tk.mix(ids.view(np.uint64) * tk.STEP[0] + keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((keys, ids, part))
        ids, keys, pos, part = ids[order], keys[order], pos[order], part[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(ids)))
        found, first = np.unique(part[heads], return_index=True)
        last = np.append(first[1:], len(heads))
        cells = [(int(p), ids[heads[a:b]].tobytes(), keys[heads[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes(), pos[heads[a] : heads[b - 1] + counts[b - 1]].astype(np.uint32).tobytes()) for p, a, b in zip(found, first, last, strict=True)]
        types = [pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells, strict=True), types, strict=True)], names=["part", "ids", "keys", "counts", "pos"])

    def unpack(rows: list[dict]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for r in rows:
            local = np.frombuffer(r["doc"], dtype=np.uint32)
            parts = (np.frombuffer(r["h"], dtype=np.uint64), np.frombuffer(r["g"], dtype=np.uint64), np.frombuffer(r["ids"], dtype=np.int64)[local], np.frombuffer(r["keys"], dtype=np.int64)[local], np.frombuffer(r["pos"], dtype=np.uint32), np.frombuffer(r["many"], dtype=np.uint8))
            for a, b in zip(out, parts, strict=True):
                a.append(b)
        return [np.concatenate(x) for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def keep(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
            # finds of many buckets share a row for each part, so rows grow with tasks and parts, not with buckets
            nonlocal held, n
            if len(ids):
                held.append((ids, keys, pos))
                n += len(ids)
            if n >= FINDS or (n and not len(ids)):
                yield rows_of(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0

        for _, rows in groups(batches, "bucket"):
            for r in rows:
                if r["settled"]:
                    _, _, ids, keys, pos, _ = unpack([r | {"h": b"", "g": b"", "many": b""}])
                    yield from keep(ids, keys, pos)
            rows = [r for r in rows if not r["settled"]]
            if not rows:
                continue
            h, g, ids, keys, pos, many = unpack(rows)
            order = np.lexsort((ids, g, h))
            h, g, ids, keys, pos, many = (x[order] for x in (h, g, ids, keys, pos, many))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            low, high = ids[heads], ids[np.concatenate([heads[1:], [len(h)]]) - 1]
            if by_least:
                hit = ids != low[group]
            else:
                hit = ((low != high) | (np.maximum.reduceat(many, heads) > 0))[group] & (many == 0)
            if hit.any():
                yield from keep(ids[hit], keys[hit], pos[hit])
        yield from keep(*[np.zeros(0, dtype=np.int64)] * 3)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document from the rows of a part."""
    for _, rows in groups(batches, "part"):
        counts = np.concatenate([np.frombuffer(r["counts"], dtype=np.uint32) for r in rows]).astype(np.int64)
        ids = np.repeat(np.concatenate([np.frombuffer(r["ids"], dtype=np.int64) for r in rows]), counts)
        keys = np.repeat(np.concatenate([np.frombuffer(r["keys"], dtype=np.int64) for r in rows]), counts)
        pos = np.concatenate([np.frombuffer(r["pos"], dtype=np.uint32) for r in rows])
        order = np.lexsort((pos, keys, ids))
        ids, keys, pos = ids[order], keys[order], pos[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (pos[1:] != pos[:-1])
        ids, keys, pos = ids[new], keys[new], pos[new]
        heads = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
        packed = [pos[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[heads], pa.int64()), pa.array(keys[heads], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "tkey", "pos"])


def _buckets(own: DataFrame) -> int:
    """Buckets for the bytes of all texts, so that one bucket stays the same size however large the corpus is."""
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(4 * partitions(own), math.ceil(size / BUCKET_TEXT))


def _found(blocks: DataFrame, buckets: int, by_least: bool, name: str) -> DataFrame:
    n = partitions(blocks)
    dealt = blocks.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_settle(by_least, max(1, buckets // 2)), PART)
    return save(dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_gather, FOUND), name, rows=64)


def repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """(doc_id, tkey, pos): packed first words of the windows that a smaller doc_id has; null ids as NO_ID."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), text_key(F.col("text")).alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = _buckets(own)
    seeds = _found(own.mapInArrow(_anchors(size, buckets), BLOCK), buckets, False, "seeds")
    held = seeds.withColumnRenamed("pos", "seeds")
    near = own.join(held, ["doc_id", "tkey"]).select("doc_id", "tkey", "text", "seeds")
    out = _found(near.mapInArrow(_extend(size, buckets), BLOCK), buckets, True, "repeats")
    drop(seeds)
    return out


def with_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, text, and starts: packed first words of the repeated windows (null: none)."""
    found = repeated_windows(docs, size)
    found = found.select(F.col("doc_id").alias("rep_id"), F.col("tkey").alias("rep_key"), F.col("pos").alias("starts"))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.join(found, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("rep_id")) & (text_key(F.col("text")) == F.col("rep_key")), "left").select("doc_id", "text", "starts")


def maximal_repeats(starts: bytes | None, size: int = 13) -> list[tuple[int, int]]:
    """(first word, end word) of the maximal runs that the repeated windows cover."""
    if not starts:
        return []
    at = np.frombuffer(starts, dtype=np.uint32).astype(np.int64)
    cut = np.flatnonzero(at[1:] > at[:-1] + size) + 1
    return [(int(p[0]), int(p[-1]) + size) for p in np.split(at, cut)]


def kept_words(text: str | None, starts: bytes | None, size: int = 13) -> tuple[bytes, int, int]:
    """The words that stay joined by one space (UTF-8), how many words there were, how many go."""
    words = (text or "").encode().split()
    n, removed = len(words), 0
    for a, b in reversed(maximal_repeats(starts, size)):
        del words[a:b]
        removed += b - a
    return b" ".join(words), n, removed


def digest_rows(batches: Iterator[pa.RecordBatch], size: int = 13) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [kept_words(t, s, size) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
