"""Line dedup: range-partitioned line hashes, sorted by document and position, streamed into keep bitmaps.

A line's key is the line without white space (0x20, 0x09-0x0D) at both ends, A-Z lower-cased.  Keys of at least
``min_chars`` code points found in at least ``min_docs`` documents are kept in the largest doc_id that holds them (all
its lines) and dropped elsewhere.  Only hashes move: (hash, doc_id, position) rows are range-partitioned by hash and
then doc_id, so that a line in a third of all documents is spread over many tasks, sorted, and streamed with a buffer
of fewer than ``min_docs`` documents.  A hash that reaches over the edge of a file split is decided from its totals,
which are counted apart (at most two such hashes a split).

Defined cases: a null text is an empty one (one empty line); rows with a null id count as one document below all
others; rows that share an id are one document when documents are counted, and keep bitmaps of their own; repeated
rows get the same bitmap; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import checked, drop, fresh, save, text_key

NO_ID = -(2**63)
LINE = "h1 bigint, h2 bigint, doc_id bigint, tkey bigint, pos int, n_lines int"
EDGE = "h1 bigint, h2 bigint"
HIT = "doc_id bigint, tkey bigint, n_lines int, pos int"
BITMAP = "doc_id bigint, tkey bigint, n_lines bigint, n_dropped bigint, keep binary"


def _hash_lines(min_chars: int):
    """Hashes of the lines' keys from the raw bytes of a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, end, buf, offs in tk.chunks(batch.column(2)):
                feeds = np.flatnonzero(buf == 10)
                text_of_feed = np.searchsorted(offs, feeds, "right") - 1
                n_lines = np.bincount(text_of_feed, minlength=end - first) + 1
                # a text's lines end at its feeds and at its own end
                text = np.repeat(np.arange(end - first), n_lines)
                head = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
                ends = np.insert(feeds, np.cumsum(n_lines - 1), offs[1:])
                pos = np.arange(len(text)) - head[text]
                starts = np.where(pos == 0, offs[text], np.concatenate([[0], ends[:-1] + 1]))
                solid = np.flatnonzero(~tk.SPACE[buf])
                lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
                some = hi > lo
                text, pos, lo, hi = text[some], pos[some], lo[some], hi[some]
                a, b = solid[lo], solid[hi - 1] + 1
                points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                long = points[b] - points[a] >= min_chars
                text, pos, a, b = text[long], pos[long], a[long], b[long]
                h1, h2 = tk.hashes(buf, a, b, lower=True), tk.hashes(buf, a, b, lower=True, second=True)
                at = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), ids.take(at), keys.take(at), pa.array(pos.astype(np.int32)), pa.array(n_lines[text].astype(np.int32))], names=["h1", "h2", "doc_id", "tkey", "pos", "n_lines"])

    return run


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, tkey, pos, n_lines) of each line whose key is long enough."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    return own.mapInArrow(_hash_lines(min_chars), LINE)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Columns of each sorted segment (a file split), in pieces; True with the piece that begins one."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        place = np.array([f"{a}|{b}" for a, b in zip(cols.pop("file").to_pylist(), cols.pop("start").to_pylist(), strict=True)])
        data = {k: v.to_numpy(zero_copy_only=False) for k, v in cols.items()}
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield {k: v[a:b] for k, v in data.items()}, place[a] != before
            before = place[a]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: set[tuple[int, int]] = set()
    last = None
    for piece, begins in _segments(batches):
        if begins:
            if last:
                ends.add(last)
            ends.add((int(piece["h1"][0]), int(piece["h2"][0])))
        last = (int(piece["h1"][-1]), int(piece["h2"][-1]))
    if last:
        ends.add(last)
    rows = sorted(ends)
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["h1", "h2"])


def _stream(min_docs: int, edges: set[tuple[int, int]], tops: dict[tuple[int, int], int]):
    """Drops by one pass over sorted rows.  edges: hashes at the edge of a split; tops: their kept document if dropped."""
    names = ("h1", "h2", "doc_id", "tkey", "pos", "n_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = {k: np.zeros(0, dtype=np.int64) for k in names}
        going: tuple[int, int, int] | None = None  # hash and kept document of a run already known to be dropped

        def decide(x: dict[str, np.ndarray], more: bool) -> pa.RecordBatch | None:
            nonlocal carry, going
            n = len(x["h1"])
            if not n:
                return None
            new = np.ones(n, dtype=bool)
            new[1:] = (x["h1"][1:] != x["h1"][:-1]) | (x["h2"][1:] != x["h2"][:-1])
            heads = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            other = new.copy()
            other[1:] |= x["doc_id"][1:] != x["doc_id"][:-1]
            docs = np.add.reduceat(other.astype(np.int64), heads)
            top = x["doc_id"][heads].copy()
            gone = docs >= min_docs
            first = (int(x["h1"][0]), int(x["h2"][0]))
            if going and going[:2] == first:
                gone[0], top[0] = True, going[2]
            for i in {0, len(heads) - 1}:
                key = (int(x["h1"][heads[i]]), int(x["h2"][heads[i]]))
                if key in edges:
                    gone[i] = key in tops
                    top[i] = tops.get(key, top[i])
            keep_back = n
            if more:
                key = (int(x["h1"][-1]), int(x["h2"][-1]))
                if gone[-1]:
                    going = (*key, int(top[-1]))
                elif key not in edges:
                    keep_back = int(heads[-1])
            else:
                going = None
            carry = {k: x[k][keep_back:] for k in names}
            hit = np.flatnonzero((gone[run_of] & (x["doc_id"] != top[run_of]))[:keep_back])
            return pa.RecordBatch.from_arrays([pa.array(x["doc_id"][hit], pa.int64()), pa.array(x["tkey"][hit], pa.int64()), pa.array(x["n_lines"][hit].astype(np.int32)), pa.array(x["pos"][hit].astype(np.int32))], names=["doc_id", "tkey", "n_lines", "pos"])

        for piece, begins in _segments(batches):
            if begins:
                out = decide(carry, False)
                carry, going = {k: np.zeros(0, dtype=np.int64) for k in names}, None
                if out is not None:
                    yield out
            out = decide({k: np.concatenate([carry[k], piece[k]]) for k in names}, True)
            if out is not None:
                yield out
        out = decide(carry, False)
        if out is not None:
            yield out

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, n, pos = (batch.column(i) for i in range(4))
        maps, dropped = [], []
        for lines, at in zip(n.to_pylist(), pos.to_pylist(), strict=True):
            bits = np.ones(lines, dtype=np.uint8)
            bits[np.array(at, dtype=np.int64)] = 0
            maps.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(int(lines - bits.sum()))
        yield pa.RecordBatch.from_arrays([ids, keys, n.cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "tkey", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per (doc_id, text key) that loses a line: n_lines, n_dropped, keep (zlib of the packed bits; 1: kept)."""
    # written first: the range partitioner reads its input twice, once for the sample
    hashed = save(line_hashes(docs.select("doc_id", "text"), min_chars), "line_hashes", rows=512)
    rows = hashed.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "tkey", "pos")
    table = save(rows, "lines", rows=10000)
    drop(hashed)
    placed = table.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    edges = save(placed.select("h1", "h2", "file", "start").mapInArrow(_edges, EDGE).distinct(), "edges")
    totals = table.join(checked(edges), ["h1", "h2"]).groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
    tops = {(r["h1"], r["h2"]): r["top"] for r in totals.filter(F.col("n") >= min_docs).collect()}
    at_edge = {(r["h1"], r["h2"]) for r in edges.collect()}
    hits = placed.mapInArrow(_stream(min_docs, at_edge, tops), HIT)
    marked = hits.groupBy("doc_id", "tkey", "n_lines").agg(F.collect_list("pos").alias("pos"))
    out = save(marked.mapInArrow(_bitmaps, BITMAP), "bitmaps")
    drop(table, edges)
    return out


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its line_keep bitmap (null: all lines stay), which replaces a column of that name; the text shuffles
    only if the bitmaps are many."""
    kept = [c for c in docs.columns if c.lower() != "line_keep"]
    at, key, own_at, own_key = fresh(kept, "line_id", "line_tkey", "line_own", "line_own_tkey")
    right = checked(bitmaps).select(F.col("doc_id").alias(at), F.col("tkey").alias(key), F.col("keep").alias("line_keep"))
    own = docs.select(*kept, F.coalesce("doc_id", F.lit(NO_ID)).alias(own_at), text_key(F.col("text")).alias(own_key))
    return own.join(right, (F.col(own_at) == F.col(at)) & (F.col(own_key) == F.col(key)), "left").select(*kept, "line_keep")


def kept_text(text: bytes | None, keep: bytes | None) -> tuple[bytes, int, int]:
    """The lines that stay, joined by a line feed (UTF-8); how many lines there were; how many are dropped."""
    text = text or b""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines)).tolist()
    left = [x for x, b in zip(lines, bits, strict=True) if b]
    return b"\n".join(left), len(lines), len(lines) - len(left)
