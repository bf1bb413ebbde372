"""Approximate nearest neighbours by multi-index hashing: learned rotated codes, pigeonhole probing, exact rerank.

Codes.  Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm of all rows, so that the largest
inner product is the least angle; queries get 0.  Principal directions and iterative quantisation (rotations that
bring the vectors near to the corners of a cube) are learned on a bounded sample (``sample`` vectors, by hash of the
id); several rotations make up ``bits`` signs.  The radius is the ``reach`` quantile of the code distance between
vectors of the sample and their true neighbours there; in the full table neighbours lie closer.

Index.  Every row is indexed, in blocks of about ``block`` rows that hold the codes, and for each 16-bit substring the
rows sorted by its value.  A code within radius r of a query lies within floor(r / m) of it in one of the m substrings
(within one less in the later ones, by the remainder), so probing those buckets retrieves every code within the
radius; where the near values outnumber the values in use, the latter are compared with the query's.  What is
retrieved is filtered by the whole code and ranked by inner products of the original vectors, in double precision,
added from the first component on, so equal vectors tie exactly.

The query set meets the index block by block; a block returns its best ``k`` a query.  Queries that have found fewer
than ``k`` (or than there are candidates) meet all blocks again, and there each block widens the radius until it has
as many or has compared all its rows.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite components take no
part, nor do rows without an id; equal rows count once; rows that share an id count as the best of them, as candidates
and as queries; a query's own id is no candidate; fewer than ``k`` candidates are all returned; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SUB = 16
#: Bits by which a radius widens.
STEP = 8
PACKED = "block int, ids binary, vectors binary, codes binary"
HITS = "query_id bigint, vec_id bigint, score double"
_ONES = np.array([bin(i).count("1") for i in range(1 << SUB)], dtype=np.uint8)


class Codes:
    """Learned rotations, the largest norm and the search radius."""

    def __init__(self, sample: np.ndarray, top: float, bits: int = 128, reach: float = 0.985, k: int = 20, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.top, self.bits, d = top, bits, sample.shape[1] + 1
        x = self._lift(sample)
        _, vectors = np.linalg.eigh(x.T @ x)
        kept = min(d, 64)
        main = vectors[:, ::-1][:, :kept]
        y = x @ main
        turns = []
        for _ in range(math.ceil(bits / kept)):
            r = np.linalg.qr(rng.normal(size=(kept, kept)))[0]
            for _ in range(20):
                u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ v).T
            turns.append(main @ r)
        self.turn = np.concatenate(turns, axis=1)[:, :bits]
        self.radius = self._radius(sample, reach, k)

    def _lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, bits / 16) uint16."""
        return np.packbits(self._lift(x, query) @ self.turn >= 0, axis=1).view(np.uint16)

    def _radius(self, sample: np.ndarray, reach: float, k: int) -> int:
        asked = sample[:: max(1, len(sample) // 400)]
        scores = asked @ sample.T
        scores[np.arange(len(asked)), np.arange(0, len(sample), max(1, len(sample) // 400))] = -np.inf
        near = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        if not near.size:
            return self.bits
        a, b = self.encode(asked, True), self.encode(sample)
        far = np.array([_ONES[a[i] ^ b[j]].sum(axis=1) for i, j in enumerate(near)])
        return int(np.quantile(far, reach, method="higher"))


def substring_radii(radius: int, parts: int) -> list[int]:
    """Radius to probe in each substring: floor(r / m) in the first r mod m + 1, one less in the others."""
    whole, rest = divmod(radius, parts)
    return [whole if j <= rest else whole - 1 for j in range(parts)]


def near_values(value: int, radius: int) -> np.ndarray:
    """All 16-bit values within ``radius`` of ``value``."""
    return (np.flatnonzero(_ONES <= radius).astype(np.uint16) ^ np.uint16(value)).astype(np.uint16)


class Block:
    """One block of the index: codes, and rows by substring value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.columns, self.codes = ids, np.ascontiguousarray(vectors.T), codes
        self.single = len(np.unique(ids)) == len(ids)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.values, self.starts = [], []
        for j, o in enumerate(self.order):
            v, s = np.unique(codes[o, j], return_index=True)
            self.values.append(v)
            self.starts.append(np.append(s, len(o)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius, by probing the substrings."""
        seen = np.zeros(len(self.ids), dtype=bool)
        for j, r in enumerate(substring_radii(radius, len(code))):
            if r < 0:
                continue
            used = self.values[j]
            if sum(math.comb(SUB, i) for i in range(min(r, SUB) + 1)) < len(used):
                want = near_values(int(code[j]), r)
                at = np.minimum(np.searchsorted(used, want), len(used) - 1)
                hit = np.zeros(len(used), dtype=bool)
                hit[at[used[at] == want]] = True
            else:
                hit = _ONES[used ^ code[j]] <= r
            if hit.all():
                seen[:] = True
                break
            seen[self.order[j][np.repeat(hit, np.diff(self.starts[j]))]] = True
        rows = np.flatnonzero(seen)
        return rows[_ONES[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]

    def best(self, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` ids within the radius, which widens until it holds ``least`` ids or is all bits."""
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != query_id]
            if radius >= SUB * len(code) or len(rows if self.single else np.unique(self.ids[rows])) >= least:
                break
            radius += STEP
        score = np.zeros(len(rows))
        for c, x in zip(self.columns, query, strict=True):
            score += c[rows] * x
        if not self.single:
            order = np.lexsort((-score, self.ids[rows]))
            rows, score = rows[order], score[order]
            first = np.append(True, self.ids[rows][1:] != self.ids[rows][:-1])[: len(rows)]
            rows, score = rows[first], score[first]
        if len(rows) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            rows, score = rows[keep], score[keep]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][order], score[order]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _pack(codes: Codes, size: int, query: bool):
    def run(table: pa.Table) -> pa.Table:
        x = _matrix(table["embedding"].combine_chunks(), size)
        ids = table["vec_id"].to_numpy()
        parts = [pa.array([v], t) for v, t in ((table["block"][0].as_py(), pa.int32()), (ids.tobytes(), pa.binary()), (x.tobytes(), pa.binary()), (codes.encode(x, query).tobytes(), pa.binary()))]
        return pa.Table.from_arrays(parts, names=["block", "ids", "vectors", "codes"])

    return run


def _open(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["vectors"]).reshape(-1, size), np.frombuffer(row["codes"], dtype=np.uint16).reshape(len(ids), -1)


def _search(radius: int, size: int, k: int, least: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Block] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_block"] < 0:  # the block itself comes before the queries
                    held = (row["block"], Block(*_open(row, size)))
                    continue
                if held is None or held[0] != row["block"]:
                    continue  # no row of the index fell into this block
                ids, vectors, codes = _open(row, size)
                out = [held[1].best(int(q), v, c, radius, k, least) for q, v, c in zip(ids, vectors, codes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(o[0]) for o in out])), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, bits: int = 128, sample: int = 20000, block: int = 8192, query_block: int = 512, reach: float = 0.985) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    own = save(own.filter(sound).withColumn("square", square).dropDuplicates(["vec_id", "embedding"]), "vectors", rows=10000)
    lengths = own.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"), F.max("square").alias("square"), F.count(F.when(is_query, 1)).alias("asked")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, n, asked = lengths[0]["size"], lengths[0]["n"], lengths[0]["asked"]
    own = own.filter(F.size("embedding") == size)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30))
    drawn = (own if n <= sample else own.filter(draw)).select("vec_id", "embedding").toArrow()
    drawn = drawn.sort_by("vec_id").slice(0, 2 * sample)
    x = _matrix(drawn["embedding"].combine_chunks(), size)
    codes = Codes(x, math.sqrt(lengths[0]["square"]), bits, reach, k)
    blocks = max(1, math.ceil(n / block))

    def packed(rows: DataFrame, count: int, query: bool, name: str) -> DataFrame:
        dealt = rows.select(F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(count)).cast("int").alias("block"), "vec_id", "embedding")
        return save(dealt.groupBy("block").applyInArrow(_pack(codes, size, query), PACKED), name, rows=10000)

    index = packed(own, blocks, False, "index")

    def searched(rows: DataFrame, count: int, least: int, name: str) -> DataFrame:
        """The given queries, block by block, against every block of the index."""
        q_blocks = max(1, math.ceil(count / query_block))
        queries = packed(rows, q_blocks, True, f"{name}_queries")
        # a block of the index leaves for its task once, where the queries come to it
        sent = queries.select(F.col("block").alias("q_block"), "ids", "vectors", "codes", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        pairs = index.withColumn("q_block", F.lit(-1)).unionByName(sent).select("block", "q_block", "ids", "vectors", "codes")
        pairs = pairs.repartition(blocks, "block").sortWithinPartitions("block", "q_block")
        return save(pairs.mapInArrow(_search(codes.radius, size, k, least), HITS), name, rows=1)

    asking = own.filter(is_query)
    hits = searched(asking, asked, 0, "hits")
    # queries with too few hits, or none, go again with a radius that widens
    least = min(k, own.select("vec_id").distinct().limit(k + 1).count() - 1)
    found = hits.select("query_id", "vec_id").distinct().groupBy("query_id").count().filter(F.col("count") >= least).select(F.col("query_id").alias("vec_id"))
    short = save(asking.join(found, "vec_id", "left_anti").select("vec_id", "embedding"), "short")
    again = short.count() if least else 0
    if again:
        hits = hits.union(searched(short, again, least, "more_hits"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
