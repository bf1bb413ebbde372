"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a share of all words by weight, at most ``cap`` times its own words (the excess is reshared).  A
document of a source with ratio r = target / words is taken floor(r) times, and once more with probability
r - floor(r).  These fractional probabilities are balanced on two totals, documents and words: the flight moves three
units at a time along the null space of the two constraints until one of them is 0 or 1, so both totals hold exactly.
Blocks of at most ``block`` units fly apart; what is left of a block (two units) flies again with what is left of the
others, level by level, until one block a source remains, whose last two units are rounded (the landing).

Defined cases: a null text or source, or an empty text, is a row like any other (size 0; the null source is a source,
last in order); repeated rows are units of their own; an empty table gives an empty result; a source without words has
target 0.  Every choice depends on (id, text) hashes alone, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, save

FLIGHT = "source_ix int, doc_id bigint, unit bigint, size bigint, p double"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> dict[str | None, float]:
    """Words each source should give.  Sources by code point, null last, take the weights in turn."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, rest = list(order), float(sum(sizes.values()))
    while left:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: rest * weight[s] / total for s in left}
            break
        for s in over:
            out[s] = cap * float(sizes[s])
        rest -= sum(out[s] for s in over)
        left = [s for s in left if s not in out]
    return out


def fly(p: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Flight phase: probabilities that are 0 or 1 but for at most two, with the same sum and the same words."""
    p, n = [float(x) for x in p], len(p)
    s = [float(x) for x in size]
    out = list(p)
    live: list[int] = []
    nxt = 0
    eps = 1e-9
    while True:
        while len(live) < 3 and nxt < n:
            if eps < out[nxt] < 1 - eps:
                live.append(nxt)
            else:
                out[nxt] = float(round(out[nxt]))
            nxt += 1
        if len(live) == 3:
            a, b, c = live
            u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif len(live) == 2 and s[live[0]] == s[live[1]]:
            u = (1.0, -1.0)
        else:
            return np.array(out)
        up = down = math.inf
        for k, d in zip(live, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - out[k]) / d), min(down, out[k] / d)
            elif d < 0:
                up, down = min(up, out[k] / -d), min(down, (1 - out[k]) / -d)
        step = up if bits[live[0]] * (up + down) < down else -down
        for k, d in zip(live, u, strict=True):
            out[k] += step * d
        for k in live:
            if not eps < out[k] < 1 - eps:
                out[k] = float(round(out[k]))
        live = [k for k in live if 0 < out[k] < 1]


def land(p: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Landing: of the roundings of what is left (at most two units), that nearest in words, then in documents."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    best, out = None, p.copy()
    for mask in range(1 << len(open_)):
        x = np.array([(mask >> i) & 1 for i in range(len(open_))], dtype=float)
        d = x - p[open_]
        cost = (abs(float((d * size[open_]).sum())), abs(float(d.sum())), float(bits[open_] @ x) if len(open_) else 0.0)
        if best is None or cost < best:
            best, out[open_] = cost, x
    return out


def _block(last: bool):
    def run(table: pa.Table) -> pa.Table:
        unit = table["unit"].to_numpy()
        size = table["size"].to_numpy()
        p = table["p"].to_numpy()
        order = np.lexsort((p, size, unit))
        table = table.take(pa.array(order))
        bits = (unit[order].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0**53
        out = fly(p[order], size[order], bits)
        if last:
            out = land(out, size[order].astype(float), bits)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out, pa.float64())).drop_columns(["part"])

    return run


def balanced_sample(units: DataFrame, counts: dict[int, int], block: int = 8192) -> Iterator[DataFrame]:
    """Tables of decided units (p is 0.0 or 1.0).  ``counts``: units by source_ix, for the number of blocks."""
    level = 0
    while True:
        parts = {k: max(1, math.ceil(n / block)) for k, n in counts.items()}
        last = all(n == 1 for n in parts.values())
        number = F.lit(1)
        for k, n in parts.items():
            if n > 1:
                number = F.when(F.col("source_ix") == k, F.lit(n)).otherwise(number)
        dealt = units.withColumn("part", F.pmod(F.xxhash64("unit", F.lit(level)), number).cast("int"))
        done = save(dealt.groupBy("source_ix", "part").applyInArrow(_block(last), FLIGHT), f"flight{level}", rows=10000)
        if last:
            yield done
            return
        yield done.filter("p = 0 or p = 1")
        units, level = done.filter("p > 0 and p < 1"), level + 1
        counts = {r["source_ix"]: r["n"] for r in units.groupBy("source_ix").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, block: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: doc_id, unit (hash of id and text), source, size, source_size, target, copies, taken.

    The list of sources (one row each, the mix's own configuration) comes to the driver; rows never do.
    """
    sized = save(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(id_col, text_col).alias("unit"), word_count(F.col(text_col)).alias("size")),
        "sized",
    )
    spark = docs.sparkSession
    found = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    goal = targets({r["source"]: int(r["words"]) for r in found}, weights, cap)
    rows, counts = [], {}
    for i, r in enumerate(sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))):
        ratio = min(goal[r["source"]] / r["words"], cap) if r["words"] else 0.0
        whole = math.floor(ratio)
        rows.append((i, r["source"], int(r["words"]), float(goal[r["source"]]), whole, ratio - whole))
        if ratio > whole:
            counts[i] = r["n"]
    mix = spark.createDataFrame(rows, "source_ix int, source string, source_size bigint, target double, whole int, part_p double")
    joined = sized.withColumnRenamed("source", "own").join(F.broadcast(mix), F.col("own").eqNullSafe(F.col("source")))
    parts = [joined.filter("part_p = 0").select("source_ix", "doc_id", "unit", "size", F.lit(0.0).alias("p"))]
    if counts:
        units = joined.filter("part_p > 0").select("source_ix", "doc_id", "unit", "size", F.col("part_p").alias("p"))
        parts += balanced_sample(units, counts, block)
    decided = parts[0]
    for x in parts[1:]:
        decided = decided.unionByName(x)
    copies = F.col("whole") + F.col("p").cast("int")
    return decided.join(F.broadcast(mix), "source_ix").select("doc_id", "unit", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies``: how often.  Equal rows share their copies evenly.

    Where ``docs`` has a column ``copies`` of its own, the new one is called ``copies_``.
    """
    unit, at, unit_key, key, total, n, copies = fresh(docs.columns, "mix_unit", "mix_id", "mix_unit_key", "mix_key", "mix_sum", "mix_n", "copies")
    known = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    mix = mix_sources(docs, weights, cap).groupBy("doc_id", "unit").agg(F.sum("copies").alias(total), F.count("*").alias(n))
    mix = mix.select(known.alias(key), F.col("unit").alias(unit_key), total, n)
    own = docs.withColumns({unit: F.xxhash64("doc_id", "text"), at: known})
    both = own.join(mix, (F.col(unit) == F.col(unit_key)) & (F.col(at) == F.col(key)))
    # the join's own keys, so the texts move once
    nth = F.row_number().over(Window.partitionBy(unit, at).orderBy(n))
    rank = F.when(F.col(n) == 1, F.lit(1)).otherwise(nth)
    taken = (F.floor(F.col(total) / F.col(n)) + (rank <= F.col(total) % F.col(n)).cast("int")).cast("int")
    return both.withColumn(copies, taken).filter(F.col(copies) > 0).select(*docs.columns, copies)
