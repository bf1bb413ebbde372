"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

A document's set is its distinct shingles of ``words`` consecutive words (A-Z lower-cased); with fewer words the whole
sequence is one shingle; without words it is empty and links with nothing.

1. Equal sets form one class (by a 128-bit digest), so copies cost one row each and no pairs.
2. ``bands`` x ``rows`` MinHash values of each class are banded; the members of a band's bucket are compared with its
   least member (a star), where the sorted rows of the bucket stream by.
3. A pair is compared in batches of 32 one-byte signature parts: after each batch it is dropped if the posterior
   probability that its similarity reaches the threshold is below ``miss``.  What survives is a candidate.
4. Buckets whose members then lie in several groups of candidates are compared across these groups, in blocks of at
   most ``block`` members, by the same test.  A block joins groups as it finds candidates and returns a forest, so a
   bucket costs rows in proportion to its members.  Groups of candidates are now whole: families.
5. The texts of a family meet, each once, and pairs across components are verified on full sets, most alike first,
   joining components as they are found; again a forest leaves the task.  A family beyond one block is verified by
   block, with a few of its members in every block; members outside its largest component then meet all others.

With 32 bands of 4 rows a pair at similarity 0.75 is never a candidate with probability (1 - 0.75**4)**32 = 5e-6.
Signatures have ``size`` parts, of which the bands use the first ones; all serve the Bayesian test, whose survivors are
then mostly above 0.66.

Defined cases: a null text is empty; rows with a null id join no class and keep a null component_id, kept; rows that
share an id are one vertex; repeated rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .common import checked, drop, save, text_key
from .graph import connected_components

BATCH = 32
#: Members of a family, about, that every block of it holds.
HUBS = 16
#: Shingles of a text that counts as one member of a block; longer ones count as more.
SHINGLES = 1024
_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**32, 2048, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(0, 2**31, 2048, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
EDGES = "a binary, b binary"
SIGNED = "doc_id bigint, tkey bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary"


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) by chunks of the column."""
    for first, end, buf, offs in tk.chunks(column):
        starts, ends, text = tk.spans(buf, offs)
        h = tk.hashes(buf, starts, ends, lower=True)
        sh, at = tk.windows(h, text, words)
        n_words = np.bincount(text, minlength=end - first)
        head = np.concatenate([[0], np.cumsum(n_words)])
        edge = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=end - first))])
        out = []
        for i in range(end - first):
            n = int(n_words[i])
            if n >= words:
                out.append(np.unique(sh[edge[i] : edge[i + 1]]))
            elif n:
                part = h[head[i] : head[i + 1]]
                out.append(tk.mix((part * tk.STEP[:n]).sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        yield first, out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash values (texts x size, uint32) of non-empty sets."""
    if not sets:
        return np.zeros((0, size), dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    heads = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((size, len(sets)), dtype=np.uint32)
    for i in range(size):
        y = (x ^ _XOR[i]) * _MUL[i]
        y ^= y >> np.uint32(15)
        y *= _MUL[i + 1024]
        out[i] = np.minimum.reduceat(y, heads)
    return np.ascontiguousarray(out.T)


def _sign(words: int, bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SIGNED.split(", ")]
        for batch in batches:
            for first, sets in shingle_sets(batch.column(2), words):
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], size)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                for r in range(rows):
                    keys += sig[:, r : bands * rows : rows].astype(np.uint64) * tk.STEP[r]
                keys = tk.mix(keys + tk.STEP2[np.arange(bands) % 64] * np.arange(1, bands + 1, dtype=np.uint64)).view(np.int64)
                low = (sig & np.uint32(255)).astype(np.uint8)
                at = dict(zip(full, range(len(full)), strict=True))
                n = len(sets)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = [keys[at[i]] if i in at else None for i in range(n)]
                parts = [low[at[i]].tobytes() if i in at else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).cast(pa.int64()), batch.column(1).slice(first, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(parts, pa.binary())], names=names)

    return run


@lru_cache
def least_matches(threshold: float, size: int, miss: float) -> tuple[int, ...]:
    """By batch: matches (of the one-byte parts compared so far) below which the posterior chance of reaching the
    threshold is under ``miss``.  Uniform prior; a part of different MinHash values agrees by chance in 1 of 256."""
    s = (np.arange(20000) + 0.5) / 20000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, size + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                out.append(m)
                break
    return tuple(out)


def alike(a: np.ndarray, b: np.ndarray, least: tuple[int, ...], order: bool = False) -> np.ndarray:
    """Which of the signature pairs (rows of a and b) pass every batch; with ``order``, those with most matches first."""
    live, found = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        found = found + (a[live, part] == b[live, part]).sum(axis=1)
        ok = found >= need
        live, found = live[ok], found[ok]
    return live[np.argsort(-found, kind="stable")] if order else live


def _fixed(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a binary column whose values all have ``size`` bytes."""
    if not len(column):
        return np.zeros((0, size), dtype=np.uint8)
    _, _, data = column.buffers()
    return np.frombuffer(data, dtype=np.uint8)[column.offset * size : (column.offset + len(column)) * size].reshape(-1, size)


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (bucket, digest) of a sorted stream whose bucket has another row."""
    held: pa.RecordBatch | None = None  # the last row, of which the bucket may go on
    held_shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        if held is not None:
            meets = held.column(0)[0].as_py() == key[0]
            shared[0] |= meets
            if held_shared or meets:
                yield held
        yield batch.slice(0, len(key) - 1).filter(pa.array(shared[:-1]))
        held, held_shared = batch.slice(len(key) - 1, 1), bool(shared[-1])
    if held is not None and held_shared:
        yield held


def _stars(least: tuple[int, ...], size: int):
    """Pairs of a bucket's first row with its others that pass the Bayesian test, streamed over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, hub, hub_sig = None, np.zeros((1, 16), dtype=np.uint8), np.zeros((1, size), dtype=np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            digest, sig = _fixed(batch.column(1), 16), _fixed(batch.column(2), size)
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            hubs, hub_sigs = np.concatenate([hub, digest[new]]), np.concatenate([hub_sig, sig[new]])
            of = np.cumsum(new)
            rest = np.flatnonzero(~new)
            hit = rest[alike(hub_sigs[of[rest]], sig[rest], least)]
            yield _edges([(x.tobytes(), y.tobytes()) for x, y in zip(hubs[of[hit]], digest[hit], strict=True)])
            last_key, hub, hub_sig = key[-1], hubs[-1:].copy(), hub_sigs[-1:].copy()

    return run


def similar(s: np.ndarray, t: np.ndarray, share: tuple[int, int]) -> bool:
    """Whether two sets of distinct hashes reach the threshold."""
    if share[1] * min(len(s), len(t)) < share[0] * max(len(s), len(t)):
        return False
    common = len(np.intersect1d(s, t, assume_unique=True))
    return share[1] * common >= share[0] * (len(s) + len(t) - common)


def forest(label: np.ndarray, tried: np.ndarray, met: np.ndarray, sig: np.ndarray, least: tuple[int, ...], exact=None) -> Iterator[tuple[int, int]]:
    """Links (i, j) between the rows ``tried`` and the rows ``met`` that join two labels, until none is left.

    ``label`` is changed: rows that are joined share one.  ``exact(i, j)`` decides a pair whose signatures are alike.
    """
    size = sig.shape[1]
    same = np.array_equal(tried, met)
    for n, i in enumerate(tried.tolist()):
        others = met[n + 1 :] if same else met
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        for j in others[alike(np.broadcast_to(sig[i], (len(others), size)), sig[others], least, exact is not None)].tolist():
            if label[j] != label[i] and (exact is None or exact(i, j)):
                yield i, j
                label[label == label[j]] = label[i]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` (integer) columns, from a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        first = 0
        for cut in [*cuts.tolist(), batch.num_rows]:
            now = tuple(key[:, first].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = now
            held.append(batch.slice(first, cut - first))
            first = cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _labels(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers for the distinct values of a binary column."""
    return np.array(column.combine_chunks().dictionary_encode().indices, dtype=np.int64)


def _met(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows to try and rows to try them with: in a group of one block the members outside the main label are marked
    (role 1) and meet all; with more blocks these come as rows of their own (role 2)."""
    role = group["role"].to_numpy()
    own = np.flatnonzero(role < 2)
    return (np.flatnonzero(role == 2) if (role == 2).any() else np.flatnonzero(role == 1)), own


def _across(least: tuple[int, ...], size: int):
    """Candidates across labels in sorted groups: grp, x, y, role, digest, label, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            digest, sig = group["digest"].to_pylist(), _fixed(group["sig"].combine_chunks(), size)
            tried, met = _met(group)
            out = [(digest[i], digest[j]) for i, j in forest(_labels(group["label"]), tried, met, sig, least)]
            if out:
                yield _edges(out)

    return run


def _verified(least: tuple[int, ...], size: int, words: int, share: tuple[int, int]):
    """Links on full sets in sorted groups: grp, x, y, role, digest, label, sig of members, and rows with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            texts = group.filter(pc.is_valid(group["text"]))
            at = {d: i for i, d in enumerate(texts["digest"].to_pylist())}
            sets = [s for _, part in shingle_sets(texts["text"], words) for s in part]
            group = group.filter(pc.is_valid(group["sig"])).combine_chunks()
            digest, sig = group["digest"].to_pylist(), _fixed(group["sig"].combine_chunks(), size)
            of = [sets[at[d]] for d in digest]
            tried, met = _met(group)
            out = [(digest[i], digest[j]) for i, j in forest(_labels(group["label"]), tried, met, sig, least, lambda i, j, of=of: similar(of[i], of[j], share))]
            if out:
                yield _edges(out)

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, *payload: str) -> DataFrame:
    """Rows (grp, label, digest, ...) dealt over blocks of their group: every member goes to its block x, once for each
    block y of members outside the main label; these also go to their block y of every x.  A group of one block has
    each member once.  ``sizes``: grp, main, blocks, others (blocks of the members outside ``main``)."""
    rows = rows.join(checked(sizes), "grp")
    rows = rows.withColumn("x", F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int")).withColumn("y", F.pmod(F.xxhash64("digest", F.lit(6)), F.col("others")).cast("int"))
    apart = F.col("label") != F.col("main")
    own = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda y: F.struct(F.col("x").alias("x"), y.alias("y"), apart.cast("int").alias("role")))
    out = F.when(apart & (F.col("blocks") > 1), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("x"), F.col("y").alias("y"), F.lit(2).alias("role"))))
    dealt = rows.select("grp", "digest", "label", *payload, F.explode(F.concat(own, F.coalesce(out, F.array().cast("array<struct<x:int,y:int,role:int>>")))).alias("at"))
    dealt = dealt.select("grp", "at.x", "at.y", "at.role", "digest", "label", *payload)
    return dealt.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")


def _several(rows: DataFrame, weight: Column, block: float, name: str) -> DataFrame:
    """grp, main, blocks, others of the groups with several labels; counts only, so a hot group is no hot task."""
    by = rows.groupBy("grp", "label").agg(F.sum(weight).alias("w"))
    by = by.groupBy("grp").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.sum("w").alias("w"), F.max("w").alias("most"), F.count("*").alias("n")).filter("n > 1")
    count = lambda w: F.greatest(F.lit(1), F.ceil(w / block)).cast("int")
    return save(by.select("grp", "main", count(F.col("w")).alias("blocks"), count(F.col("w") - F.col("most")).alias("others")), name)


def candidate_families(members: DataFrame, least: tuple[int, ...], size: int, block: int) -> DataFrame:
    """(v, root) for the classes that have a candidate; members: digest, buckets, sig."""
    banded = members.select(F.explode("buckets").alias("bucket"), "digest", "sig").repartition("bucket").sortWithinPartitions("bucket", "digest")
    stars = save(banded.mapInArrow(_stars(least, size), EDGES), "stars", rows=4000)
    label = connected_components(stars)
    named = members.join(label.withColumnRenamed("v", "digest"), "digest", "left").select(F.explode("buckets").alias("grp"), "digest", F.coalesce("root", "digest").alias("label"), "sig")
    mixed = _several(named, F.lit(1), block, "mixed")
    more = save(_dealt(named, mixed, "sig").mapInArrow(_across(least, size), EDGES), "crossing", rows=4000)
    if more.isEmpty():
        drop(stars, mixed, more)
        return label
    out = connected_components(label.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more))
    drop(stars, mixed, more, label)
    return out


def verified_links(families: DataFrame, classes: DataFrame, docs: DataFrame, least: tuple[int, ...], size: int, words: int, share: tuple[int, int], block: int) -> DataFrame:
    """Links (a, b) on full sets that make up the components of each family (v, root)."""
    own = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text")
    rows = families.select(F.col("v").alias("digest"), F.xxhash64("root").alias("grp")).join(classes.select("digest", "doc_id", "tkey", "sig", "n_shingles"), "digest")
    # a block holds ``block`` members, or as many shingles as so many texts of SHINGLES have
    rows = save(rows.withColumn("weight", F.greatest(F.lit(1.0), F.col("n_shingles") / SHINGLES)).drop("n_shingles"), "family_rows", rows=10000)
    sizes = save(rows.groupBy("grp").agg(F.ceil(F.sum("weight") / block).cast("int").alias("blocks"), F.count("*").alias("n")), "family_sizes")

    def verified(dealt: DataFrame) -> DataFrame:
        """Signatures and texts meet in the blocks: a text leaves its document once for each block that needs it."""
        keys = save(dealt.select("grp", "x", "y", "digest", "doc_id", "tkey").distinct(), "family_keys")
        texts = own.join(checked(keys), ["doc_id", "tkey"]).select("grp", "x", "y", F.lit(None).cast("int").alias("role"), "digest", F.lit(None).cast("binary").alias("label"), F.lit(None).cast("binary").alias("sig"), "text")
        both = dealt.select("grp", "x", "y", "role", "digest", "label", "sig", F.lit(None).cast("string").alias("text")).unionByName(texts)
        both = both.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y")
        links = save(both.mapInArrow(_verified(least, size, words, share), EDGES), "links", rows=128)
        drop(keys)
        return links

    # every member in one block of its family; a few, by hash, in all of them
    everywhere = F.pmod(F.xxhash64("digest", F.lit(9)), F.col("n")) < HUBS
    one = F.array(F.pmod(F.xxhash64("digest", F.lit(5)), F.col("blocks")).cast("int"))
    first = rows.join(checked(sizes), "grp").withColumn("x", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(one)))
    links = verified(first.withColumns({"y": F.lit(0), "role": F.lit(1), "label": F.col("digest")}))
    wide = sizes.filter("blocks > 1").select("grp")
    if not wide.isEmpty():
        label = connected_components(links)
        named = rows.join(F.broadcast(wide) if wide.count() <= 10_000 else wide, "grp", "left_semi").join(label.withColumnRenamed("v", "digest"), "digest", "left").withColumn("label", F.coalesce("root", "digest"))
        apart = _several(named, F.col("weight"), block, "apart")
        more = verified(_dealt(named, apart, "sig", "doc_id", "tkey"))
        links = label.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(more)
    drop(rows, sizes)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, share: tuple[int, int] = (75, 100), bands: int = 32, rows: int = 4, size: int = 512, miss: float = 1e-6, block: int = 1024) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id linked, itself included), kept."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    least = least_matches(share[0] / share[1], size, miss)
    signed = save(docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text").mapInArrow(_sign(words, bands, rows, size), SIGNED), "signed")
    real = signed.filter("doc_id is not null and n_shingles > 0")
    # equal sets are one class; ids in two classes (a repeated id) tie these together as one vertex would
    classes = save(real.groupBy("digest").agg(F.min_by(F.struct("doc_id", "tkey", "n_shingles", "bands", "sig"), "doc_id").alias("r"), F.count("*").alias("copies")).select("digest", "copies", "r.*"), "classes")
    # only buckets with company matter; the signature goes with each of these bands, so a bucket's pairs are tested
    # where its rows meet and are never joined
    sorted_bands = classes.select(F.explode("bands").alias("bucket"), "digest").repartition("bucket").sortWithinPartitions("bucket")
    company = sorted_bands.mapInArrow(_shared, "bucket bigint, digest binary").groupBy("digest").agg(F.collect_list("bucket").alias("buckets"))
    members = save(company.join(classes.select("digest", "sig"), "digest"), "company", rows=10000)
    families = candidate_families(members, least, size, block)
    drop(members)
    links = verified_links(families, classes, docs, least, size, words, share, block)
    shared = real.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    shared = real.select("doc_id", F.col("digest").alias("b")).join(shared.select("doc_id", "a"), "doc_id").filter("a <> b").select("a", "b")
    label = connected_components(links.unionByName(shared))
    # ids: the least doc_id of the component, through the least of each class
    whole = classes.select("digest", "copies", F.col("doc_id").alias("rep")).join(label.withColumnRenamed("v", "digest"), "digest", "left").filter("copies > 1 or root is not null")
    whole = whole.withColumn("root", F.coalesce("root", "digest"))
    least_id = whole.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = save(whole.join(least_id, "root").select("digest", "component_id"), "answer")
    out = signed.select("doc_id", "n_shingles", "digest").join(checked(answer), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = save(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")), "near")
    drop(signed, classes, answer)
    return out
