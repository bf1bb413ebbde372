"""LM scoring by deleted interpolation of bigrams, unigrams and the uniform distribution.

P(w | h) = l2(b) c(h,w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the bucket of the context's frequency
(powers of two) and the weights of each bucket come from expectation-maximisation on held-out counts: every training
token is held out in turn, its own occurrence deleted from all counts (c(h,w) - 1, c(h) - 1, c(w) - 1, N - 1).  Tokens
are words, A-Z lower-cased, and one end a text; the context of a text's first word is the end.

Three counts have to meet for a token, c(h,w), c(h) and c(w), so tokens are dealt over a grid of cells by the hashes of
both words: cell (i, j) gets the tokens with context hash in part i and word hash in part j, and the slices i and j of
the word counts.  The side of the grid is the root of the token count, so cells keep their size as the corpus grows
and each count is copied to one row and one column only.  Tokens travel in packed blocks with a dictionary of their
chunk, repeats within a document merged; cells send back sums for each document.  Nothing is broadcast but the weights
and the frequent bigrams, those of at least 1 / 65,536 of the training tokens (so at most 65,536 with their counts):
the fit, to which a chunk sends a bigram once, finds them, and their tokens are scored where the texts are, so that a
bigram that every document holds sends nothing to its cell.

The weights are fitted from a histogram of the held-out tokens (bucket, log2 of the two ratios in quarters, with their
mean), whose size does not depend on the corpus.

Defined cases: a null text is empty (one token, its end); null ids are held out or not by the hash of an empty string;
repeated rows are scored each and count each; without training texts N = V = 0 and the uniform term alone is left; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .blocks import groups, partitions, text_chunks
from .common import drop, save, small_batches

END = np.uint64(0xC2B2AE3D27D4EB4F)
BUCKETS = 40
CELL_TOKENS = 2_000_000
#: Bytes of text hashed at once; bytes of packed arrays that a task sends in a batch, and of the batches it reads.
HASHED = 1 << 20
BATCH = 2 << 20
READ = 4 << 20
#: Bigrams with at least one in so many training tokens are frequent: there are at most so many of them.
FREQUENT = 1 << 16
#: No bigram below this count is frequent.
FREQUENT_LEAST = 64
#: Word counts that a task packs at once.
WORDS = 1 << 20
COUNTS = "w bigint, c bigint, o bigint"
BLOCK = "cell int, kind int, chunk bigint, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
WORD_ROW, WORD_COLUMN, TOKENS, DOCS = range(4)
BINS = "bucket int, i2 int, i1 int, pair bigint, n bigint, s2 double, s1 double"
SUMS = "chunk bigint, kind int, a binary, b binary, c binary, d binary, e binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
NONE = -(10**6)
#: The bucket of rows that carry a frequent bigram: its hash, c(h,w), c(h) and c(w).
HOT = -1


def _z(a: np.ndarray, t) -> bytes:
    """An array in byte planes, packed."""
    a = np.ascontiguousarray(a, dtype=t)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def _u(b: bytes, t) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8)
    size = np.dtype(t).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(t)


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hash and row of each token of a chunk."""
    hs, rows = [], []
    for first, end, buf, offs in tk.chunks(table["text"], HASHED):
        starts, ends, text = tk.spans(buf, offs)
        count = np.bincount(text, minlength=end - first)
        hs.append(np.insert(tk.hashes(buf, starts, ends, lower=True), np.cumsum(count), END))
        rows.append(np.repeat(np.arange(first, end, dtype=np.int32), count + 1))
    return (np.concatenate(hs), np.concatenate(rows)) if hs else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))


def _held(table: pa.Table) -> np.ndarray:
    return np.array(table["held_out"].to_pylist(), dtype=bool)


def _pairs(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of each bigram."""
    out = h * tk.STEP[0]
    out += w * tk.STEP[1]
    return tk.mix(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_chunks(batches, "text"):
        w, row = _tokens(table)
        words, at = np.unique(w, return_inverse=True)
        del w
        other = np.bincount(at[_held(table)[row]], minlength=len(words))
        own = np.bincount(at, minlength=len(words)) - other
        del at, row
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(own.astype(np.int64)), pa.array(other.astype(np.int64))], names=["w", "c", "o"])


def _part(h: np.ndarray, side: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(side)).astype(np.int64)


def _batches(rows: Iterator[tuple], size: int = 32) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    n = 0
    for row in rows:
        held.append(row)
        n += sum(map(len, row[3:]))
        if len(held) == size or n >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), _TYPES, strict=True)], names=_NAMES)


def _small(n: int):
    return np.uint8 if n <= 256 else np.uint16 if n <= 65536 else np.uint32


class _Sums:
    """Sums of log probabilities by document from the counts of its tokens."""

    def __init__(self, n_all: int, v_all: int, weights: np.ndarray) -> None:
        self.n, self.v, self.weights = n_all, v_all, weights
        self.floor = math.log10(n_all + 0.5 * (v_all + 1))

    def logs(self, c2: np.ndarray, ch: np.ndarray, cw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the base and of the model for tokens with these counts."""
        lam = self.weights[bucket(ch)]
        p = lam[:, 0] * c2 / np.maximum(ch, 1) + lam[:, 1] * cw / max(self.n, 1) + lam[:, 2] / (self.v + 1)
        return np.log10(cw + 0.5) - self.floor, np.log10(p)


def _token_blocks(side: int, sums: _Sums | None = None, hot: np.ndarray | None = None):
    """Blocks of the tokens by cell; for scores (with ``sums``) also a row with the chunk's documents and the sums of
    their tokens of ``hot`` bigrams (columns pair, c2, ch, cw), else training tokens only."""
    score = sums is not None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table in text_chunks(batches, "text"):
            w, row = _tokens(table)
            held, n = _held(table), table.num_rows
            chunk = int(table["rid"][0].as_py())
            h = np.concatenate([[END], w[:-1]]) if len(w) else w
            done = b""
            if score:
                lens = np.bincount(row, minlength=n)
                if len(hot):
                    pair = _pairs(h, w)
                    at = np.minimum(np.searchsorted(hot[:, 0], pair), len(hot) - 1)
                    here = hot[at, 0] == pair
                    del pair
                    if here.any():
                        logs = sums.logs(*hot[:, 1:].astype(np.int64).T)
                        docs, which = row[here], at[here]
                        body = [np.bincount(docs, minlength=n).astype(float)] + [np.bincount(docs, x[which], minlength=n) for x in logs]
                        done = _z(np.concatenate(body), np.float64)
                        w, h, row = (x[~here] for x in (w, h, row))
                    del at, here
            else:
                use = ~held[row]
                w, h, row = (x[use] for x in (w, h, row))
            cell = (_part(h, side) * side + _part(w, side)).astype(np.int32)
            # (cell, document, pair) in one key; equal neighbours merge, a clash of the cut-off pair only merges less
            pair = _pairs(h, w)
            bits = max(1, int(side * side * max(n, 1)).bit_length())
            key = cell.astype(np.uint64)
            if score:
                key *= np.uint64(n)
                key += row.astype(np.uint64)
            key <<= np.uint64(64 - bits)
            key |= pair >> np.uint64(bits)
            order = np.argsort(key)
            new = np.ones(len(order), dtype=bool)
            key = key[order]
            new[1:] = key[1:] != key[:-1]
            del key
            pair = pair[order]
            new[1:] |= pair[1:] != pair[:-1]
            del pair
            heads = np.flatnonzero(new)
            times = np.diff(heads, append=len(order)).astype(np.uint32)
            order = order[heads]
            del new, heads
            # one array at a time: the task holds a chunk's tokens in few copies
            w = w[order]
            h = h[order]
            row = row[order]
            cell = cell[order]
            del order
            cuts = np.searchsorted(cell, np.arange(side * side + 1))
            del cell
            for k in range(side * side):
                a, b = int(cuts[k]), int(cuts[k + 1])
                if a == b:
                    continue
                hv, hi = np.unique(h[a:b], return_inverse=True)
                wv, wi = np.unique(w[a:b], return_inverse=True)
                rows_in, counts = np.unique(row[a:b], return_counts=True)
                docs = np.stack([rows_in, counts, held[rows_in].astype(np.int64)]) if score else np.array([[0], [b - a], [0]])
                most = int(times[a:b].max())
                tail = _z(times[a:b], np.uint32) if most > 1 else b""
                yield (k, TOKENS, chunk, _z(hv, np.uint64), _z(wv, np.uint64), _z(hi, np.uint32), _z(wi, np.uint32), _pack(docs, tail))
            if score:
                ids = [-(2**63) if x is None else x for x in table["doc_id"].to_pylist()]
                null = np.array([x is None for x in table["doc_id"].to_pylist()], dtype=np.uint8)
                yield (chunk % (side * side), DOCS, chunk, _z(np.array(ids), np.int64), _z(null, np.uint8), _z(held, np.uint8), _z(lens, np.uint32), done)
            del w, h, row, times

    return lambda batches: _batches(rows(batches))


def _pack(docs: np.ndarray, times: bytes) -> bytes:
    body = _z(docs.ravel(), np.uint32)
    return len(body).to_bytes(4, "little") + body + times


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n = int.from_bytes(data[:4], "little")
    docs = _u(data[4 : 4 + n], np.uint32).reshape(3, -1)
    return docs.astype(np.int64), (_u(data[4 + n :], np.uint32) if len(data) > 4 + n else None)


def _word_blocks(side: int):
    """Each slice of the word counts, once for every cell of its row and of its column."""

    def slices(w: np.ndarray, c: np.ndarray) -> Iterator[tuple]:
        part = _part(w, side)
        for k in range(side):
            at = part == k
            if at.any():
                order = np.argsort(w[at])
                a, b = _z(w[at][order], np.uint64), _z(c[at][order], np.uint64)
                for j in range(side):
                    yield (k * side + j, WORD_ROW, 0, a, b, b"", b"", b"")
                    yield (j * side + k, WORD_COLUMN, 0, a, b, b"", b"", b"")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= WORDS:
                yield from slices(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from slices(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return lambda batches: _batches(rows(batches))


def _lookup(keys: np.ndarray, values: np.ndarray, want: np.ndarray) -> np.ndarray:
    """values of keys (sorted); -1 where a key is absent."""
    if not len(keys):
        return np.full(len(want), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, values[at], -1)


def bucket(n: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for none, else 1 + floor(log2 n)."""
    return np.where(n > 0, 1 + np.floor(np.log2(np.maximum(n, 1))), 0).astype(np.int64).clip(0, BUCKETS - 1)


class _Cell:
    """The tokens of a cell with their counts; absent words occur once if a training text has them, else never."""

    def __init__(self, rows: list[dict]) -> None:
        slices = []
        for kind in (WORD_ROW, WORD_COLUMN):
            found = [r for r in rows if r["kind"] == kind]
            w = np.concatenate([_u(r["a"], np.uint64) for r in found]) if found else np.zeros(0, dtype=np.uint64)
            c = np.concatenate([_u(r["b"], np.uint64).astype(np.int64) for r in found]) if found else np.zeros(0, dtype=np.int64)
            order = np.argsort(w)
            slices.append((w[order], c[order]))
        self.slices = slices
        self.blocks = [r for r in rows if r["kind"] == TOKENS]
        pairs, times = [], []
        for r in self.blocks:
            docs, t = _unpack(r["e"])
            train = np.repeat(docs[2] == 0, docs[1])
            pairs.append(_pairs(_u(r["a"], np.uint64)[_u(r["c"], np.uint32)], _u(r["b"], np.uint64)[_u(r["d"], np.uint32)])[train])
            times.append(np.ones(len(pairs[-1]), dtype=np.uint32) if t is None else t[train])
        p = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)
        del pairs
        t = np.concatenate(times) if times else np.zeros(0, dtype=np.uint32)
        del times
        order = np.argsort(p)
        p = p[order]
        t = t[order]
        del order
        new = np.ones(len(p), dtype=bool)
        new[1:] = p[1:] != p[:-1]
        heads = np.flatnonzero(new)
        self.pairs = p[heads]
        self.c2 = np.add.reduceat(t, heads, dtype=np.int64) if len(heads) else np.zeros(0, dtype=np.int64)

    def tokens(self, r: dict) -> tuple[np.ndarray, ...]:
        """Pair, c(h,w), c(h), c(w) and times of a block's tokens, and its documents (row, tokens, held out).  Blocks stay
        packed until asked for, and are unpacked one at a time."""
        hv, wv = _u(r["a"], np.uint64), _u(r["b"], np.uint64)
        hi, wi = _u(r["c"], np.uint32), _u(r["d"], np.uint32)
        docs, times = _unpack(r["e"])
        train = np.repeat(docs[2] == 0, docs[1])
        ch, cw = (_lookup(*x, v)[i] for x, v, i in zip(self.slices, (hv, wv), (hi, wi), strict=True))
        ch, cw = (np.where(x < 0, train.astype(np.int64), x) for x in (ch, cw))
        pair = _pairs(hv[hi], wv[wi])
        return pair, self.count(pair), ch, cw, np.ones(len(hi), dtype=np.int64) if times is None else times.astype(np.int64), docs

    def count(self, pair: np.ndarray) -> np.ndarray:
        return np.maximum(_lookup(self.pairs, self.c2, pair), 0)


def _histogram(n_all: int, v_all: int):
    """Held-out tokens by (bucket, quarter log2 of f2 / f0, of f1 / f0), with the sums of both logs; and the frequent
    bigrams with their counts."""
    names = [x.split()[0] for x in BINS.split(", ")]
    least = max(FREQUENT_LEAST, math.ceil(n_all / FREQUENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f0 = 1.0 / (v_all + 1)
        for _, rows in groups(batches, "cell"):
            cell = _Cell(rows)
            found = [np.zeros((0, 4), dtype=np.uint64)]
            for r in cell.blocks:
                pair, *full, times, _ = cell.tokens(r)
                often = full[0] >= least
                found.append(np.stack([pair[often], *(x[often].astype(np.uint64) for x in full)], axis=1))
                c2, ch, cw = (x - 1 for x in full)
                with np.errstate(divide="ignore", invalid="ignore"):
                    l2 = np.where((c2 > 0) & (ch > 0), np.log2(np.maximum(c2, 1) / np.maximum(ch, 1) / f0), np.nan)
                    l1 = np.where(cw > 0, np.log2(np.maximum(cw, 1) / max(n_all - 1, 1) / f0), np.nan)
                i2 = np.where(np.isnan(l2), NONE, np.floor(4 * np.nan_to_num(l2))).astype(np.int64)
                i1 = np.where(np.isnan(l1), NONE, np.floor(4 * np.nan_to_num(l1))).astype(np.int64)
                b = bucket(ch)
                key = (b * 4096 + np.where(i2 == NONE, 0, i2 + 2048)) * 4096 + np.where(i1 == NONE, 0, i1 + 2048)
                keys, first, at = np.unique(key, return_index=True, return_inverse=True)
                t = times.astype(float)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int32)) for x in (b[first], i2[first], i1[first])] + [pa.array(np.zeros(len(keys), dtype=np.int64)), pa.array(np.bincount(at, t).astype(np.int64)), pa.array(np.bincount(at, t * np.nan_to_num(l2))), pa.array(np.bincount(at, t * np.nan_to_num(l1)))],
                    names=names,
                )
            often = np.unique(np.concatenate(found), axis=0)
            if len(often):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(often), x, dtype=np.int32)) for x in (HOT, 0, 0)] + [pa.array(often[:, 0].view(np.int64)), pa.array(often[:, 1].astype(np.int64)), pa.array(often[:, 2].astype(float)), pa.array(often[:, 3].astype(float))], names=names)
            del rows, cell, found

    return run


def fit_weights(bins: list[tuple[int, int, int, int, float, float]], rounds: int = 60) -> np.ndarray:
    """EM for (l2, l1, l0) of each bucket; buckets without held-out tokens take the nearest lower one's."""
    out = np.zeros((BUCKETS, 3))
    last = np.array([0.0, 0.5, 0.5])
    for b in range(BUCKETS):
        own = [x for x in bins if x[0] == b]
        if own:
            n = np.array([x[3] for x in own], dtype=float)
            f2 = np.array([0.0 if x[1] == NONE else 2.0 ** (x[4] / x[3]) for x in own])
            f1 = np.array([0.0 if x[2] == NONE else 2.0 ** (x[5] / x[3]) for x in own])
            f = np.stack([f2, f1, np.ones(len(own))])
            lam = np.array([1 / 3, 1 / 3, 1 / 3])
            for _ in range(rounds):
                post = lam[:, None] * f
                post /= post.sum(axis=0)
                lam = (post * n).sum(axis=1) / n.sum()
            lam = np.maximum(lam, [0.0, 1e-6, 1e-9])
            last = lam / lam.sum()
        out[b] = last
    out[0] = [0.0, *(out[0][1:] / out[0][1:].sum())]
    return out


def _cell_scores(sums: _Sums):
    """Sums of each document's tokens in a cell, by chunk; the chunk's documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SUMS.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
        for _, rows in groups(batches, "cell"):
            out = [(r["chunk"], DOCS, r["a"], r["b"], r["c"], r["d"], r["e"]) for r in rows if r["kind"] == DOCS]
            cell = _Cell(rows)
            for r in cell.blocks:
                _, c2, ch, cw, t, docs = cell.tokens(r)
                base, score = sums.logs(c2, ch, cw)
                heads = np.concatenate([[0], np.cumsum(docs[1])[:-1]])
                score, base = np.add.reduceat(score * t, heads), np.add.reduceat(base * t, heads)
                known = np.add.reduceat(np.where(cw > 0, t, 0), heads)
                out.append((r["chunk"], TOKENS, _z(docs[0], np.uint32), _z(known, np.uint32), _z(base, np.float64), _z(score, np.float64), b""))
            for first in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out[first : first + 64], strict=True), types, strict=True)], names=names)

    return run


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCORES.split(", ")]
    for _, rows in groups(batches, "chunk"):
        (head,) = (r for r in rows if r["kind"] == DOCS)
        n = _u(head["d"], np.uint32).astype(np.int64)
        known, base, score = _u(head["e"], np.float64).reshape(3, -1).copy() if head["e"] else np.zeros((3, len(n)))
        known = known.astype(np.int64)
        # cells come in any order: add them in a fixed one, so that reruns agree to the last bit
        for r in sorted((r for r in rows if r["kind"] == TOKENS), key=lambda r: (r["a"], r["c"])):
            at = _u(r["a"], np.uint32)
            known[at] += _u(r["b"], np.uint32)
            base[at] += _u(r["c"], np.float64)
            score[at] += _u(r["d"], np.float64)
        null = _u(head["b"], np.uint8).astype(bool)
        ids = pa.array(_u(head["a"], np.int64), pa.int64(), mask=null)
        yield pa.RecordBatch.from_arrays([ids, pa.array(_u(head["c"], np.uint8).astype(bool)), pa.array(n), pa.array(known), pa.array(base), pa.array(score)], names=names)


def crc_part(doc_id: Column, parts: int) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def score_documents(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; trained on what is not held out."""
    spark = docs.sparkSession
    held_out = crc_part(F.col("doc_id"), 5) == 1 if held_out is None else held_out
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    small_batches(spark, size=READ)  # by bytes: a row of packed arrays takes up to a few MB
    counted = own.select("held_out", "text").mapInArrow(_count, COUNTS).groupBy("w").agg(F.sum("c").alias("c"), F.sum("o").alias("o"))
    counts = save(counted, "word_counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v"), F.coalesce(F.sum(F.col("c") + F.col("o")), F.lit(0)).alias("all")).first()
    n_all, v_all = int(total["n"]), int(total["v"])
    side = max(2, math.ceil(math.sqrt(int(total["all"]) / CELL_TOKENS)))
    words = counts.filter("c >= 2 or (c = 1 and o > 0)").select("w", "c")

    def cells(*scoring) -> DataFrame:
        blocks = own.mapInArrow(_token_blocks(side, *scoring), BLOCK).unionByName(words.mapInArrow(_word_blocks(side), BLOCK))
        n = min(partitions(docs), side * side)
        return blocks.repartition(n, "cell").sortWithinPartitions("cell", "kind")

    bins = save(cells().mapInArrow(_histogram(n_all, v_all), BINS).groupBy("bucket", "i2", "i1", "pair").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")), "bins")
    weights = fit_weights([tuple(r) for r in bins.filter(F.col("bucket") != HOT).select("bucket", "i2", "i1", "n", "s2", "s1").orderBy("bucket", "i2", "i1").collect()])
    often = bins.filter(F.col("bucket") == HOT).select("pair", "n", F.col("s2").cast("bigint"), F.col("s1").cast("bigint")).collect()  # at most FREQUENT rows
    drop(bins)
    hot = np.array([tuple(r) for r in often], dtype=np.int64).reshape(-1, 4).view(np.uint64)
    model = _Sums(n_all, v_all, weights)
    sums = cells(model, hot[np.argsort(hot[:, 0])]).mapInArrow(_cell_scores(model), SUMS)
    done = sums.repartition(partitions(docs), "chunk").sortWithinPartitions("chunk").mapInArrow(_total, SCORES)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")
