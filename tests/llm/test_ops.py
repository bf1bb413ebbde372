"""Corpus operators against brute force, round trips and held-out accuracy on small fixtures with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import chat, decontam, langid, lines, lm, mih, minhash, mixing, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the of and to in is that for with as was on are by this from at".split()
DE = "der die und das von zu mit sich auf für ist im dem nicht ein eine".split()


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    text = lambda n, extra=(): " ".join(rng.choices(vocab, k=n)) if not extra else " ".join(itertools.chain(rng.choices(vocab, k=n // 2), extra, rng.choices(vocab, k=n // 2)))
    line = "This Common Line Holds More Than Forty Characters for sure"
    passage = rng.choices(vocab, k=30)
    base = text(120)
    out = [None, "", "  \n\t", "one", "One two", "ONE two", "1234 !!", base, base.upper(), base + " tail", base]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{text(20)}\n  {line if i % 2 else line.lower()}  \n{text(15)}\n{line}" for i in range(8)]
    out += [text(60, passage) for _ in range(6)] + [text(n) for n in (3, 40, 80, 5000)]
    out += [f"çà é{i} {text(30)}" for i in range(4)]
    made = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None, "hot")[min(i % 7, 3)], len(t or ""), i % 3, "x") for i, t in enumerate(out)]
    return [*made, made[7], made[7], (None, base, None, None, 3, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = words(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, rows, empty):
    known = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(known, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = sorted((i, len(s), find(i), find(i) == i) for i, s in known)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(empty).count() == 0


def test_crossing_pairs_are_tried():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 256, (3, 128)).astype(np.uint8)
    sig[2] = sig[1]
    assert list(minhash.alike(sig[[0, 1]], sig[[1, 2]], minhash.least_matches(0.75, 128, 1e-6))) == [1]


def test_line_dedup(docs, rows, empty):
    ids = collections.defaultdict(set)
    norm = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(norm(x)) >= 40:
                ids[norm(x)].add(r[0] if r[0] is not None else lines.NO_ID)
    gone = lambda r, x: len(ids.get(norm(x), ())) >= 5 and max(ids[norm(x)]) != (r[0] if r[0] is not None else lines.NO_ID)
    want = sorted((str(r[0]), "\n".join(x for x in (r[1] or "").split("\n") if not gone(r, x))) for r in rows)
    marked = lines.with_bitmaps(docs, lines.keep_bitmaps(docs)).collect()
    assert sorted((str(r["doc_id"]), lines.kept_text(None if r["text"] is None else r["text"].encode(), r["line_keep"])[0].decode()) for r in marked) == want
    assert lines.keep_bitmaps(empty).count() == 0


def test_line_stream_over_splits():
    """Runs that go on over batches and splits, hot and not."""
    import pyarrow as pa

    rng = random.Random(3)
    data = sorted((h, 0, -d, p) for h in range(40) for d in rng.sample(range(100), rng.choice([1, 3, 4, 5, 6, 60])) for p in range(rng.randint(1, 3)))
    docs_of = collections.defaultdict(set)
    for h, _, d, _ in data:
        docs_of[h].add(-d)
    want = sorted((-d, p) for h, _, d, p in data if len(docs_of[h]) >= 5 and -d != max(docs_of[h]))
    cuts = [0, *sorted(rng.sample(range(1, len(data)), 6)), len(data)]
    ends = {(data[i][0], 0) for a, b in itertools.pairwise(cuts) for i in (a, b - 1)}
    tops = {k: max(docs_of[k[0]]) for k in ends if len(docs_of[k[0]]) >= 5}
    batches = []
    for n, (a, b) in enumerate(itertools.pairwise(cuts)):
        for c in range(a, b, 7):
            part = data[c : min(b, c + 7)]
            cols = [[x[0] for x in part], [x[1] for x in part], [-x[2] for x in part], [0] * len(part), [x[3] for x in part], [9] * len(part)]
            batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols] + [pa.array([f"f{n}"] * len(part)), pa.array([0] * len(part), pa.int64())], names=["h1", "h2", "doc_id", "tkey", "pos", "n_lines", "file", "start"]))
    out = [(d, p) for x in lines._stream(5, ends, tops)(iter(batches)) for d, p in zip(x["doc_id"].to_pylist(), x["pos"].to_pylist(), strict=True)]
    assert sorted(out) == want


def test_substrings(docs, rows, empty):
    first = {}
    key = lambda r: substrings.NO_ID if r[0] is None else r[0]
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, key(r)), key(r))
    want = []
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(r) for j in range(i, i + 13)}
        want.append((str(r[0]), len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = [(str(r["doc_id"]), *(lambda k, n, m: (n, m, k.decode()))(*substrings.kept_words(r["text"], r["starts"]))) for r in substrings.with_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert substrings.with_repeats(empty).count() == 0


def test_lm_against_counts(docs, rows, empty):
    tok = lambda t: [*words(lower(t or "")), None]
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    c, c2 = collections.Counter(), collections.Counter()
    for r in train:
        w = tok(r[1])
        c.update(w)
        c2.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[str(r["doc_id"])].append(r)
    for r in rows:
        w = tok(r[1])
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert any(g["n_tokens"] == len(w) and g["n_known"] == sum(c[x] > 0 for x in w) and g["train_tokens"] == n and abs(g["base_score"] - base) < 1e-6 and g["score"] < 0 for g in by[str(r[0])])
    assert lm.score_documents(empty).count() == 0


def test_lm_weights_are_em():
    weights = lm.fit_weights([(3, 4, 2, 90, 90 * 6.0, 90 * 1.0), (3, lm.NONE, 2, 10, 0.0, 10.0)])
    assert weights.sum(axis=1) == pytest.approx(np.ones(lm.BUCKETS))
    assert weights[3][0] == pytest.approx(0.9, abs=0.05)


def test_mixing(docs, rows, empty):
    got = mixing.mix_sources(docs, block=8).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    total = sum(sizes.values())
    goal = mixing.targets(dict(sizes))
    assert sum(goal.values()) == pytest.approx(total)
    longest = max(len(words(r[1])) for r in rows)
    taken = collections.Counter()
    for r in got:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["target"] <= 3 * r["source_size"] + 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= longest for s in sizes)
    again = mixing.mix_sources(docs.repartition(5), block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(empty).count() == 0
    assert sum(r["copies"] for r in mixing.mixed_documents(docs).collect()) == sum(r["copies"] for r in mixing.mix_sources(docs).collect())


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 900, 3000)
    p = mixing.fly(np.full(3000, 0.37), size, rng.random(3000))
    assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
    assert p.sum() == pytest.approx(0.37 * 3000, abs=1e-4) and (p * size).sum() == pytest.approx(0.37 * size.sum(), rel=1e-9)


def test_targets_are_capped():
    t = mixing.targets({"a": 10, "b": 1000, None: 500})
    assert t["a"] == 30 and sum(t.values()) == pytest.approx(1510)


def test_warc(spark):
    big, other = "<p>é</p>" * 200, "x" * 999
    schema = "page_id long, url string, html string, payload_digest string"
    rows = [(1, "http://a/1", big, "z"), (2, None, big, "z"), (5, "http://a/\r\n b", big, None), (3, "u", other, None), (4, "u", other, None), (6, "u", None, None), (7, "u", "", None), (None, "u", big, None), (8, "u", "WARC/1.1\r\n\r\n" * 300, None)]
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame(rows, schema).repartition(2)).collect()}
    assert len(got) == len(rows)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        revisit = html == big and page != 5
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if revisit else ("response", None))
        assert revisit or bytes(r["payload"]) == data
    assert warc.archive_round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_pieces():
    import gzip

    record = b"WARC/1.1\r\nContent-Length: 70000\r\nX-Payload-Bytes: 1\r\n\r\n" + b"q" * 70000 + b"\r\n\r\n"
    for data in (gzip.compress(record * 30), gzip.compress(record * 7) + gzip.compress(record * 3)):
        found = list(warc.split_records(warc.inflated(data, 1000)))
        assert b"".join(r for _, r in found) == gzip.decompress(data)
    with pytest.raises(ValueError, match="cut off"):
        list(warc.inflated(gzip.compress(record)[:-20]))


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "a<", "<|other|>", "<|im_end|", "\\", "<\\|", "\n\n"]
    rows = [(c, i, ("user", "assistant", None, "sys%0A<\n")[(c + i) % 4], t) for c in range(4) for i, t in enumerate(texts)] + [(9, 1, "assistant", "b"), (9, None, "assistant", "a"), (9, 1, "assistant", "b"), (None, 0, "user", "x")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == 6
    for r in out:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfglmnoprstaeiu", k=rng.randint(3, 7)))
    fill = lambda n: " ".join(word() for _ in range(n))
    item = f"A train leaves {fill(6)} at 80 km for Berlin and {fill(8)} then 80 km more to Berlin with 12 bags"
    other = fill(25)
    same = item.replace("80", "95").replace("Berlin", "Madrid").replace("12", "7")
    odd = item.replace("80", "95", 1)
    rows = [(1, f"{fill(30)}. {item} {fill(9)}"), (2, f"{fill(12)} {same}"), (3, fill(80)), (4, odd), (5, None), (6, ""), (7, f"{fill(3)} {other.upper()}, {fill(3)}"), (8, " ".join(item.split()[:9])), (1, fill(20)), (None, other)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, other), (12, "too short"), (13, None), (11, other)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (7, 11), (None, 11)}
    assert got[(1, 10)] == 0 and got[(2, 10)] >= 3
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_language_id(spark):
    rng = random.Random(8)
    make = lambda v, n: " ".join(rng.choices(v, k=n))
    train = spark.createDataFrame([(make(EN, 80), "en") for _ in range(40)] + [(make(DE, 80), "de") for _ in range(40)] + [(None, "en"), ("...", "de"), ("x", None)], "text string, lang string")
    tests = [(make(EN, n), "en") for n in (4, 12, 300, 6000)] + [(make(DE, n), "de") for n in (4, 12, 300, 6000)] + [(None, "und"), ("", "und"), ("12 ?!", "und")]
    frame = spark.createDataFrame([(*t, 1) for t in tests], "text string, want string, lang_x int")
    got = langid.identify(frame, langid.learn(train)).collect()
    assert all(r["lang_pred"] == r["want"] and 0 <= r["lang_score"] <= 1 for r in got)
    assert all(r["lang_accepted"] == (r["want"] != "und") for r in got)
    assert {r["lang_pred"] for r in langid.identify(frame, langid.learn(train.limit(0))).collect()} == {"und"}


def test_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1020, [1.0] * 3), (None, [1.0] * 16), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in mih.nearest(df, F.col("vec_id") % 20 == 0, k=10, block=200, query_block=7).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    y = x.astype(np.float64)
    for q, found in got.items():
        s = np.zeros(600)
        for k in range(16):
            s += y[:, k] * y[q, k]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert all(s[v] == pytest.approx(score, abs=1e-12) for _, v, score in found)
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))
    assert hits >= 0.9 * 10 * len(got)
    few = spark.createDataFrame(rows[:3], df.schema)
    assert mih.nearest(few, F.col("vec_id") % 20 == 0).count() == 2
    assert mih.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_pigeonhole_finds_all():
    rng = np.random.default_rng(9)
    codes = rng.integers(0, 65536, (4000, 4)).astype(np.uint16)
    block = mih.Block(np.arange(4000), np.zeros((4000, 2)), codes)
    for radius in (3, 9, 18, 24):
        want = np.flatnonzero(mih._ONES[codes ^ codes[5]].sum(axis=1) <= radius)
        assert sorted(block.within(codes[5], radius)) == sorted(want)
