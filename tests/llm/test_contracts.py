"""The registered queries on small whole tables: every contract column against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from marketloom.llm import langid, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, DE = "the of and to in is that for with as on by".split(), "der die und das von zu mit sich auf für ist ein".split()


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def part(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(17)
    make = lambda v, n: " ".join(rng.choice(v) + rng.choice(["", "", "", "EN", "er", "ung"]) for _ in range(n))
    out = [(i, make((EN, DE)[i % 2], rng.choice([1, 3, 12, 40, 200])), ("en", "de")[i % 2], ("b", "a", "hot", None)[min(i % 5, 3)]) for i in range(160)]
    out += [(200, None, "en", "a"), (201, "", None, None), (202, " \n\t", "de", "b"), (203, "12 - 5", "en", "b"), (204, make(EN, 3000), "en", "hot"), (205, make(EN, 9), None, "zero")]
    return out + [(i, out[4][1], "en", "hot") for i in range(300, 340)]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("contracts")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 500)] + 0.4 * rng.normal(size=(500, 16))
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(5, 0, "user", "hi <|im_end|>"), (5, 1, "assistant", None), (5, 2, "assistant", "ja")], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_op1(spark, rows, sf):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    learned = [r for r in rows if part(r[0], 4) != 2]
    dictionaries = langid.learn(spark.createDataFrame([(r[1], r[2]) for r in learned], "text string, lang string"))
    known = {lang: {r[1].lower().encode() for r in learned if r[2] == lang and r[1]} for lang in dictionaries}
    assert all(set(d.split(b"\n")[:-1]) <= known[lang] for lang, d in dictionaries.items()) and set(dictionaries) == {"en", "de"}
    pack = {}
    for lang, data in dictionaries.items():
        p = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **langid.PARAMETERS)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        pack[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
    assert set(got) == {r[0] for r in rows}
    right = long = 0
    for doc_id, text, lang, _ in rows:
        r = got[doc_id]
        assert r["held_out"] == (part(doc_id, 4) == 2)
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        data = text.lower().encode()
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 400 else [b"\0" * 96 + b" " + data[m.start() :] + b" " for m in re.finditer(rb"[^ ]+", data)]
        size = {k: sum(len(c.compress(x)) for x in parts) for k, c in pack.items()}
        best = min(sorted(size), key=size.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(2.0 ** (size[best] - s) for s in size.values()))
        long += r["held_out"] and len(parts) >= 12 or len(data) > 400
        right += (r["held_out"] and len(parts) >= 12 or len(data) > 400) and best == lang
    assert long >= 30 and right >= 0.95 * long  # of texts of a few words, some tie


def test_op5(spark, rows, sf):
    tok = lambda t: [*WORD.findall(lower(t or "")), None]
    c, c2, train = collections.Counter(), collections.Counter(), []
    for r in rows:
        if part(r[0], 5) != 1:
            w = tok(r[1])
            pairs = list(zip([None, *w[:-1]], w, strict=True))
            train += pairs
            c.update(w)
            c2.update(pairs)
    n, v = sum(c.values()), len(c)
    bucket = lambda k: 1 + int(math.log2(k)) if k > 0 else 0
    # deleted interpolation: every training token held out in turn, its own occurrence taken off all counts
    held = collections.defaultdict(collections.Counter)
    for h, w in train:
        a, b, o = c2[h, w] - 1, c[h] - 1, c[w] - 1
        held[bucket(b)][a / b if a and b else 0.0, o / (n - 1), 1 / (v + 1)] += 1
    lam, last = {}, [0.0, 0.5, 0.5]
    for k in range(40):
        if k in held:
            x = [1 / 3] * 3
            for _ in range(60):
                new = [0.0] * 3
                for f, times in held[k].items():
                    total = sum(p * q for p, q in zip(x, f, strict=True))
                    new = [s + times * p * q / total for s, p, q in zip(new, x, f, strict=True)]
                x = [s / sum(new) for s in new]
            last = x
        lam[k] = last
    lam[0] = [0.0, *[y / sum(lam[0][1:]) for y in lam[0][1:]]]
    got = {r["doc_id"]: r for r in queries.op5_lm_scoring(spark, sf).collect()}
    assert set(got) == {r[0] for r in rows}
    for doc_id, text, _, _ in rows:
        w, r = tok(text), got[doc_id]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (part(doc_id, 5) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        score = 0.0
        for h, x in zip([None, *w[:-1]], w, strict=True):
            l2, l1, l0 = lam[bucket(c[h])]
            score += math.log10((l2 * c2[h, x] / c[h] if c[h] else 0.0) + l1 * c[x] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(score, rel=0.01), (doc_id, r["score"], score)


def test_op7(spark, rows, sf):
    got = {r["doc_id"]: r for r in queries.op7_mixing(spark, sf).collect()}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    own = collections.Counter()
    for r in rows:
        own[r[3]] += size[r[0]]
    order = [*sorted(s for s in own if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # water-filling by bisection: each source takes min(weight x level, 3 x own words), all together the whole
    total, lo, hi = sum(own.values()), 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(weight[s] * mid, 3 * own[s]) for s in order) < total else (lo, mid)
    goal = {s: min(weight[s] * lo, 3.0 * own[s]) for s in order}
    longest, words, units, copies = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for doc_id, _, _, source in rows:
        r = got[doc_id]
        assert (r["size"], r["source_size"]) == (size[doc_id], own[source]) and r["target"] == pytest.approx(goal[source])
        assert r["taken"] in {k * size[doc_id] for k in range(4)}
        longest[source] = max(longest[source], size[doc_id])
        words[source] += r["taken"]
        units[source] += size[doc_id] > 0
        copies[source] += r["taken"] // size[doc_id] if size[doc_id] else 0
    for s in order:
        assert abs(words[s] - goal[s]) <= longest[s]
        if own[s]:
            assert abs(copies[s] - units[s] * goal[s] / own[s]) <= 2 + 3 * sum(1 for r in rows if r[3] == s and not size[r[0]])


def test_op9(spark, sf):
    got = {r["conv_id"]: r for r in queries.op9_chat_format(spark, sf).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    want = {-1: [("user", said), ("assistant", said)], 5: [("user", "hi <|im_end|>"), ("assistant", ""), ("assistant", "ja")]}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_op10(spark, sf):
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = collections.defaultdict(dict)
    for r in queries.op10_nearest_neighbours(spark, sf).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        best = sorted(((-float(x[q] @ x[i]), i) for i in x if i != q))[:20]
        hits += len({i for _, i in best} & {v for v, _ in found.values()})
        assert sorted(found) == list(range(1, 21)) and [found[k] for k in range(1, 21)] == sorted(found.values(), key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float(x[q] @ x[v]), abs=1e-9) for v, s in found.values())
    assert hits >= 0.9 * 20 * len(got)
