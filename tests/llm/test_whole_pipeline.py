"""Every stage of the pipeline, on what its predecessor kept, against plain Python over whole tables."""

import collections
import random
import re

import pytest
import zstandard
from test_whole_decontamination import by_hand

import corpus_pipeline as cp
from marketloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, DE = "the of and to in is that for with as on by from at".split(), "der die und das von zu mit sich auf für ist ein im dem".split()
LINE = "This notice stands, word for word, at the end of many documents"
NAMES = ["Tom", "Ann", "Bob"]


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def known_languages(spark, rows):
    """Accepted texts: the smallest of the sizes leads the next by 0.1 % at least."""
    packs = []
    for data in langid.learn(spark.createDataFrame([(r["text"], r["lang"]) for r in rows], "text string, lang string")).values():
        p = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **langid.PARAMETERS)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        packs.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    assert len(packs) == 2
    out = []
    for r in rows:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            continue
        data = r["text"].lower().encode()
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 400 else [b"\0" * 96 + b" " + data[m.start() :] + b" " for m in re.finditer(rb"[^ ]+", data)]
        a, b = sorted(sum(len(c.compress(x)) for x in parts) for c in packs)
        if (b - a) / b >= 0.001:
            out.append(r)
    return out


def without_repeated_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = collections.defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            docs[key(line)].add(r["doc_id"])
    gone = lambda line, i: len(key(line)) >= 40 and len(docs[key(line)]) >= 5 and i != max(docs[key(line)])
    out = []
    for r in rows:
        text = "\n".join(x for x in (r["text"] or "").split("\n") if not gone(x, r["doc_id"]))
        out.append(r | {"text": text if r["text"] is not None else None, "n_chars": len(text)})
    return out


def one_of_each_group(rows):
    def shingles(t):
        w = WORD.findall(lower(t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, root = [shingles(r["text"]) for r in rows], {r["doc_id"]: r["doc_id"] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                x, y = sorted((top(rows[i]["doc_id"]), top(rows[j]["doc_id"])))
                root[y] = x
    return [r for r in rows if root[r["doc_id"]] == r["doc_id"]]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_stage(spark, tmp_path, seed):
    rng = random.Random(seed)
    make = lambda v, n: " ".join(rng.choice(v) + rng.choice(["", "", "en", "ing", "ung", "ers", "al"]) for _ in range(n))
    items = [" ".join(rng.choices([f"w{rng.randrange(300)}x", rng.choice(NAMES), str(rng.randint(1, 40))], (6, 1, 1), k=1)[0] for _ in range(n)) for n in (5, 9, 14, 25, 40)]
    texts = [make((EN, DE)[i % 2], rng.choice([2, 6, 30, 70])) for i in range(90)] + [make(EN, 1500)]
    texts += [f"{make(EN, 30)}\n  {LINE if i % 2 else LINE.upper()} \t\n{make(DE, 8)}\n{LINE}" for i in range(7)]
    base = make(DE, 80).split()
    texts += [" ".join(w if k != 7 * i else "anders" for k, w in enumerate(base)) for i in range(9)] + [" ".join(base)] * 4
    texts += [f"{make(EN, 25)} {t} {make(EN, 25)}" for t in items]
    texts += [f"{make(EN, 25)} {' '.join({'Tom': 'Kim', 'Ann': 'Lee', 'Bob': 'Zoe'}.get(w, w) for w in t.split())} {make(EN, 25)}" for t in items]
    texts += [f"{make(EN, 25)} {' '.join(t.split()[:7])} {make(EN, 25)}" for t in items[2:]] + [None, "", " \n", "12 - 5", None, "", "ja"]
    rng.shuffle(texts)
    docs = [(3 * i + 1, t, (None if i % 11 == 0 else "de" if t and any(w in t.split() for w in ("der", "die", "und", "das", "von")) else "en"), ("b", "a", "hot", "hot", None)[i % 5], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = [known_languages, lambda _, rows: without_repeated_lines(rows), lambda _, rows: one_of_each_group(rows), lambda _, rows: [r for r in rows if not any(by_hand(r["text"] or "", t) for t in items)]]
    rows = sorted((r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()), key=lambda r: r["doc_id"])
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (name, stage), by_brute_force in zip(cp.STAGES, plain, strict=False):
        want = by_brute_force(spark, rows)
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((r.asDict() for r in now.collect()), key=lambda r: r["doc_id"])
        assert want != rows and got == want, name
        rows = want
    mixed = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    size, own = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}, collections.Counter()
    for r in rows:
        own[r["source"]] += size[r["doc_id"]]
    order = [*sorted(s for s in own if s is not None), None]
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min((5, 2, 1)[i % 3] * mid, 3 * own[s]) for i, s in enumerate(order)) < sum(own.values()) else (lo, mid)
    assert set(mixed) <= set(size)
    taken, longest = collections.Counter(), collections.Counter()
    for r in rows:
        m = mixed.get(r["doc_id"])
        assert m is None or {k: m[k] for k in r} == r and 1 <= m["copies"] <= 3
        taken[r["source"]] += size[r["doc_id"]] * (m["copies"] if m else 0)
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
    for i, s in enumerate(order):
        assert abs(taken[s] - min((5, 2, 1)[i % 3] * lo, 3.0 * own[s])) <= longest[s]
