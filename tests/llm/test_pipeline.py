"""The pipeline's stages on a small table with odd rows and extra columns."""

import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    en, de = "the of and to in is that for with as".split(), "der die und das von zu mit sich auf für".split()
    item = " ".join(f"w{rng.randrange(900)}" for _ in range(25))
    make = lambda v, n: " ".join(rng.choice(v) + rng.choice(["", "", "en", "ing", "ung"]) for _ in range(n))
    common = "a long line that many documents share, more than forty characters"
    rows = [(i, f"{make((en, de)[i % 2], 60)}\n{common}", ("en", "de")[i % 2], f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[4][1], "en", "s0"), (101, f"{make(en, 40)} {item}", "en", "s1"), (102, None, None, None), (103, "123 !!", "en", "s0"), (104, rows[6][1] + " more", "en", None)]
    docs = spark.createDataFrame([(a, b, c, d, len(b or ""), "k") for a, b, c, d in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in seen]
    assert ids[0] - ids[1] == {102, 103}
    assert ids[2] == ids[1]
    assert ids[2] - ids[3] == {100, 104}
    assert ids[3] - ids[4] == {101}
    assert all(s.columns == docs.columns for s in seen[:-1])
    texts = {r["doc_id"]: r for r in seen[2].collect()}
    assert common not in texts[2]["text"] and texts[2]["n_chars"] == len(texts[2]["text"])
    assert sum(common in r["text"].split("\n") for r in texts.values()) == 1
    assert all(1 <= r["copies"] <= 3 for r in seen[-1].collect())
    assert sorted(r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()) == sorted(r["doc_id"] for r in seen[-1].collect())
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
