"""Stages and operators on tables whose extra columns are called like columns they add, and odd small cases."""

import gzip
import io

import corpus_pipeline as cp
from pyspark.sql import functions as F

from marketloom.llm import langid, lines, mih, mixing, warc

NAMES = ["lang_pred", "lang_score", "lang_accepted", "has_letters", "line_keep", "line_id", "line_own", "leak_id", "leak_key", "mix_sum", "mix_unit", "mix_id", "mix_n", "copies", "tkey", "component_id", "kept", "size", "target", "bucket", "unit", "digest", "pos", "extra__1"]


def table(spark, rows=30):
    en, de = "the of and to in is that for with as", "der die und das von zu mit sich auf für"
    made = [(i, f"{(en, de)[i % 2]} " * 4 + f"number {i} is here and there", ("en", "de")[i % 2], "s", 0, *[f"{n}{i}" for n in NAMES]) for i in range(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))


def test_stages_keep_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(0, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == (docs.columns if name != "mix" else [*docs.columns, "copies_"])
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in NAMES), name


def test_operators_on_clashing_columns(spark):
    docs = table(spark)
    out = langid.identify(docs, langid.learn(docs.select("text", "lang")))
    assert {(r["lang"], r["lang_pred"]) for r in out.collect()} == {("en", "en"), ("de", "de")}
    assert all(r["line_keep"] is None and r["line_id"] == f"line_id{r['doc_id']}" for r in lines.with_bitmaps(docs, lines.keep_bitmaps(docs)).collect())
    assert all(r["copies"] == f"copies{r['doc_id']}" and r["copies_"] == 1 and r["mix_unit"] == f"mix_unit{r['doc_id']}" for r in mixing.mixed_documents(docs).collect())


def test_language_with_few_usable_texts_is_learned(spark):
    rows = [(f"los barcos de la mar son muchos {i} ", "es") for i in range(20)] + [("7", "es")] * 3000 + [(f"the ships of the sea are many {i}", "en") for i in range(300)]
    assert set(langid.learn(spark.createDataFrame(rows, "text string, lang string"), sample_docs=64)) == {"en", "es"}


def test_streams_inflate_piece_by_piece():
    data = [bytes(range(256)) * 4000, b"", b"x" * 10]
    raw = b"".join(gzip.compress(d) for d in data)
    assert b"".join(warc.inflated(io.BytesIO(raw), 1000)) == b"".join(data) == b"".join(warc.inflated(raw, 77))
    for cut in (5, len(raw) // 2, len(raw) - 3):
        try:
            list(warc.inflated(io.BytesIO(raw[:cut]), 1000))
        except ValueError:
            continue
        raise AssertionError(cut)


def test_queries_that_share_an_id_count_as_the_best(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0])]
    got = mih.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 6.0), (2, 1, 3.0)]
