"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. language_id: documents that the compression classifier rejects go (no letters, or no margin between languages).
2. line_dedup: repeated long lines go from all documents but the one with the largest doc_id; n_chars follows the text.
3. near_dedup: of each group of near duplicates the document with the least doc_id stays.
4. decontaminate: documents that hold a benchmark item, re-parameterised or not, go.
5. mix: documents are taken 0 to 3 times to meet the sources' target weights (``copies``).

Each stage takes (spark, docs, sf_dir) and all its predecessor kept; all but the last return the columns of documents.
Rows with nulls stay unless a stage's operator says otherwise; rows that share a doc_id stay or go together in stage 3;
an empty table passes through; extra columns pass through, whatever their names (where one is called ``copies``, the
count of the mix is ``copies_``).  A stage's table is deleted once the next one is written.  SQL
cannot express stages 1 and 5, so ``ORACLE_SQL`` is None and tests hold each stage against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.common import checked, drop, fresh, save, small_batches, text_key
from marketloom.llm.decontam import contaminated
from marketloom.llm.langid import identify, learn
from marketloom.llm.lines import keep_bitmaps, kept_text, with_bitmaps
from marketloom.llm.minhash import near_duplicates
from marketloom.llm.mixing import mixed_documents


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def any_names(stage):
    """The stage on columns whose names cannot clash with those that operators add; names come back afterwards."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c.lower() if c.lower() in OWN else f"extra__{i}" for i, c in enumerate(docs.columns)]
        out = stage(spark, docs.toDF(*plain), sf_dir)
        back = dict(zip(plain, docs.columns, strict=True))
        return out.toDF(*(back[c] if c in back else fresh(docs.columns, c)[0] for c in out.columns))

    return run


@any_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identify(docs, learn(docs.select("text", "lang"))).filter("lang_accepted").select(*docs.columns)


@any_names
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = with_bitmaps(docs, keep_bitmaps(docs))
    text_at, keep_at = marked.columns.index("text"), marked.columns.index("line_keep")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            new = [t if k is None else kept_text(t, k)[0] for t, k in zip(texts, batch.column(keep_at).to_pylist(), strict=True)]
            columns = [pa.array(new, pa.binary()).cast(pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != keep_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != "line_keep"])

    small_batches(spark)
    out = marked.mapInArrow(apply, docs.schema)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@any_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = save(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near_gone")
    return docs.join(checked(gone), "doc_id", "left_anti").select(*docs.columns)


@any_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = save(found.select(F.col("doc_id").alias("leak_id"), F.col("tkey").alias("leak_key")).distinct(), "leaks")
    return docs.join(checked(found), F.col("doc_id").eqNullSafe(F.col("leak_id")) & (text_key(F.col("text")) == F.col("leak_key")), "left_anti").select(*docs.columns)


@any_names
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
