"""Language ID by compression: the language whose zstandard dictionary encodes a text in the fewest bytes.

Learning.  For each language a bounded sample of labelled texts (``sample_docs`` expected texts of 20 to 20,000
characters with a letter, chosen by text hash, equal texts once; those of 200 and more if there are any) fills a raw-content dictionary of ``dict_bytes``; nothing else is
learned, and the sample is all that reaches the driver.  Prediction reads the text alone.

A text is lower-cased and encoded in pieces of ``piece`` bytes, each against every dictionary, so a long text leans on
the dictionaries all along and not on itself; of a short text every suffix that begins a word is encoded instead,
which splits ties of whole bytes.  score = 1 / sum over languages of 2**(best - size): one byte counts as one bit of
evidence.  ``accepted`` is false where the best size is within ``margin`` (relative) of the second best.

Defined cases: a null text, or one without letters, is ``und`` with score 0, not accepted; ties go to the first
language by code point and are not accepted; with one language all texts with letters are accepted; without labelled
texts all are ``und``; rows repeat as they come; an empty table gives an empty result; extra columns stay, but for
such as are called lang_pred, lang_score or lang_accepted, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches

UND = "und"
SHORT = 400
#: Goes before a short text: without it the encoder stores what it can't shorten by some bytes as it is.
CARRIER = b"\x00" * 96
PARAMETERS = dict(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY)


def crc_part(doc_id: Column, parts: int = 4) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def learn(labelled: DataFrame, dict_bytes: int = 1 << 16, sample_docs: int = 256) -> dict[str, bytes]:
    """A dictionary for each language of ``labelled`` (text, lang)."""
    usable = labelled.select("text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.length("text").between(20, 20000))
    # the draw is a share of the usable texts, so a language with few of them keeps them all
    found = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not found:
        return {}
    share = F.lit(0)
    for lang, n in sorted(found.items()):
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, sample_docs / n) * (1 << 30)))).otherwise(share)
    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    rows = usable.withColumn("draw", draw).filter(F.col("draw") < share).dropDuplicates(["lang", "draw"]).collect()
    out = {}
    for lang in sorted(found):
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: r["draw"])
        long = [r for r in own if len(r["text"]) >= 200] or own
        data = b"\n".join(r["text"].lower().encode() for r in long[:sample_docs])
        if data:
            out[lang] = data[:dict_bytes]
    return out


def _compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in dictionaries.values():
        p = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **PARAMETERS)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def pieces(data: bytes, size: int) -> list[bytes]:
    if len(data) > SHORT:
        return [data[i : i + size] for i in range(0, len(data), size)]
    data = b" " + data + b" "
    return [CARRIER + data[i:] for i, c in enumerate(data[:-1]) if c == 32 and data[i + 1] != 32]


def judge(text: str, compressors: list[zstandard.ZstdCompressor], piece: int) -> tuple[int, float, float]:
    """(number of the best language, score, relative margin)."""
    parts = pieces(text.lower().encode(), piece)
    sizes = [sum(len(c.compress(p)) for p in parts) for c in compressors]
    best = min(sizes)
    second = min([s for i, s in enumerate(sizes) if i != sizes.index(best)], default=None)
    score = 1.0 / sum(2.0 ** -min(s - best, 1000) for s in sizes)
    return sizes.index(best), score, 1.0 if second is None else (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], piece: int = 4096, margin: float = 0.001, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_accepted."""
    langs = list(dictionaries)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_accepted")]
    (letters_col,) = fresh(kept, "has_letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(dictionaries)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            letters = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(at).to_pylist()
            pred, score, accepted = [], [], []
            for text, ok in zip(texts, letters, strict=True):
                if not ok or not langs:
                    pred.append(UND), score.append(0.0), accepted.append(False)
                else:
                    best, s, m = judge(text, compressors, piece)
                    pred.append(langs[best]), score.append(s), accepted.append(m >= margin)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*kept, "lang_pred", "lang_score", "lang_accepted"])

    small_batches(docs.sparkSession)
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("lang_score", "double").add("lang_accepted", "boolean")
    return docs.select(*kept, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters_col)).mapInArrow(run, schema)
