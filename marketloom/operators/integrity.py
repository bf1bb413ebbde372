"""Input checks (V1-V6).  Required lists are configuration, a row a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import ladder
from ..functions.primitives import change, ordered


def integrity(bars: DataFrame, required: DataFrame, least: int = 200) -> DataFrame:
    """V1: per required symbol whether it is there and has ``least`` closes, with a message."""
    have = bars.groupBy("symbol").agg(F.count("close").alias("valid_rows"), F.lit(True).alias("present"))
    df = required.join(have, "symbol", "left").select("symbol", F.coalesce("valid_rows", F.lit(0)).cast("bigint").alias("valid_rows"), F.coalesce("present", F.lit(False)).alias("present"))
    ok = F.col("valid_rows") >= least
    message = F.when(~F.col("present"), F.lit("missing")).otherwise(F.format_string("%d valid rows of %d", F.col("valid_rows"), F.lit(least)))
    return df.withColumn("ok", ok).withColumn("message", message)


def global_gate(bars: DataFrame, strict: bool = False) -> DataFrame:
    """V2 (and V3 with ``strict``): null share, non-positive closes, five-row moves; first failure wins."""
    df = bars.withColumn("__r", F.abs(change(F.col("close"), 5, ordered())))
    df = df.groupBy("symbol").agg(F.avg(F.col("close").isNull().cast("double")).alias("null_share"), F.min("close").alias("min_close"), F.max("__r").alias("max_ret"), F.min("volume").alias("min_volume"))
    nulls, low, wild = F.col("null_share") > 0.1, F.col("min_close") <= 0, F.col("max_ret") > (0.25 if strict else 0.40)
    rungs = [(nulls, "DATA ISSUE (NaNs >10%)"), (low, "DATA ISSUE (close <=0)")]
    rejected = nulls | low | wild
    if strict:
        negative = F.col("min_volume") < 0
        rungs += [(negative, "DATA ISSUE (negative volume)"), (wild, "DATA ISSUE (extreme weekly return >25%)")]
        rejected = rejected | negative
    else:
        rungs += [(wild, "DATA ISSUE (extreme weekly return >40%)"), (F.col("max_ret") > 0.25, "EXTREME EVENT (ret >25%, señal válida pero inusual)")]
    return df.withColumn("issue", ladder(*rungs, otherwise=F.lit(None).cast("string"))).withColumn("valid", F.coalesce(~rejected, F.lit(True)))


def series_gate(bars: DataFrame, null_share: float = 0.2, least: int = 60) -> DataFrame:
    """V4."""
    return bars.groupBy("symbol").agg(((F.avg(F.col("close").isNull().cast("double")) <= null_share) & (F.count("close") >= least)).alias("ok"))


def coverage(bars: DataFrame, required: DataFrame, share: float = 0.7) -> DataFrame:
    """V6 missing required symbols, each with V5's flag whether too few symbols are there at all."""
    have = bars.select("symbol").distinct()
    n, need = have.agg(F.count("*").alias("n")), required.agg(F.count("*").alias("need"))
    missing = required.join(have, "symbol", "left_anti").select(F.col("symbol").alias("missing"))
    return missing.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(need)).select("missing", (F.col("n") < F.col("need") * share).alias("low_coverage"))
