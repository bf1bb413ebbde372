"""Bar-pattern score, phases and their series.

The score and the structure of a day depend on that day and earlier ones alone, so the series of all prefixes is the
column itself: O(n w), where recomputing each prefix is O(n**2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import ladder
from ..functions.primitives import change, clip, diff, div, flag, ordered, over, robust_z, roll, sigmoid, zscore

OHLCV = ["open", "high", "low", "close", "volume"]


def pattern_score(bars: DataFrame) -> DataFrame:
    """compression (W1), absorption (W2), spring (W3), sos (W4), suppression (W5), score (W6), of complete bars only."""
    w = ordered()
    df = bars.na.drop(subset=OHLCV)
    high, low, close, volume = (F.col(c) for c in ("high", "low", "close", "volume"))
    df = df.withColumn("compression", div(roll(F.max, high, over(20), 20) - roll(F.min, low, over(20), 20), close))
    df = zscore(df, "volume", "__vz", 20).withColumn("__pc", change(close, 20, w))
    df = robust_z(df, "__pc", "__pz", 60, mp=20, limit=5.0).withColumn("absorption", sigmoid(F.col("__vz") - F.col("__pz")))
    mean_volume = roll(F.avg, volume, over(20), 20)
    df = df.withColumn("spring", flag((low < F.lag("low").over(w)) & (close > F.col("open")) & (volume > 1.5 * mean_volume)))
    df = df.withColumn("sos", flag((close > roll(F.max, high, over(20, shift=1), 20)) & (volume > mean_volume)))
    df = df.withColumn("__ma", roll(F.avg, close, over(50), 50))
    df = df.withColumn("suppression", flag(F.abs(diff(F.col("__ma"), 1, w)) < 0.1 * roll(F.stddev_samp, close, over(50), 50)))
    quiet = 1 - F.when(F.col("compression").isNotNull(), F.least(F.col("compression"), F.lit(1.0)))
    raw = 0.25 * quiet + 0.25 * clip(F.col("absorption"), 0, 2) / 2 + 0.2 * F.col("spring") + 0.2 * F.col("sos") + 0.1 * F.col("suppression")
    return df.withColumn("score", clip(raw, 0, 1)).drop("__vz", "__pc", "__pz", "__ma")


def phases(bars: DataFrame) -> DataFrame:
    """W8 phase of each day, W7 structure, W9 and W10 series (NULL in the first 200 and 60 rows)."""
    w = ordered()
    df = pattern_score(bars).withColumn("rn", F.row_number().over(w))
    df = df.withColumn(
        "phase", ladder((F.col("rn") < 60, "INSUFICIENTE"), (F.col("spring") == 1, "SPRING"), (F.col("sos") == 1, "MARKUP INIT"), (F.col("score") > 0.7, "ACCUMULATION"), (F.col("score") > 0.5, "LATE ACCUMULATION"), otherwise="NEUTRAL")
    )
    close = F.col("close")
    df = df.withColumn("trend", div(roll(F.avg, close, over(50), 50), roll(F.avg, close, over(200), 200)) - 1)
    df = df.withColumn("__r", change(close, 1, w)).withColumn("__v", roll(F.stddev_samp, F.col("__r"), over(20), 20))
    df = df.withColumn("vol_norm", F.col("__v") / (F.avg("__v").over(over(None)) + 1e-9))
    structure = ladder(
        (F.col("rn") < 200, "INSUFICIENT_DATA"),
        ((F.col("trend") > 0.02) & (F.col("vol_norm") < 1) & (F.col("score") > 0.6), "MARKUP"),
        (F.col("trend") < -0.02, "DISTRIBUTION"),
        ((F.col("compression") < 0.3) & (F.col("score") > 0.5), "ACCUMULATION"),
        otherwise="RANGE",
    )
    df = df.withColumn("structure", structure).drop("__r", "__v")
    return df.withColumn("structure_series", F.when(F.col("rn") > 200, F.col("structure"))).withColumn("score_series", F.when(F.col("rn") > 60, F.col("score")))


def transitions(df: DataFrame, lookback: int = 5) -> DataFrame:
    """W11 on the output of ``phases``: how the structure moved over ``lookback`` rows."""
    w = ordered()
    now, before = F.col("structure_series"), F.lag("structure_series", lookback).over(w)
    gain = F.col("score_series") - F.lag("score_series", lookback).over(w)
    df = df.withColumn("__b", before).withColumn("__g", gain)
    b, g = F.col("__b"), F.col("__g")
    up = ((b == "RANGE") | (b == "ACCUMULATION")) & (now == "MARKUP")
    down = ((b == "MARKUP") & (now == "DISTRIBUTION")) | ((b == "DISTRIBUTION") & (now == "RANGE"))
    force = lambda c: F.when(c, "FUERTE").otherwise("DÉBIL")
    text = ladder(
        (F.col("rn") < lookback + 1, "SIN DATOS SUFICIENTES"),
        (now.isNull() | b.isNull(), "DATOS INSUFICIENTES"),
        (now == b, F.concat(F.lit("ESTABLE ("), now, F.lit(")"))),
        (up, F.concat(F.lit("TRANSICIÓN ALCISTA: "), b, F.lit(" → "), now, F.lit(" ("), force(g > 0.2), F.lit(")"))),
        (down, F.concat(F.lit("TRANSICIÓN BAJISTA: "), b, F.lit(" → "), now, F.lit(" ("), force(-g > 0.2), F.lit(")"))),
        otherwise=F.concat(F.lit("CAMBIO DE FASE: "), b, F.lit(" → "), now),
    )
    return df.withColumn("transition", text).drop("__b", "__g")
