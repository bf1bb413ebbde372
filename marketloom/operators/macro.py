"""Macro score, its series, and the quantitative regime.

Inputs are one row a day: credit_up, credit_down, long_rate, short_rate, vix, benchmark, and breadth where known.
Signs are those of the analytics: the credit and curve signals fall as their z rises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ladders import ladder
from ..functions.primitives import clip, div, ordered, over, robust_z, roll, unit


def macro_inputs(market: DataFrame, vix: DataFrame, bench: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Pick the symbols of ``roles`` (role -> symbol) into columns; one row a day."""
    wide = market.groupBy("dt").agg(*[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(r) for r, s in roles.items()])
    return wide.join(vix, "dt", "left").join(bench.withColumnRenamed("bench", "benchmark"), "dt", "left").withColumn("one", F.lit(1))


def macro_series(inputs: DataFrame, features: DataFrame) -> DataFrame:
    """W12 for every day, W13: NULL in the first 60 rows; breadth is 0 on days without features."""
    key = "one"
    df = inputs.join(features.select("dt", "breadth_signal"), "dt", "left")
    df = df.withColumn("credit", div(F.col("credit_up"), F.col("credit_down"))).withColumn("curve", F.col("long_rate") / 100 - F.col("short_rate") / 100)
    df = robust_z(df, "credit", "credit_z", 60, mp=20, limit=5.0, key=key)
    df = robust_z(df, "curve", "curve_z", 120, mp=20, limit=5.0, key=key)
    df = robust_z(df, "vix", "vix_rz", 60, mp=20, limit=5.0, key=key)
    df = df.withColumn("rn", F.row_number().over(ordered(key)))
    slope = F.when(F.count("vix").over(over(5, key)) >= 5, F.regr_slope("vix", F.col("rn").cast("double")).over(over(5, key)))
    df = df.withColumn("vix_slope", slope)
    signal = lambda z: 2 * ((1 - clip(F.col(z), 0, 2) / 2) - 0.5)
    fear = 2 * (F.exp(-F.col("vix_rz")) * (1 - F.tanh("vix_slope")) - 0.5)
    score = F.tanh(0.3 * signal("credit_z") + 0.3 * signal("curve_z") + 0.2 * fear + 0.2 * clip(F.coalesce("breadth_signal", F.lit(0.0)), -1, 1))
    return df.withColumn("macro_score", score).withColumn("macro", F.when(F.col("rn") > 60, F.col("macro_score")))


def regime_score(inputs: DataFrame, features: DataFrame) -> DataFrame:
    """W14 for every day: regime_score (0.5 where a part is missing) and its label."""
    key = "one"
    df = macro_series(inputs, features).join(features.select("dt", "vix_z"), "dt", "left")
    b = F.col("benchmark")
    trend = unit(5 * (div(roll(F.avg, b, over(50, key), 50), roll(F.avg, b, over(200, key), 200)) - 1))
    fear = clip(F.exp(-F.col("vix_z")) * (1 - F.tanh("vix_slope")), 0, 1)
    score = 0.4 * trend + 0.2 * clip((F.col("breadth_signal") + 0.5) / 1.5, 0, 1) + 0.2 * fear + 0.2 * (1 - clip(F.col("credit_z"), 0, 2) / 2)
    df = df.withColumn("regime_score", F.coalesce(clip(score, 0, 1), F.lit(0.5)))
    return df.withColumn("regime", ladder((F.col("regime_score") > 0.6, "EXPANSION"), (F.col("regime_score") < 0.4, "CONTRACTION"), otherwise="TRANSITION"))
