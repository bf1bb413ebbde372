"""Daily sector snapshot: every scalar score, phase and label of a sector's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders as lad
from ..functions.primitives import change, ordered, over
from .features import activity


def flow_persistence(df: DataFrame, x: str, out: str, n: int = 3) -> DataFrame:
    """Of the last ``n`` non-null values, two or more above 0, or below; zeros count as neither.

    The state is bounded: each value's row holds the values before it, which null rows carry on; no join.
    """
    before = over(None, shift=1)
    df = df.withColumn("__l", F.when(F.col(x).isNotNull(), F.array(x)))
    for k in range(2, n + 1):
        older = F.last("__l", ignorenulls=True).over(before)
        df = df.withColumn("__l", F.when(F.col(x).isNotNull(), F.concat(F.array(x), F.slice(F.coalesce(older, F.array().cast("array<double>")), 1, k - 1))))
    df = df.withColumn("__l", F.last("__l", ignorenulls=True).over(over(None)))
    up, down = F.size(F.filter("__l", lambda v: v > 0)), F.size(F.filter("__l", lambda v: v < 0))
    few = F.col("__l").isNull() | (F.size("__l") < n)
    label = F.when(few, "SIN_DATOS").when(up >= 2, "PERSISTENCIA_ALCISTA").when(down >= 2, "PERSISTENCIA_BAJISTA").otherwise("TRANSICION")
    return df.withColumn(out, label).drop("__l")


def home_z_as_of(days: DataFrame, home: DataFrame) -> DataFrame:
    """dt, home_z: the z of the last report (report_dt, cot_z) up to each day.  A calendar: a day a row."""
    both = days.select("dt", F.lit(1).alias("late"), F.lit(None).cast("struct<z:double>").alias("r")).unionByName(home.select(F.col("report_dt").alias("dt"), F.lit(0).alias("late"), F.struct(F.col("cot_z").alias("z")).alias("r")))
    w = Window.partitionBy(F.lit(1)).orderBy("dt", "late").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("r", F.last("r", ignorenulls=True).over(w)).filter("late = 1").select("dt", F.col("r.z").alias("home_z"))


def snapshot(market: DataFrame, bench: DataFrame, features: DataFrame, home: DataFrame | None = None) -> DataFrame:
    """One row a symbol and day; a missing input makes a score NULL and lets a ladder fall through.

    The conviction is the risk score, adjusted by the home market's positioning z as of the day (``home``: report_dt,
    cot_z; without it, or before its first z, unadjusted), then by volatility; the unified score takes the result.
    """
    df = activity(market, bench).withColumn("price_mom", change(F.col("rel"), 20, ordered()))
    df = df.join(features.select("dt", "breadth_signal", "vix_z"), "dt", "left")
    spread = df.groupBy("dt").agg(F.stddev_samp("flow_mom").alias("flow_dispersion"))
    df = df.join(spread, "dt", "left")
    pm, fm, fa, vz, pz, az, vix = (F.col(c) for c in ("price_mom", "flow_mom", "flow_acc", "vol_z", "price_z", "acc_z", "vix_z"))
    df = df.withColumn("risk_score", lad.distribution_score(pm, fm, fa, vz)).withColumn("binary_score", lad.binary_score(pm, fm, fa, vz))
    df = df.withColumn("phase", lad.phase(pz, fm, az)).withColumn("divergence", lad.divergence(pm, fm))
    df = df.withColumn("p_cont", lad.distribution_probability(F.col("risk_score"))).withColumn("p_bin", lad.binary_probability(F.col("binary_score")))
    df = df.withColumn("opportunity", lad.opportunity(pm, fm, fa, vz, F.col("phase")))
    df = flow_persistence(df, "flow_mom", "persistence")
    if home is None:
        df = df.withColumn("home_z", F.lit(None).cast("double"))
    else:
        df = df.join(F.broadcast(home_z_as_of(bench.select("dt").distinct(), home)), "dt", "left")  # a day a row
    df = df.withColumn("macro_adjusted", lad.macro_adjusted(F.col("risk_score"), F.col("home_z")))
    df = df.withColumn("volatility_adjusted", lad.volatility_adjusted(F.col("macro_adjusted"), vix))
    return df.select(
        "symbol", "dt", "phase", "persistence", "risk_score", "binary_score", "divergence", "p_cont", "p_bin", "opportunity",
        lad.distribution_class(F.col("risk_score")).alias("distribution_class"),
        lad.confidence(F.col("divergence"), vz, fa, F.col("risk_score")).alias("confidence"),
        lad.operability(F.col("opportunity")).alias("operability"),
        lad.direction(fm).alias("direction"),
        lad.signal_state(F.col("persistence"), F.col("phase")).alias("signal_state"),
        lad.alert_level(F.col("binary_score")).alias("alert_level"),
        lad.flow_intensity(fm).alias("flow_intensity"),
        lad.dispersion_text(F.col("flow_dispersion")).alias("dispersion_text"),
        lad.vix_text(vix).alias("vix_text"),
        lad.unified_score(F.col("p_bin"), F.col("p_cont"), F.col("volatility_adjusted"), vix).alias("unified"),
        "macro_adjusted", "volatility_adjusted",
        lad.signal_quality(pm, fm, vz).alias("signal_quality"),
        lad.system_confidence(vix, F.col("breadth_signal"), F.col("flow_dispersion")).alias("system_confidence"),
    )
