"""Flow attribution and the causal chain (R15-R23, P1-P5 applied)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import ladder
from ..functions.primitives import clip, decay_of, diff, ewm, ffill, ordered, over, quantile, robust_z, roll, share_below
from .staging import staged


def orthogonal(df: DataFrame, base: str, target: str, out: str, n: int = 60) -> DataFrame:
    """Target - beta base, beta = rolling covariance / (variance of base + 1e-9)."""
    w = over(n)
    x, y = F.col(base), F.col(target)
    both = F.when(x.isNotNull() & y.isNotNull(), x), F.when(x.isNotNull() & y.isNotNull(), y)
    cov = F.when(F.count(both[0]).over(w) >= n, F.covar_samp(*both).over(w))
    return df.withColumn(out, y - cov / (roll(F.var_samp, x, w, n) + 1e-9) * x)


def flow_attribution(market: DataFrame, window: int = 20) -> DataFrame:
    """Persistence, intensity and irregularity of flow, made orthogonal in this order (R16), as centred rolling
    percentiles (R17) with 70 % thresholds (R18); flow_type of the row."""
    df = market.withColumn("flow", F.col("ret") * F.col("dollar_vol"))
    w, flow = over(window), F.col("flow")
    df = df.withColumn("__sign", F.signum(flow)).withColumn("__mean", roll(F.avg, flow, w, window))
    df = df.withColumn("__p", roll(F.avg, F.col("__sign"), w, window))
    df = df.withColumn("__i", F.col("__mean") / (roll(F.stddev_samp, flow, w, window) + 1e-9))
    df = df.withColumn("__res", F.abs(flow - F.col("__mean"))).withColumn("__abs", F.abs(flow))
    df = df.withColumn("__ir", roll(F.avg, F.col("__res"), w, window) / (roll(F.avg, F.col("__abs"), w, window) + 1e-9))
    for c, z in (("__p", "persistence"), ("__i", "intensity"), ("__ir", "irregularity")):
        df = robust_z(df, c, z, 60, eps=1e-9)
    df = orthogonal(df, "persistence", "intensity", "__io")
    df = orthogonal(df, "persistence", "irregularity", "__ia")
    df = orthogonal(df, "__io", "__ia", "__iro")
    for c, out in (("persistence", "persistence_orth"), ("__io", "intensity_orth"), ("__iro", "irregularity_orth")):
        df = share_below(df, c, out, 120)
        df = df.withColumn(out, (F.col(out) - 0.5) * 2)
        df = df.withColumn(f"{out}_p70", roll(quantile(0.7), F.col(out), over(120), 120))
    above = lambda c: F.col(f"{c}_orth") > F.col(f"{c}_orth_p70")
    kind = ladder((above("persistence") & above("intensity"), "CONVICTION"), (above("irregularity"), "MECHANICAL"), (above("intensity"), "PASSIVE"), otherwise="NEUTRAL")
    return df.withColumn("flow_type", kind).drop("__sign", "__mean", "__p", "__i", "__res", "__abs", "__ir", "__io", "__ia", "__iro")


def composite_flow(df: DataFrame) -> DataFrame:
    """The flow signal, its momentum (R15) and its stability over 5 rows."""
    df = df.withColumn("signal", 0.5 * F.col("persistence_orth") + 0.3 * F.col("intensity_orth") - 0.2 * F.col("irregularity_orth"))
    w = ordered()
    df = df.withColumn("__d1", diff(F.col("signal"), 3, w))
    df = df.withColumn("__d2", diff(F.col("__d1"), 3, w))
    df = ewm(df, "__d2", "flow_momentum", decay_of(span=5))
    return df.withColumn("flow_stability", clip(1 - roll(F.stddev_samp, F.col("signal"), over(5), 5), 0, 1)).drop("__d1", "__d2")


def regression_residual(df: DataFrame, x: str, y: str, out: str, window: int = 60) -> DataFrame:
    """Y - its weighted least-squares line on x over the previous ``window`` rows (the current one excluded).

    Weights 1 / (1 + |y - median y|); fewer than two complete pairs: NULL; x without spread: y - mean.  NULL in the
    first ``window`` rows of a symbol.
    """
    pair = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(over(window, shift=1))
    df = df.withColumn("__rn", F.row_number().over(ordered())).withColumn("__l", F.filter(pair, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    n = F.size("__l")
    ys = F.array_sort(F.transform("__l", lambda p: p["y"]))
    mid = F.when(n % 2 == 1, F.get(ys, (n / 2).cast("int"))).otherwise((F.get(ys, (n / 2).cast("int") - 1) + F.get(ys, (n / 2).cast("int"))) / 2)
    df = df.withColumn("__m", F.when(n > 0, mid))
    total = lambda f: F.aggregate("__l", F.lit(0.0), lambda a, p: a + f(p))
    weight = lambda p: 1 / (1 + F.abs(p["y"] - F.col("__m")))
    sums = {"__sw": lambda p: weight(p), "__sx": lambda p: weight(p) * p["x"], "__sy": lambda p: weight(p) * p["y"], "__sxx": lambda p: weight(p) * p["x"] * p["x"], "__sxy": lambda p: weight(p) * p["x"] * p["y"], "__ux": lambda p: p["x"], "__uy": lambda p: p["y"]}
    for name, f in sums.items():
        df = df.withColumn(name, total(f))
    mean_x = F.col("__ux") / F.nullif(n, F.lit(0))
    df = df.withColumn("__mx", mean_x).withColumn("__var", F.aggregate("__l", F.lit(0.0), lambda a, p: a + (p["x"] - F.col("__mx")) * (p["x"] - F.col("__mx"))) / F.nullif(n, F.lit(0)))
    c = F.col
    slope = (c("__sw") * c("__sxy") - c("__sx") * c("__sy")) / F.nullif(c("__sw") * c("__sxx") - c("__sx") * c("__sx"), F.lit(0.0))
    line = (c("__sy") - slope * c("__sx")) / F.nullif(c("__sw"), F.lit(0.0)) + slope * c(x)
    value = F.when(n < 2, F.lit(None).cast("double")).when(F.sqrt(c("__var")) < 1e-9, c(y) - c("__uy") / n).otherwise(c(y) - line)
    return df.withColumn(out, F.when(c("__rn") > window, value)).drop("__rn", "__l", "__m", "__mx", "__var", *sums)


def decayed(df: DataFrame, x: str, out: str, halflife: float = 5) -> DataFrame:
    """Recursive exponential mean over the non-null values, carried over nulls; unchanged below ``halflife`` values."""
    df = staged(df)  # read by both sides of the join below
    known = df.filter(F.col(x).isNotNull()).select("symbol", "dt", x)
    smooth = ewm(known, x, "__s", decay_of(halflife=halflife), adjust=False).select("symbol", "dt", "__s")
    df = df.join(smooth, ["symbol", "dt"], "left")
    enough = F.count(x).over(Window.partitionBy("symbol")) >= halflife
    return df.withColumn(out, F.when(enough, ffill(F.col("__s"), over(None))).otherwise(F.col(x))).drop("__s")


def joint_shift(macro: Column, flow: Column, threshold: float = 0.2, n: int = 5) -> Column:
    """1 or -1 where both moved by more than the threshold over ``n`` rows the same way, else 0."""
    w = ordered()
    dm, df_ = diff(macro, n, w), diff(flow, n, w)
    return F.when((dm > threshold) & (df_ > threshold), 1).when((dm < -threshold) & (df_ < -threshold), -1).otherwise(0)


def causal_chain(attribution: DataFrame, macro: DataFrame, structure: DataFrame, window: int = 60) -> DataFrame:
    """E1's chain for every row: robust z of macro and flow on their common days, residual of flow on macro, both
    smoothed, with the transition (R22) and the structure's value, ready for edge, truth, alignment and tradeable."""
    df = attribution.select("symbol", "dt", "signal").join(macro.select("dt", "macro"), "dt").join(structure.select("symbol", "dt", "structure"), ["symbol", "dt"])
    df = df.withColumn("transition", joint_shift(F.col("macro"), F.col("signal")))
    df = staged(df)
    common = df.filter("macro is not null and signal is not null").select("symbol", "dt", "macro", "signal")
    common = robust_z(robust_z(common, "macro", "macro_z", window, eps=1e-9), "signal", "flow_z", window, eps=1e-9).filter("macro_z is not null and flow_z is not null")
    residual = regression_residual(common, "macro_z", "flow_z", "flow_orthogonal", window).select("symbol", "dt", "macro_z", "flow_z", "flow_orthogonal")
    df = df.join(residual, ["symbol", "dt"], "left")
    df = decayed(decayed(df, "macro", "macro_smooth"), "flow_orthogonal", "flow_smooth")
    return df.withColumn("structure_value", F.when(F.col("structure") == "MARKUP", 1.0).when(F.col("structure") == "DISTRIBUTION", -1.0).otherwise(0.0))


