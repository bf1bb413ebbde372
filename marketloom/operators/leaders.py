"""Stock metrics, leadership score, leader lists and their forward validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import cap_class
from ..functions.primitives import average_rank, clip, correlation, decay_of, diff, div, ewm, flag, ordered, over, rank_share, robust_z, roll
from .patterns import phases


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's index."""
    df = df.withColumn("__d", diff(F.col("close"), 1, ordered()))
    df = df.withColumn("__g", F.when(F.col("__d").isNotNull(), F.greatest("__d", F.lit(0.0)))).withColumn("__l", F.when(F.col("__d").isNotNull(), -F.least("__d", F.lit(0.0))))
    df = ewm(ewm(df, "__g", "__ag", decay_of(alpha=1 / n), mp=n), "__l", "__al", decay_of(alpha=1 / n), mp=n)
    return df.withColumn("rsi", 100 - 100 / (1 + F.col("__ag") / (F.col("__al") + 1e-9))).drop("__d", "__g", "__l", "__ag", "__al")


def stock_series(stocks: DataFrame, sectors: DataFrame, holdings: DataFrame) -> DataFrame:
    """A15 for every row: relative strength and flow of a stock against its sector's bars (J6: holdings are a row a stock)."""
    df = stocks.join(holdings, "symbol").join(sectors.select(F.col("symbol").alias("sector"), "dt", F.col("close").alias("sector_close")), ["sector", "dt"], "left")
    w = ordered()
    df = df.withColumn("rs", div(F.col("close"), F.col("sector_close")))
    df = df.withColumn("rs_mom", diff(F.ln("rs"), 20, w)).withColumn("__flow", F.col("ret") * F.col("dollar_vol"))
    df = robust_z(df, "__flow", "__fz", 60, eps=1e-9)
    df = ewm(df, "__fz", "flow_z", decay_of(span=5))
    df = df.withColumn("persistence_10d", F.coalesce(roll(F.sum, flag(F.col("__fz") > 0), over(10), 10), F.lit(0)))
    mean20 = roll(F.avg, F.col("close"), over(20), 20)
    df = df.withColumn("extended", flag(F.col("close") > 1.15 * mean20)).withColumn("climax", flag(F.col("volume") > 2 * roll(F.avg, F.col("volume"), over(20), 20)))
    shape = phases(df.select("symbol", "dt", "open", "high", "low", "close", "volume")).select("symbol", "dt", "score", "phase", "rn")
    score = F.col("score")
    mean10 = roll(F.avg, score, over(10), 10)
    shape = shape.withColumn("stability", mean10 / (roll(F.stddev_samp, score, over(10), 10) + 1e-9) * F.tanh(mean10))
    df = df.join(shape, ["symbol", "dt"], "left")
    held = roll(F.sum, flag(F.greatest(F.col("__fz") * F.col("score"), F.lit(0.0)) > 0.25), over(5), 5)
    return df.withColumn("pattern_persistence", held).withColumnRenamed("score", "pattern_score").withColumnRenamed("phase", "pattern_phase").drop("__flow", "__fz")


def stock_metrics(series: DataFrame, as_of: Column | None = None) -> DataFrame:
    """A15 on the last day (or ``as_of``); stocks without rs_mom or flow_z are left out."""
    day = series.agg(F.max("dt").alias("dt")) if as_of is None else series.select(as_of.alias("dt")).limit(1)
    return series.join(F.broadcast(day), "dt", "left_semi").filter("rs_mom is not null and flow_z is not null")


def leadership(metrics: DataFrame, group: list[str], weights: tuple[float, float, float, float] = (0.35, 0.30, 0.25, 0.10)) -> DataFrame:
    """A14 within ``group``: wls from robust z of momentum, flow, relative structure and stability.

    Where five or more members have a rank correlation of momentum and flow over 0.7, the flow part shrinks.  A missing
    pattern score makes the group's wls NULL.
    """
    w = Window.partitionBy(*group)
    mid = lambda c, q=0.5: F.percentile(c, F.lit(q)).over(w)
    df = metrics
    for c, z in (("rs_mom", "rs_z"), ("flow_z", "flow_n")):
        df = df.withColumn("__m", mid(F.col(c))).withColumn("__a", F.abs(F.col(c) - F.col("__m")))
        df = df.withColumn(z, clip((F.col(c) - F.col("__m")) / (F.greatest(mid(F.col("__a")), F.lit(0.001)) + 1e-9), -3, 3))
    whole = F.count("pattern_score").over(w) == F.count(F.lit(1)).over(w)
    df = df.withColumn("rws", F.when(whole, F.col("pattern_score") / (mid(F.col("pattern_score"), 0.7) + 1e-9)))
    for c, z in (("rws", "rws_z"), ("stability", "stab_z")):
        df = df.withColumn("__m", mid(F.col(c))).withColumn("__a", F.abs(F.col(c) - F.col("__m")))
        df = df.withColumn(z, clip((F.col(c) - F.col("__m")) / (1.4826 * mid(F.col("__a")) + 1e-9), -3, 3))
    df = df.withColumn("__r1", average_rank(F.col("rs_mom"), group)).withColumn("__r2", average_rank(F.col("flow_z"), group))
    df = df.withColumn("rho", F.when(F.count(F.lit(1)).over(w) >= 5, correlation(F.col("__r1"), F.col("__r2"), w)))
    shrink = F.when(F.col("rho") > 0.7, 1 - F.least(F.lit(1.0), (F.col("rho") - 0.7) / 0.3)).otherwise(1.0)
    a, b, c, d = weights
    df = df.withColumn("wls", a * F.col("rs_z") + b * shrink * F.col("flow_n") + c * F.col("rws_z") + d * F.col("stab_z"))
    return df.drop("__m", "__a", "__r1", "__r2", "rws")


def leaders(scored: DataFrame, group: list[str], top: int = 3) -> DataFrame:
    """The best ``top`` of each group with the share of ranks (ties at their average)."""
    df = scored.withColumn("sector_rank_pct", rank_share(F.col("wls"), group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("wls"), "symbol"))
    return df.withColumn("place", place).filter(F.col("place") <= top)


def gate(scored: DataFrame, sector_state: DataFrame) -> DataFrame:
    """A16's gate: sectors in an accumulation or bullish phase that are operable.  sector_state: a row a sector."""
    good = sector_state.filter(F.col("phase").isin("ACUMULACION", "ACUMULACION FUERTE", "CONFIRMACION ALCISTA") & F.col("operability").isin("OPORTUNIDAD CLARA", "OPORTUNIDAD MODERADA"))
    return scored.join(F.broadcast(good.select("sector")), "sector", "left_semi")


def forward_returns(prices: DataFrame, horizon: int, out: str = "ret_fwd") -> DataFrame:
    """(symbol, dt) with the simple return ``horizon`` non-null rows ahead."""
    df = prices.filter("close is not null").select("symbol", "dt", "close")
    return df.select("symbol", "dt", (div(F.lead("close", horizon).over(ordered()), F.col("close")) - 1).alias(out))


def evaluate(leaders_log: DataFrame, stocks: DataFrame, sectors: DataFrame, horizon: int, extra: tuple[str, ...] = (), top: int = 3) -> DataFrame:
    """A21 and A22 (``extra`` = a bucket column, ranked within it): metrics of the top of each day and sector."""
    w = Window.partitionBy(*extra, "dt", "sector").orderBy(F.desc_nulls_last("wls"), "symbol")
    df = leaders_log.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= top)
    df = df.join(forward_returns(stocks, horizon), ["symbol", "dt"], "left").join(forward_returns(sectors, horizon, "ret_etf").withColumnRenamed("symbol", "sector"), ["sector", "dt"], "left")
    df = df.filter("ret_fwd is not null").withColumn("rel", F.col("ret_fwd") - F.col("ret_etf"))
    some = F.count("rel") > 0
    return df.groupBy(*extra).agg(
        F.count("*").alias("observations"), F.avg(flag(F.col("ret_fwd") > 0)).alias("hit_rate"), F.when(some, F.avg(flag(F.col("rel") > 0))).alias("hit_rate_relative"),
        F.avg("rel").alias("alpha"), F.avg("ret_fwd").alias("mean_return"), F.avg("ret_etf").alias("mean_etf_return"),
    )


def buckets(caps: DataFrame) -> DataFrame:
    """(symbol, bucket) from (symbol, cap_musd)."""
    return caps.select("symbol", cap_class(F.col("cap_musd")).alias("bucket"))


def turnover(leaders_log: DataFrame, top: int = 3) -> DataFrame:
    """Mean share of each day's top that was not in the sector's top the day before."""
    w = Window.partitionBy("dt", "sector").orderBy(F.desc_nulls_last("wls"), "symbol")
    tops = leaders_log.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= top).groupBy("sector", "dt").agg(F.collect_set("symbol").alias("t"))
    tops = tops.withColumn("__b", F.lag("t").over(Window.partitionBy("sector").orderBy("dt"))).filter("__b is not null")
    return tops.agg(F.avg(1 - F.size(F.array_intersect("t", "__b")) / F.size("t")).alias("turnover"))


def rank_persistence(leaders_log: DataFrame, least: int = 3) -> DataFrame:
    """Mean rank correlation of wls between a sector's consecutive days, on their common members."""
    days = leaders_log.select("sector", "dt").distinct()
    days = days.withColumn("nxt", F.lead("dt").over(Window.partitionBy("sector").orderBy("dt"))).filter("nxt is not null")
    now = leaders_log.select("sector", "dt", "symbol", F.col("wls").alias("a")).join(days, ["sector", "dt"])
    then = leaders_log.select("sector", F.col("dt").alias("nxt"), "symbol", F.col("wls").alias("b"))
    both = now.join(then, ["sector", "nxt", "symbol"]).withColumn("ra", average_rank(F.col("a"), ["sector", "dt"])).withColumn("rb", average_rank(F.col("b"), ["sector", "dt"]))
    by = both.groupBy("sector", "dt").agg(F.count("*").alias("n"), correlation(F.col("ra"), F.col("rb")).alias("rho")).filter(F.col("n") >= least)
    return by.agg(F.avg("rho").alias("rank_persistence"))


def evaluate_signal(df: DataFrame, signal: str, forward: str, threshold: float = 0.7, lag: int = 1) -> DataFrame:
    """A18 per symbol: days after a signal over the threshold against all days; NULL metrics and a message without any."""
    df = df.withColumn("__hot", flag(F.lag(signal, lag).over(ordered()) > threshold) == 1)
    by = df.groupBy("symbol").agg(F.count(F.when(F.col("__hot"), 1)).alias("n_signals"), F.avg(F.when(F.col("__hot"), F.col(forward))).alias("m"), F.avg(forward).alias("b"), F.avg(F.when(F.col("__hot"), flag(F.col(forward) > 0))).alias("hit_ratio"))
    none = F.format_string(f"No hubo señales con probabilidad > {threshold:.1f} en el periodo analizado.")
    return by.select("symbol", "n_signals", (F.col("m") - F.col("b")).alias("alpha"), "hit_ratio", F.when(F.col("n_signals") == 0, none).alias("message"))
