"""Price and flow features: momentum, breadth, dispersion, z-scores, the flow radar and its rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ladders import flow_regime, price_action, price_regime
from ..functions.primitives import average_rank, change, correlation, decay_of, diff, div, ewm, flag, ordered, over, robust_z, roll, zscore


def with_flow(market: DataFrame) -> DataFrame:
    """flow = one-row return x dollar volume."""
    return market.withColumn("flow", F.col("ret") * F.col("dollar_vol"))


def robust_variants(market: DataFrame) -> DataFrame:
    """The robust z of flow with each guard the analytics use, and its tanh."""
    df = with_flow(market)
    df = robust_z(df, "flow", "z_features", 60, mp=20, limit=5.0)
    df = robust_z(df, "flow", "z_options", 60, eps=1e-9, limit=5.0)
    df = robust_z(df, "flow", "z_stock", 60, eps=1e-9)
    return df.withColumn("z_tanh", F.tanh("z_options"))


def flow_momentum(market: DataFrame) -> DataFrame:
    """R13 series: flow, its robust z (60, from 20 on, clipped at 5) and the smoothed flow_mom (span 10, from 20 on).

    A symbol without any volume has flow_mom 0.
    """
    df = robust_z(with_flow(market), "flow", "flow_z", 60, mp=20, limit=5.0)
    df = ewm(df, "flow_z", "flow_mom", decay_of(span=10), mp=20)
    silent = F.count("volume").over(Window.partitionBy("symbol")) == 0
    return df.withColumn("flow_mom", F.when(silent, F.lit(0.0)).otherwise(F.col("flow_mom")))


def last_day(df: DataFrame) -> DataFrame:
    """Rows of the latest day (a NULL there is an answer, not a reason to look further back)."""
    return df.join(F.broadcast(df.agg(F.max("dt").alias("dt"))), "dt", "left_semi")


def flow_radar(market: DataFrame) -> DataFrame:
    """Rank of flow_mom on the last day, cross-sectional dispersion, share above 0, and the regime."""
    last = last_day(flow_momentum(market)).select("symbol", "dt", "flow_mom")
    cross = last.agg(F.stddev_samp("flow_mom").alias("flow_dispersion"), F.avg(flag(F.col("flow_mom") > 0)).alias("flow_breadth"))
    out = last.crossJoin(F.broadcast(cross))  # one row
    rank = F.row_number().over(ordered("dt", "symbol").orderBy(F.desc_nulls_last("flow_mom"), "symbol"))
    return out.withColumn("rank", rank).withColumn("regime", flow_regime(F.col("flow_breadth"), F.col("flow_dispersion")))


def relative(market: DataFrame, bench: DataFrame) -> DataFrame:
    """rel: close over the benchmark's close of the day (J5: one row a day, broadcast by size)."""
    return market.join(bench, "dt", "left").withColumn("rel", div(F.col("close"), F.col("bench")))


def price_momentum(market: DataFrame, bench: DataFrame, window: int = 20) -> DataFrame:
    """Change of rel over ``window`` rows on the last day, ranked."""
    df = relative(market, bench).withColumn("momentum", change(F.col("rel"), window, ordered()))
    last = last_day(df).select("symbol", "dt", "momentum")
    return last.withColumn("rank", F.row_number().over(ordered("dt", "symbol").orderBy(F.desc_nulls_last("momentum"), "symbol")))


def activity(market: DataFrame, bench: DataFrame) -> DataFrame:
    """vol_z (20), price_z (60 from 20), flow_acc (to its 5-row mean), acc_z (20 from 10)."""
    df = relative(flow_momentum(market), bench)
    df = zscore(df, "dollar_vol_smoothed", "vol_z", 20)
    df = zscore(df, "rel", "price_z", 60, mp=20)
    df = df.withColumn("flow_acc", F.col("flow_mom") - roll(F.avg, F.col("flow_mom"), over(5), 5))
    return zscore(df, "flow_acc", "acc_z", 20, mp=10, eps=1e-9)


def breadth(market: DataFrame, window: int = 100, weights: DataFrame | None = None) -> DataFrame:
    """Dt, breadth: weighted share above the moving average, less one half; NULL counts as below.

    ``weights`` (symbol, weight) is configuration: symbols that it lacks do not count.  Without it all weigh the same.
    """
    if weights is not None:
        above = flag(F.col("close") > roll(F.avg, F.col("close"), over(window), window))
        held = market.withColumn("above", above).join(F.broadcast(weights), "symbol")
        return held.groupBy("dt").agg(F.sum(F.col("weight") * (F.col("above") - 0.5)).alias("breadth"))
    n = market.select("symbol").distinct().agg(F.count("*").alias("n"))
    above = flag(F.col("close") > roll(F.avg, F.col("close"), over(window), window))
    df = market.withColumn("above", above).crossJoin(F.broadcast(n))  # one row
    return df.groupBy("dt").agg(F.sum((F.col("above") - 0.5) / F.col("n")).alias("breadth"))


def features_daily(market: DataFrame, bench: DataFrame, vix: DataFrame) -> DataFrame:
    """Dt, breadth_signal (the negative of R10), sector_dispersion, vix_z, stress; days with all of them."""
    rel = relative(market, bench).withColumn("mom", diff(F.ln("rel"), 20, ordered()))
    spread = rel.groupBy("dt").agg(F.stddev_samp("mom").alias("sector_dispersion"))
    fear = zscore(vix.withColumn("one", F.lit(1)), "vix", "vix_z", 100, key="one").select("dt", "vix_z")
    out = breadth(market).select("dt", (-F.col("breadth")).alias("breadth_signal")).join(spread, "dt").join(fear, "dt")
    return out.withColumn("stress", flag(F.col("vix_z") > 1.5)).na.drop()


def radar(market: DataFrame, bench: DataFrame, vix: DataFrame) -> DataFrame:
    """The price ranking with the regime of the last feature day."""
    last = last_day(features_daily(market, bench, vix)).drop("dt")
    out = price_momentum(market, bench).crossJoin(F.broadcast(last))  # one row
    args = [F.col(c) for c in ("breadth_signal", "sector_dispersion", "stress", "vix_z")]
    return out.withColumn("regime", price_regime(*args)).withColumn("action", price_action(*args))


def cross_alerts(price: DataFrame, flow: DataFrame) -> DataFrame:
    """RED for the best two in price among the worst two in flow, GREEN for the reverse.  Needs rank columns."""
    n = price.agg(F.count("*").alias("n"))
    both = price.select("symbol", F.col("rank").alias("price_rank")).join(flow.select("symbol", F.col("rank").alias("flow_rank")), "symbol").crossJoin(F.broadcast(n))
    top, low = (lambda c: F.col(c) <= 2), (lambda c: F.col(c) > F.col("n") - 2)
    alert = F.when(top("price_rank") & low("flow_rank"), "RED").when(low("price_rank") & top("flow_rank"), "GREEN")
    return both.withColumn("alert", alert).drop("n")


def ranking_volatility(flow: DataFrame, days: int = 5) -> DataFrame:
    """Mean absolute rank change between the last ``days`` days, over the number of symbols."""
    recent = flow.select("dt").distinct().orderBy(F.desc("dt")).limit(days)
    df = flow.join(F.broadcast(recent), "dt", "left_semi").withColumn("r", average_rank(F.col("flow_mom"), ["dt"], descending=True))
    df = df.withColumn("step", F.abs(F.col("r") - F.lag("r").over(ordered())))
    by_day = df.filter("step is not null").groupBy("dt").agg(F.avg("step").alias("step"))
    n = df.select("symbol").distinct().agg(F.count("*").alias("n"))
    return by_day.agg(F.avg("step").alias("step")).crossJoin(F.broadcast(n)).select((F.col("step") / F.col("n")).alias("ranking_volatility"))


def mean_correlation(market: DataFrame, rows: int = 60) -> DataFrame:
    """Mean pairwise correlation of the last ``rows`` returns (pairs of symbols join on the day), warning over 0.7."""
    recent = market.select("dt").distinct().orderBy(F.desc("dt")).limit(rows)
    x = market.join(F.broadcast(recent), "dt", "left_semi").filter("ret is not null").select("dt", "symbol", "ret")
    pairs = x.alias("a").join(x.alias("b"), (F.col("a.dt") == F.col("b.dt")) & (F.col("a.symbol") < F.col("b.symbol")))
    by = pairs.groupBy(F.col("a.symbol").alias("a"), F.col("b.symbol").alias("b")).agg(F.when(F.count("*") >= 2, correlation(F.col("a.ret"), F.col("b.ret"))).alias("c"))
    return by.agg(F.avg("c").alias("mean_correlation")).withColumn("high", flag(F.col("mean_correlation") > 0.7))


def dispersion_history(flow: DataFrame, rows: int = 60) -> DataFrame:
    """S20 data: daily cross-sectional std of flow_mom, the last ``rows`` days, with its 70 % and 30 % quantiles."""
    by = flow.groupBy("dt").agg(F.stddev_samp("flow_mom").alias("dispersion")).filter("dispersion is not null").orderBy(F.desc("dt")).limit(rows)
    lines = by.agg(F.percentile("dispersion", F.lit(0.7)).alias("high_line"), F.percentile("dispersion", F.lit(0.3)).alias("low_line"))
    return by.crossJoin(F.broadcast(lines))


