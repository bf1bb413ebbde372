"""Market tables in long form: bars on a shared calendar, and the other inputs, from files or from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.primitives import change, ffill, ordered, over, roll
from .staging import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """One row a trade: symbol, day, price in whole cents, quantity and a total order.  level: region, nation, stock, sector or market."""
    li = table(spark, sf_dir, "lineitem")
    if level in ("region", "nation"):
        li = li.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        li = li.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        if level == "region":
            li = li.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        symbol = F.col("r_name" if level == "region" else "n_name")
    elif level == "stock":
        li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        symbol = F.concat_ws("|", "p_type", "p_brand")
    elif level == "sector":
        li = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        symbol = F.col("p_type")
    else:
        symbol = F.lit("MARKET")
    tie = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(symbol.alias("symbol"), F.to_date("l_shipdate").alias("dt"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100.0).alias("price"), F.col("l_quantity").alias("qty"), tie.alias("tie"))


def daily_bars(trade: DataFrame) -> DataFrame:
    """symbol, dt, open, high, low, close, volume: one shuffle with map-side combine."""
    return trade.groupBy("symbol", "dt").agg(
        F.min_by("price", "tie").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tie").alias("close"), F.sum(F.col("qty").cast("bigint")).cast("double").alias("volume")
    )


def weekly_bars(bars: DataFrame) -> DataFrame:
    """Bars of Monday weeks from daily bars."""
    week = F.to_date(F.date_trunc("week", "dt"))
    return bars.groupBy("symbol", week.alias("week")).agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("week", "dt")


def spine(bars: DataFrame, fill: bool = True) -> DataFrame:
    """Every symbol on every day that any symbol has; prices and volume carried forward (missing before the first bar).

    The calendar and the symbol list are dimension tables: a day a row and a symbol a row.
    """
    grid = bars.select("dt").distinct().join(F.broadcast(bars.select("symbol").distinct()), how="cross")
    full = grid.join(bars, ["symbol", "dt"], "left")
    if not fill:
        return full
    w = over(None)
    return full.select("symbol", "dt", *[ffill(F.col(c), w).alias(c) for c in ("open", "high", "low", "close", "volume")])


def dollar_volume(bars: DataFrame, smooth: int = 3) -> DataFrame:
    """S3: dollar_vol = close x volume and its ``smooth``-row mean from one row on; ret: one-row return."""
    out = bars.withColumn("dollar_vol", F.col("close") * F.col("volume")).withColumn("ret", change(F.col("close"), 1, ordered()))
    return out.withColumn("dollar_vol_smoothed", roll(F.avg, F.col("dollar_vol"), over(smooth), 1))


def market(spark: SparkSession, sf_dir: str, level: str = "region", grain: str = "day") -> DataFrame:
    """Filled bars with dollar volume and returns.  Daily bars are staged: the trades are read once, whatever follows."""
    bars = staged(daily_bars(trades(spark, sf_dir, level)))
    return dollar_volume(spine(weekly_bars(bars) if grain == "week" else bars))


def benchmark(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """dt, bench: close of all regions pooled."""
    bars = staged(daily_bars(trades(spark, sf_dir, "market")))
    bars = weekly_bars(bars) if grain == "week" else bars
    return bars.select("dt", F.col("close").alias("bench"))


def fear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt, vix: a volatility index from the mean discount of the day, in whole hundredths so that sums are exact."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_discount") * 100).cast("bigint")
    return li.groupBy(F.to_date("l_shipdate").alias("dt")).agg((F.sum(cents) * 4.0 / F.count("*")).alias("vix"))


def options_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, underlying, volume: order counts and whole totals by priority."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderpriority").alias("underlying")).agg(F.sum(F.floor("o_totalprice").cast("bigint")).cast("double").alias("volume"))


def put_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dt, pcr: orders of status O over those of status F, NULL on days without the latter."""
    o = table(spark, sf_dir, "orders")
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return o.groupBy(F.to_date("o_orderdate").alias("dt")).agg((n("O").cast("double") / F.nullif(n("F").cast("double"), F.lit(0.0))).alias("pcr"))


def positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, report_dt, asset_long, asset_short, net_position by nation and week."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    qty = lambda s: F.coalesce(F.sum(F.when(F.col("l_returnflag").isin(*s), F.col("l_quantity").cast("bigint"))), F.lit(0)).cast("double")
    out = li.groupBy(F.col("n_name").alias("market"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("report_dt")).agg(qty(("A", "R")).alias("asset_long"), qty(("N",)).alias("asset_short"))
    return out.withColumn("net_position", F.col("asset_long") - F.col("asset_short"))
