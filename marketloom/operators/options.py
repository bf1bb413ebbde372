"""Options-market structure (R32-R35) and futures positioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladders as lad
from ..functions.primitives import clip, div, ffill, over, robust_z, roll, zscore

# The market-name patterns of the futures map, by key.
MARKET_MAP = {
    "SPY": "E-MINI S&P 500", "XLK": "E-MINI S&P TECHNOLOGY INDEX", "XLE": "E-MINI S&P ENERGY INDEX", "XLF": "E-MINI S&P FINANCIAL INDEX", "XLI": "E-MINI S&P INDUSTRIAL INDEX",
    "XLP": "E-MINI S&P CONSU STAPLES INDEX", "XLV": "E-MINI S&P HEALTH CARE INDEX", "XLU": "E-MINI S&P UTILITIES INDEX", "XLRE": "DOW JONES U.S. REAL ESTATE IDX", "COMMODITIES": "BBG COMMODITY",
    "VOL": "VIX FUTURES", "USD": "USD INDEX", "RATES_2Y": "UST 2Y NOTE", "RATES_5Y": "UST 5Y NOTE", "RATES_10Y": "UST 10Y NOTE", "RATES_LONG": "ULTRA UST BOND", "FED": "FED FUNDS", "SOFR": "SOFR-3M",
}


def tanh_z(df: DataFrame, x: str, out: str, n: int) -> DataFrame:
    """Tanh of the robust z."""
    return robust_z(df, x, "__z", n, eps=1e-9, limit=5.0, key="one").withColumn(out, F.tanh("__z")).drop("__z")


def sentiment(pcr: DataFrame) -> DataFrame:
    """R34 on (dt, pcr), carried forward and 1.0 before the first value."""
    df = pcr.withColumn("one", F.lit(1))
    df = df.withColumn("minus", -F.coalesce(ffill(F.col("pcr"), over(None, "one")), F.lit(1.0)))
    return tanh_z(df, "minus", "sentiment", 60).select("dt", "sentiment")


def activity_heat(volume: DataFrame) -> DataFrame:
    """R32 on (trade_date, underlying, volume)."""
    df = volume.groupBy(F.col("trade_date").alias("dt")).agg(F.sum("volume").alias("v")).withColumn("one", F.lit(1))
    df = df.withColumn("rel", div(F.col("v"), roll(F.avg, F.col("v"), over(60, "one"), 1)))
    return tanh_z(df, "rel", "activity", 60).select("dt", "activity")


def fragmentation(volume: DataFrame) -> DataFrame:
    """Tanh z of the 5-day mean of the day's sum of squared shares.  Sums by day from squares: no second shuffle."""
    daily = volume.groupBy("trade_date", "underlying").agg(F.sum("volume").alias("v"))
    df = daily.groupBy(F.col("trade_date").alias("dt")).agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("s")).withColumn("one", F.lit(1))
    df = df.withColumn("hhi0", div(F.col("s"), F.col("t") * F.col("t")))
    df = df.withColumn("hhi", roll(F.avg, F.col("hhi0"), over(5, "one"), 1))
    return tanh_z(df, "hhi", "fragmentation", 120).select("dt", "hhi", "fragmentation")


def market_structure(pcr: DataFrame, volume: DataFrame) -> DataFrame:
    """R35 with P29: days that all three have; missing parts 0."""
    df = sentiment(pcr).join(activity_heat(volume), "dt").join(fragmentation(volume), "dt").fillna(0.0, ["sentiment", "activity", "fragmentation"])
    x = clip(0.4 * F.col("sentiment") + 0.35 * F.col("activity") + 0.25 * F.col("fragmentation"), -1, 1)
    df = df.withColumn("oms", x)
    o = F.col("oms")
    return df.withColumn("oms_class", lad.oms_class(o)).withColumn("risk_bias", lad.oms_risk_bias(o)).withColumn("confidence_boost", lad.oms_confidence(o))


def parse_positioning(raw: DataFrame) -> DataFrame:
    """S10 on all-string columns market, report_dt, asset_long, asset_short: trim, coerce, drop rows whose date or
    numbers do not parse; a missing market stays."""
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    df = raw.select(F.trim("market").alias("market"), F.expr("try_to_timestamp(trim(report_dt), 'yyyy-MM-dd')").cast("date").alias("report_dt"), number("asset_long").alias("asset_long"), number("asset_short").alias("asset_short"))
    return df.na.drop(subset=["report_dt", "asset_long", "asset_short"]).withColumn("net_position", F.col("asset_long") - F.col("asset_short"))


def merge_positioning(history: DataFrame, new: DataFrame) -> DataFrame:
    """Append; of equal (report_dt, market) the history's row stays, among new ones the least."""
    both = history.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    value = F.struct("src", "asset_long", "asset_short", "net_position")
    return both.groupBy("report_dt", "market").agg(F.min(value).alias("v")).select("market", "report_dt", "v.asset_long", "v.asset_short", "v.net_position")


def positioning_z(cot: DataFrame, n: int = 52, mp: int = 10) -> DataFrame:
    """R30 (and R31, which the same per-market window replaces): markets with at least ``mp`` reports."""
    df = cot.join(cot.groupBy("market").agg(F.count("*").alias("n")).filter(F.col("n") >= mp).select("market"), "market", "left_semi")
    w = over(n, "market", "report_dt")
    df = df.withColumn("mean", roll(F.avg, F.col("net_position"), w, mp)).withColumn("std", roll(F.stddev_samp, F.col("net_position"), w, mp))
    return zscore(df, "net_position", "cot_z", n, mp, key="market", time="report_dt")


def latest_by_market(cot_z: DataFrame) -> DataFrame:
    """Each market's own last row, whatever the others' dates (one market's rows of one date: any one of them)."""
    row = F.max_by(F.struct(*[c for c in cot_z.columns if c != "market"]), "report_dt").alias("r")
    return cot_z.groupBy("market").agg(row).select("market", "r.*")


def home_positioning(cot_z: DataFrame, pattern: str) -> DataFrame:
    """report_dt, cot_z of the home market: the last by name of those that match (case-insensitive)."""
    own = cot_z.filter(F.col("market").rlike(f"(?i){pattern}"))
    return own.join(F.broadcast(own.agg(F.max("market").alias("market"))), "market", "left_semi").select("report_dt", "cot_z")  # one row


def sector_positioning(cot_z: DataFrame, market_map: DataFrame, by_market: bool = False) -> DataFrame:
    """Median z by key over the markets whose name matches the key's pattern (case-insensitive, without
    MICRO and NANO).  The positioning table reads the rows of the last report date; with ``by_market`` each market
    gives its own last row (A6), as the synthetic factors have it.  ``market_map`` is configuration: some tens of rows."""
    last = latest_by_market(cot_z) if by_market else cot_z.join(F.broadcast(cot_z.agg(F.max("report_dt").alias("report_dt"))), "report_dt", "left_semi")
    hit = last.join(F.broadcast(market_map), F.expr("market rlike concat('(?i)', pattern)") & ~F.col("market").rlike("(?i)MICRO|NANO"))
    out = hit.groupBy("key").agg(F.percentile("cot_z", F.lit(0.5)).alias("z"), F.count("*").alias("instruments"), F.max("report_dt").alias("report_dt"))
    return out.filter("z is not null").withColumn("label", lad.positioning_label(F.col("z")))


def synthetic_factors(sector_z: DataFrame) -> DataFrame:
    """One row; a key without a z counts as 0."""
    z = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("z"))), F.lit(0.0)).alias(k)
    keys = ["SPY", "XLK", "XLF", "XLI", "XLP", "XLV", "XLU", "RATES_2Y", "FED", "SOFR", "RATES_10Y", "RATES_LONG"]
    df = sector_z.agg(*[z(k) for k in keys])
    c = F.col
    df = df.withColumn("risk", lad.median_of(c("SPY"), c("XLK"), c("XLF"), c("XLI"))).withColumn("defensive", lad.median_of(c("XLP"), c("XLV"), c("XLU")))
    df = df.withColumn("rotation", c("risk") - c("defensive")).withColumn("inferred", lad.exposure_label(c("rotation"), c("SPY")))
    df = df.withColumn("short_rates", (0.5 * c("RATES_2Y") + 0.3 * c("FED") + 0.2 * c("SOFR")) / 3).withColumn("long_rates", (0.6 * c("RATES_10Y") + 0.4 * c("RATES_LONG")) / 2)
    return df.withColumn("curve_spread", c("long_rates") - c("short_rates")).select("inferred", "risk", "defensive", "rotation", "short_rates", "long_rates", "curve_spread")
