"""File readers with fixed schemas for the market tables (S1-S17).  Missing files are the caller's error.

Network downloads are not part of the engine; these readers take what a downloader leaves.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol STRING, dt DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
HOLDINGS = "etf STRING, ticker STRING, name STRING, weight DOUBLE"
LEADERS = "ticker STRING, sector STRING, rs DOUBLE, rs_mom DOUBLE, flow_z DOUBLE, wyckoff_score DOUBLE, wyckoff_phase STRING, persistence_10d DOUBLE, stability DOUBLE, wls DOUBLE, sector_rank_pct DOUBLE"


def clean(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities to NULL, so that every later comparison is honest."""
    ok = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return df.withColumns({c: F.when(ok(F.col(c)), F.col(c)) for c in columns})


def read_bars(spark: SparkSession, path: str, universe: str, form: str = "parquet") -> DataFrame:
    """Long bars of one universe from Parquet or CSV with a header."""
    reader = spark.read.schema(BARS)
    df = reader.parquet(path) if form == "parquet" else reader.option("header", True).csv(path)
    return clean(df, "open", "high", "low", "close", "volume").withColumn("universe", F.lit(universe))


def write_cache(bars: DataFrame, path: str) -> None:
    """A universe's cache, replaced as a whole."""
    bars.write.mode("overwrite").parquet(path)


def cache_age_hours(spark: SparkSession, path: str) -> float | None:
    """Hours since the cache was written; None without one that is complete."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (time.time() - fs.getFileStatus(done).getModificationTime() / 1000) / 3600 if fs.exists(done) else None


def cached_bars(spark: SparkSession, path: str, universe: str, make: Callable[[], DataFrame], hours: float = 23, force: bool = False) -> DataFrame:
    """The cache while it is younger than ``hours``; else what ``make`` returns, written there first."""
    age = None if force else cache_age_hours(spark, path)
    if age is None or age >= hours:
        write_cache(make(), path)
    return read_bars(spark, path, universe)


def wide_to_long(wide: DataFrame, date: str = "Date", close_suffix: str = "") -> DataFrame:
    """Columns T (or T_close), T_open, T_high, T_low, T_volume to one row a symbol and day."""
    parts = ("open", "high", "low", "volume")
    closes = [c for c in wide.columns if c != date and not c.endswith(tuple(f"_{p}" for p in parts)) and (c.endswith(close_suffix) if close_suffix else "_" not in c)]
    rows = []
    for c in closes:
        t = c.removesuffix(close_suffix) if close_suffix else c
        value = lambda p, t=t: (F.col(f"`{t}_{p}`") if f"{t}_{p}" in wide.columns else F.lit(None)).cast("double").alias(p)
        rows.append(F.struct(F.lit(t).alias("symbol"), value("open"), value("high"), value("low"), F.col(f"`{c}`").cast("double").alias("close"), value("volume")))
    out = wide.select(F.to_date(date).alias("dt"), F.explode(F.array(*rows)).alias("b")).select("b.symbol", "dt", "b.open", "b.high", "b.low", "b.close", "b.volume")
    return out.filter("close is not null or volume is not null")


def with_fallback(primary: DataFrame, *others: DataFrame, key: str = "symbol") -> DataFrame:
    """Rows of the first source that has the symbol."""
    out = primary
    for other in others:
        out = out.unionByName(other.join(out.select(key).distinct(), key, "left_anti"))
    return out


def read_options_volume(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """CSV files under year=YYYY folders; ``years`` prunes folders."""
    df = spark.read.option("header", True).option("basePath", path).schema("`Trade Date` STRING, Underlying STRING, Volume DOUBLE, year INT").csv(path)
    df = df.filter(F.col("year").isin(years)) if years else df
    return df.select(F.to_date("Trade Date").alias("trade_date"), F.col("Underlying").alias("underlying"), F.col("Volume").alias("volume"))


def read_put_call(spark: SparkSession, path: str, as_of: Column | None = None, days: int = 730) -> DataFrame:
    """Ratio file with two lines before the header, dates as D/M/Y; the last ``days`` up to ``as_of``."""
    lines = spark.read.text(path, wholetext=True)
    line = F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n"))
    row = lines.select(line.alias("n", "line")).filter("n > 2 and trim(line) <> ''")
    df = row.select(F.expr("try_to_timestamp(trim(split(line, ',')[0]), 'd/M/yyyy')").cast("date").alias("dt"), F.expr("try_cast(trim(split(line, ',')[1]) as double)").alias("pcr"))
    df = df.filter("dt is not null and pcr is not null")
    return df if as_of is None else df.filter(F.col("dt").between(F.date_sub(as_of, days), as_of))


def read_positioning(spark: SparkSession, path: str, columns: int = 10) -> DataFrame:
    """Headerless positioning file, all strings; fields 0, 2, 8 and 9 are kept."""
    schema = ", ".join(f"_c{i} STRING" for i in range(columns))
    return spark.read.schema(schema).csv(path).select(F.col("_c0").alias("market"), F.col("_c2").alias("report_dt"), F.col("_c8").alias("asset_long"), F.col("_c9").alias("asset_short"))


def read_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (etf, ticker, name, weight); blank lines are skipped."""
    return spark.read.schema(HOLDINGS).option("header", True).csv(path).filter("ticker is not null").distinct()


def read_leader_log(spark: SparkSession, glob: str) -> DataFrame:
    """Many leader files, the day taken from ``_YYYYMMDD`` in the file name."""
    df = spark.read.schema(LEADERS).option("header", True).csv(glob)
    day = F.to_date(F.regexp_extract(F.input_file_name(), r"_(\d{8})", 1), "yyyyMMdd")
    return df.withColumn("as_of", day).filter("as_of is not null")


def closes(bars: DataFrame) -> DataFrame:
    """S15."""
    return bars.select("symbol", "dt", "close")


def read_market_cap(spark: SparkSession, path: str) -> DataFrame:
    """A table in place of a vendor call."""
    return spark.read.schema("ticker STRING, cap_musd DOUBLE").option("header", True).csv(path)


def keyed_append(history: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """History plus new rows; a new row replaces the history's row of the same key."""
    if history is None:
        return new
    return history.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
