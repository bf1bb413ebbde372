"""Intraday bars of the events table: the plan the stream runs, here over the whole table."""

from __future__ import annotations

from ..operators.bars import table
from ..streaming.bars import intraday_bars
from .output import result, sql_result

QUERIES, ORACLES = {}, {}
SQL = """ib0 AS (SELECT *, date_trunc('hour', ts) AS start, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS k FROM events),
 ib AS (SELECT event_type AS symbol, strftime(start, '%Y-%m-%d %H') AS hour, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close, count(*)::DOUBLE AS volume FROM ib0 GROUP BY 1, 2)"""
COLUMNS = ["open", "high", "low", "close", "volume"]


def intraday(spark, d):
    from pyspark.sql import functions as F

    bars = intraday_bars(table(spark, d, "events")).withColumn("hour", F.date_format("start", "yyyy-MM-dd HH"))
    return result(bars, ["symbol", "hour"], COLUMNS)


QUERIES["x01_stream_intraday_bars"] = intraday
ORACLES["x01_stream_intraday_bars"] = sql_result([SQL], "ib", ["symbol", "hour"], COLUMNS)
