"""Beyond the daily batch: intraday bars of an event stream, and the regime state of a weekly stream.

``intraday_bars`` is one plan for batch and stream: event-time windows with a watermark, so late events within it
still count and state is dropped behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_KEYS = ("symbol", "start")


def intraday_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """symbol, start, open, high, low, close, volume per event type and window; first and last by (ts, event_id)."""
    src = events.withWatermark("ts", late) if events.isStreaming else events
    at = F.struct("ts", "event_id")
    bars = src.groupBy(F.col("event_type").alias("symbol"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def next_regime(score: float, label: str | None, count: int) -> tuple[str, int]:
    """One step of the label with hysteresis: upgrades out of the lower three labels wait for a count of three."""
    new = next((n for edge, n in ((0.6, "RISK-ON"), (0.5, "WEAK RISK-ON"), (0.4, "NEUTRAL"), (0.3, "WEAK RISK-OFF")) if score > edge), "RISK-OFF")
    if label is None:
        return new, 1
    if new == label or (new in ("RISK-ON", "WEAK RISK-ON") and label in ("NEUTRAL", "WEAK RISK-OFF", "RISK-OFF") and count < 3):
        return label, count + 1
    return new, 1


def regime_stream(scores: DataFrame) -> DataFrame:
    """(symbol, dt, score) stream to (symbol, dt, score, label, count): A28 with the state kept per symbol."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        label, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(["dt", "score"])
        out = []
        for dt, score in zip(rows["dt"], rows["score"], strict=True):
            label, count = next_regime(float(score), label, int(count))
            out.append((key[0], dt, float(score), label, count))
        state.update((label, count))
        yield pd.DataFrame(out, columns=["symbol", "dt", "score", "label", "count"])

    return scores.groupBy("symbol").applyInPandasWithState(step, "symbol string, dt date, score double, label string, count int", "label string, count int", "append", "NoTimeout")
