"""Reports and exports from small result tables (S18-S23).  Inputs have a row a sector; they come to the driver here."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladders as lad


def table(rows: list[dict], columns: list[str]) -> list[str]:
    """A Markdown table."""
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return head + ["| " + " | ".join("" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in columns) + " |" for r in rows]


def daily_report(as_of: str, price: DataFrame, flow: DataFrame, alerts: DataFrame, state: DataFrame) -> list[str]:
    """Rankings by price and flow, alerts, metrics and the conclusion, as lines in sections."""
    p = [r.asDict() for r in price.orderBy("rank").collect()]
    shown = flow.withColumn("reading", lad.flow_intensity(F.col("flow_mom"))).withColumn("spread", lad.dispersion_text(F.col("flow_dispersion")))
    f = [r.asDict() for r in shown.orderBy("rank").collect()]
    s = state.withColumn("vix_note", lad.vix_text(F.col("vix_z"))).first()
    lines = ["# Sector rotation radar", "", f"**Date:** {as_of}", "", "## Ranking by price momentum", "", *table(p, ["rank", "symbol", "momentum"]), "", "## Ranking by estimated money flow", "", *table(f, ["rank", "symbol", "flow_mom", "reading"])]
    lines += ["", "## Alerts", "", *[f"- {r['alert']}: {r['symbol']}" for r in alerts.filter("alert is not null").orderBy("symbol").collect()]]
    if f:
        lines += ["", "## Flow metrics", "", f"- Dispersion: {f[0]['flow_dispersion']:.3f} ({f[0]['spread']})", f"- Breadth: {f[0]['flow_breadth']:.1%}", f"- Regime: {f[0]['regime']}"]
    if s:
        lines += ["", "## Price metrics", "", f"- Dispersion: {s['sector_dispersion']:.4f}", f"- Breadth signal: {s['breadth_signal']:.3f}", f"- VIX z: {s['vix_z']:.2f}" + (f" ({s['vix_note']})" if s["vix_note"] else "")]
    return [*lines, "", "## Conclusion", "", *([f"Strongest inflow: {f[0]['symbol']}", f"Strongest outflow: {f[-1]['symbol']}"] if f else [])]


def macro_section(score: float) -> list[str]:
    """S21."""
    return ["", "## Macro context", "", f"Macro score: {score:.2f} (-1 risk-off, +1 risk-on)"]


def splice(report: list[str], section: list[str], before: str = "## Conclusion") -> list[str]:
    """The section in front of the ``before`` line, or at the end without one."""
    at = report.index(before) if before in report else len(report)
    return [*report[:at], *section, *report[at:]]


def validation_report(horizons: dict[int, DataFrame], turnover: float | None, persistence: float | None, buckets: dict[int, DataFrame] | None = None) -> list[str]:
    """The metrics of each horizon, then of each class by capitalisation (``buckets``: by horizon, a row a class in
    column ``bucket``), turnover and persistence with the thresholds they are read against."""
    lines = ["# Forward validation of leaders"]
    for h, df in sorted(horizons.items()):
        lines += ["", f"## {h} bars", "", *table([r.asDict() for r in df.collect()], df.columns)]
    if buckets:
        rows = {(r["bucket"], h): r.asDict() for h, df in buckets.items() for r in df.collect()}
        for bucket in ("Large", "Mid", "Small"):
            lines += ["", f"## {bucket} capitalisation", ""]
            for h in sorted(buckets):
                r = rows.get((bucket, h))
                lines += [f"- {h} bars: too few data" if r is None else f"- {h} bars: " + ", ".join(f"{k} {v:.4f}" if isinstance(v, float) else f"{k} {v}" for k, v in r.items() if k != "bucket" and v is not None)]
    show = lambda x: "n/a" if x is None else f"{x:.3f}"
    return [*lines, "", f"- Turnover of the top three: {show(turnover)} (good below 0.30)", f"- Rank persistence: {show(persistence)} (good above 0.50)", "- Hit rate: good above 0.50; alpha: good above 0"]


def positioning_section(by_key: DataFrame, as_of: str) -> list[str]:
    """The positioning table of the report: keys by falling z, with the number of instruments and the reading."""
    rows = [r.asDict() for r in by_key.orderBy(F.desc("z"), "key").collect()]
    if not rows:
        return ["", "## Positioning", "", "No relevant market in the history."]
    late = rows and (dt.date.fromisoformat(as_of) - max(r["report_dt"] for r in rows)).days
    note = [f"Positioning is {late} days old."] if late > 8 else []
    return ["", "## Positioning", "", *note, *table(rows, ["key", "z", "instruments", "label"])]


def distribution_section(day: DataFrame, ranking_volatility: float | None) -> list[str]:
    """The distribution table of the report: the snapshot's rows of one day by falling opportunity."""
    columns = ["symbol", "divergence", "binary_score", "p_bin", "p_cont", "risk_score", "confidence", "distribution_class", "phase", "direction", "volatility_adjusted", "unified", "system_confidence", "signal_quality", "opportunity", "operability", "persistence", "signal_state", "alert_level"]
    x = ranking_volatility
    reading = "no data" if x is None else f"{x:.3f}, " + ("extreme rotation" if x > 0.15 else "moderate rotation" if x > 0.05 else "stable market")
    rows = [r.asDict() for r in day.orderBy(F.desc("opportunity"), "symbol").collect()]
    return ["", "## Distribution", "", f"Ranking volatility over 5 days: {reading}", "", *table(rows, columns)]


def write_leaders(scored: DataFrame, path: str) -> None:
    """One CSV, by sector and falling wls."""
    scored.orderBy("sector", F.desc("wls")).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def plot_dispersion(history: DataFrame, path: str, least: int = 5) -> bool:
    """The last days' dispersion with its quantile lines; false below ``least`` days or without a plotting library."""
    rows = history.orderBy("dt").collect()
    if len(rows) < least:
        return False
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    axes = (figure := Figure(figsize=(10, 4))).add_subplot()
    axes.plot([r["dt"] for r in rows], [r["dispersion"] for r in rows])
    for c in ("high_line", "low_line"):
        axes.axhline(rows[0][c], linestyle="--")
    figure.savefig(path)
    return True
