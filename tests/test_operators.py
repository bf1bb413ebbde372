"""Operators on synthetic edge cases, readers, sinks and the stream."""

import datetime as dt

import numpy as np
import pytest

from marketloom.operators import integrity, leaders, options, weekly
from marketloom.sources import readers, sinks
from marketloom.streaming import bars as stream


def day(i):
    return dt.date(2020, 1, 6) + dt.timedelta(days=i)


def test_gates(spark):
    rows = [("ok", day(i), 10.0 + 0.01 * i, 1.0) for i in range(70)] + [("wild", day(i), 10.0 if i < 40 else 13.0, 1.0) for i in range(70)] + [("low", day(i), float(i), 1.0) for i in range(70)] + [("gone", day(i), None if i < 20 else 5.0, 1.0) for i in range(70)]
    bars = spark.createDataFrame(rows, "symbol string, dt date, close double, volume double")
    mild = {r["symbol"]: (r["valid"], r["issue"]) for r in integrity.global_gate(bars).collect()}
    assert mild["ok"] == (True, None) and mild["wild"][0] and mild["wild"][1].startswith("EXTREME")
    assert not mild["low"][0] and not mild["gone"][0]
    strict = {r["symbol"]: r["valid"] for r in integrity.global_gate(bars, strict=True).collect()}
    assert not strict["wild"]
    assert {r["symbol"]: r["ok"] for r in integrity.series_gate(bars).collect()} == {"ok": True, "wild": True, "low": True, "gone": False}


def test_leadership_penalty(spark):
    rows = [("s", f"t{i}", float(i), float(i), 0.5 + 0.01 * i, 1.0 + 0.1 * i) for i in range(6)]
    df = spark.createDataFrame(rows, "sector string, symbol string, rs_mom double, flow_z double, pattern_score double, stability double")
    out = leaders.leadership(df, ["sector"]).collect()
    for r in out:
        assert r["rho"] == pytest.approx(1.0)
        assert r["wls"] == pytest.approx(0.35 * r["rs_z"] + 0.25 * r["rws_z"] + 0.10 * r["stab_z"])
    hole = df.union(spark.createDataFrame([("s", "t9", 1.0, 1.0, None, 1.0)], df.schema))
    assert all(r["wls"] is None for r in leaders.leadership(hole, ["sector"]).collect())


def test_hysteresis_matches_the_stream_step(spark):
    rng = np.random.default_rng(1)
    scores = [float(x) for x in rng.random(60)]
    df = spark.createDataFrame([("a", day(7 * i), s) for i, s in enumerate(scores)], "symbol string, dt date, score double")
    want, label, count = [], None, 0
    for s in scores:
        label, count = stream.next_regime(s, label, count)
        want.append((label, count))
    assert [(r["label"], r["count"]) for r in weekly.regime_hysteresis(df).orderBy("dt").collect()] == want


def test_merge_keeps_history(spark):
    schema = "market string, report_dt date, asset_long double, asset_short double, net_position double"
    old, new = spark.createDataFrame([("m", day(0), 1.0, 0.0, 1.0)], schema), spark.createDataFrame([("m", day(0), 9.0, 0.0, 9.0), ("m", day(7), 2.0, 0.0, 2.0)], schema)
    assert sorted((r["report_dt"], r["asset_long"]) for r in options.merge_positioning(old, new).collect()) == [(day(0), 1.0), (day(7), 2.0)]


def test_parse_positioning(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(" E-MINI ,x,2024-01-02,,,,,, 10 , 4 \nBAD,x,nodate,,,,,,1,2\nBAD2,x,2024-01-02,,,,,,a,2\n")
    rows = options.parse_positioning(readers.read_positioning(spark, str(tmp_path / "raw.csv"))).collect()
    assert [(r["market"], r["net_position"]) for r in rows] == [("E-MINI", 6.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "pcr.csv").write_text("junk\njunk\nDate (D/M/Y),Put/Call Ratio\n2/1/2024,1.5\n13/1/2024,0.5\n,\n")
    assert sorted((r["dt"], r["pcr"]) for r in readers.read_put_call(spark, str(tmp_path / "pcr.csv")).collect()) == [(dt.date(2024, 1, 2), 1.5), (dt.date(2024, 1, 13), 0.5)]
    (tmp_path / "h.csv").write_text("etf,ticker,name,weight\nA,T,One,0.1\n\nA,T,One,0.1\nB,U,Two,0.2\n")
    assert readers.read_holdings(spark, str(tmp_path / "h.csv")).count() == 2
    wide = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 5.0), ("2024-01-03", None, None, 6.0)], "Date string, AA double, AA_volume double, BB double")
    assert sorted((r["symbol"], r["close"]) for r in readers.wide_to_long(wide).collect()) == [("AA", 1.0), ("BB", 5.0), ("BB", 6.0)]
    a = spark.createDataFrame([("x", 1)], "symbol string, v int")
    assert sorted(map(tuple, readers.with_fallback(a, spark.createDataFrame([("x", 2), ("y", 3)], a.schema)).collect())) == [("x", 1), ("y", 3)]
    assert sorted(map(tuple, readers.keyed_append(a, spark.createDataFrame([("x", 5)], a.schema), ["symbol"]).collect())) == [("x", 5)]


def test_report_sections():
    report = ["# t", "## Conclusion", "x"]
    assert sinks.splice(report, ["s"]) == ["# t", "s", "## Conclusion", "x"]
    assert sinks.macro_section(0.25)[-1].endswith("+1 risk-on)")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i % 60), "k" if i % 3 else "j", float(i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    live = stream.intraday_bars(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("bars_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, stream.intraday_bars(df).collect()))


def test_regime_stream_keeps_its_state(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, day(7 * i), float(x)) for s in ("a", "b") for i, x in enumerate(rng.random(40))]
    df = spark.createDataFrame(rows, "symbol string, dt date, score double")
    for part in range(4):  # a file a trigger, in time order
        df.filter((df.dt >= day(70 * part)) & (df.dt < day(70 * part + 70))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = stream.regime_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("regimes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("regimes_out").collect())) == sorted(map(tuple, weekly.regime_hysteresis(df).collect()))


def test_hysteresis_of_missing_scores_and_empty_tables(spark):
    df = spark.createDataFrame([("a", day(0), None), ("a", day(7), 0.7), ("a", day(14), 0.35)], "symbol string, dt date, score double")
    got = [tuple(r)[2:] for r in weekly.regime_hysteresis(df).orderBy("dt").collect()]
    assert got == [(None, "RISK-OFF", 1), (0.7, "RISK-OFF", 2), (0.35, "WEAK RISK-OFF", 1)]
    assert weekly.regime_hysteresis(df.limit(0)).count() == 0
