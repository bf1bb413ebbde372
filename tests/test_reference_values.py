"""Values worked out by hand from the published analytics: conviction chain, latest rows, regime counter, region map."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import ladders as lad
from marketloom.operators import features, options, snapshot, weekly
from marketloom.sources import readers, sinks


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def test_conviction_chain(spark):
    """0.9 x (1 + 0.3 x 1.5) / (1 + 0.7), and the unified score of the result."""
    conviction = lad.volatility_adjusted(lad.macro_adjusted(F.lit(0.9), F.lit(1.5)), F.lit(1.2))
    got = spark.range(1).select(conviction.alias("c"), lad.unified_score(F.lit(0.6), F.lit(0.55), conviction, F.lit(1.2)).alias("u")).first()
    want = 0.9 * 1.45 / 1.7
    assert got["c"] == pytest.approx(want)
    assert got["u"] == pytest.approx((0.4 * 0.6 + 0.3 * 0.55 + 0.3 * (math.tanh(want) + 1) / 2) / 1.7)


def test_home_z_is_the_last_report_of_the_day(spark):
    days = spark.createDataFrame([(day(i),) for i in range(5)], "dt date")
    home = spark.createDataFrame([(day(1), 0.5), (day(3), None), (day(9), 9.0)], "report_dt date, cot_z double")
    assert sorted((r["dt"], r["home_z"]) for r in snapshot.home_z_as_of(days, home).collect()) == [(day(0), None), (day(1), 0.5), (day(2), 0.5), (day(3), None), (day(4), None)]


def test_persistence_of_the_last_three_values(spark):
    xs = [0.1, None, -0.2, 0.3, None, 0.4, 0.0, -1.0, -1.0, None]
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate(xs)], "symbol string, dt date, flow double")
    up, down, none, few = "PERSISTENCIA_ALCISTA", "PERSISTENCIA_BAJISTA", "TRANSICION", "SIN_DATOS"
    got = [r["p"] for r in snapshot.flow_persistence(df, "flow", "p").orderBy("dt").collect()]
    assert got == [few, few, few, up, up, up, up, none, down, down]


def test_latest_row_of_each_market(spark):
    rows = [("A FUND", day(0), 1.0), ("A FUND", day(7), 2.0), ("B FUND", day(0), 3.0), ("MICRO FUND", day(7), 50.0)]
    z = spark.createDataFrame(rows, "market string, report_dt date, cot_z double")
    assert sorted((r["market"], r["cot_z"]) for r in options.latest_by_market(z).collect()) == [("A FUND", 2.0), ("B FUND", 3.0), ("MICRO FUND", 50.0)]
    keys = spark.createDataFrame([("K", "fund")], "key string, pattern string")
    assert options.sector_positioning(z, keys).first()["z"] == 2.0
    assert options.sector_positioning(z, keys, by_market=True).first()["z"] == 2.5
    assert [(r["report_dt"], r["cot_z"]) for r in options.home_positioning(z, "b fund").collect()] == [(day(0), 3.0)]


def test_positioning_without_market_stays(spark):
    raw = spark.createDataFrame([(None, "2024-01-02", "5", "3"), ("m", "x", "5", "3")], "market string, report_dt string, asset_long string, asset_short string")
    assert [(r["market"], r["net_position"]) for r in options.parse_positioning(raw).collect()] == [(None, 2.0)]


def test_regime_counter(spark):
    """The three shipped rows (0.674, 0.696, 0.654 -> RISK-ON 1, 2, 3), then a change."""
    history, want = None, []
    for i, score in enumerate((0.674, 0.696, 0.654, 0.45)):
        row = weekly.regime_row(history, spark.createDataFrame([(dt.datetime(2024, 1, 1 + i), score)], "ts timestamp, score double"))
        history = row if history is None else readers.keyed_append(history, row, ["ts"])
        want.append(("RISK-ON", i + 1) if i < 3 else ("NEUTRAL", 1))
    assert [(r["regime"], r["persistence"]) for r in history.orderBy("ts").collect()] == want
    series = spark.createDataFrame([("s", day(7 * i), x) for i, x in enumerate((0.674, 0.696, 0.654, 0.45, 0.7))], "symbol string, dt date, score double")
    assert [(r["label"], r["persistence"]) for r in weekly.regime_history(series).orderBy("dt").collect()] == [*want, ("RISK-ON", 1)]


def test_region_map(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20, 4))
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(n, day(7 * i), float(x[i, j])) for i in range(20) for j, n in enumerate(names)], "symbol string, dt date, ret double")
    regions = spark.createDataFrame([("R1", "a"), ("R1", "b"), ("R2", "c"), ("R3", "d"), ("R4", "nobody")], "region string, symbol string")
    frame = pd.DataFrame({"R1": x[:, :2].mean(axis=1), "R2": x[:, 2], "R3": x[:, 3]})
    corr = frame.iloc[-12:].corr().to_numpy()
    assert weekly.region_alignment(df, 12, regions).first()["alignment"] == pytest.approx(corr[np.triu_indices(3, 1)].mean())
    flat = df.withColumn("ret", F.when((F.col("symbol") == "d") & (F.col("dt") > F.lit(day(7 * 5))), 0.0).otherwise(F.col("ret")))
    # the last 12 weeks of d are constant from week 17 on: week 16 is the last complete one
    y = x.copy()
    y[6:, 3] = 0.0
    corr = pd.DataFrame(y[5:17]).corr().to_numpy()
    assert weekly.region_alignment(flat, 12).first()["alignment"] == pytest.approx(corr[np.triu_indices(4, 1)].mean())
    assert weekly.region_alignment(df.filter("symbol = 'a'"), 12).first()["alignment"] == 0.5
    assert weekly.region_alignment(df.filter(F.col("dt") < F.lit(day(7 * 11))), 12).first()["alignment"] == 0.5


def test_correlation_stress_against_pandas(spark):
    rng = np.random.default_rng(8)
    x = pd.DataFrame(rng.normal(size=(90, 3)), columns=list("abc"))
    df = spark.createDataFrame([(c, day(7 * i), float(x[c][i])) for c in x for i in range(90)], "symbol string, dt date, ret double")
    got = [r["mean_corr"] for r in weekly.correlation_stress(df).orderBy("dt").collect()]
    pairs = [x[a].ewm(span=60).cov(x[b], bias=True) / np.sqrt(x[a].ewm(span=60).var(bias=True) * x[b].ewm(span=60).var(bias=True)) for a, b in ("ab", "ac", "bc")]
    want = pd.concat(pairs, axis=1).mean(axis=1)
    assert got[0] is None and got[1:] == pytest.approx(want[1:].tolist())


def test_weighted_breadth(spark):
    rows = [(s, day(i), float(i if s == "up" else 10 - i)) for s in ("up", "down", "out") for i in range(5)]
    market = spark.createDataFrame(rows, "symbol string, dt date, close double")
    weights = spark.createDataFrame([("up", 0.7), ("down", 0.2)], "symbol string, weight double")
    got = {r["dt"]: r["breadth"] for r in features.breadth(market, 3, weights).collect()}
    assert got[day(4)] == pytest.approx(0.7 * 0.5 - 0.2 * 0.5) and got[day(0)] == pytest.approx(-0.45)


def test_cache_age(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("x", day(0), 1.0, 1.0, 1.0, float("nan"), 1.0)], readers.BARS)

    path = str(tmp_path / "cache")
    assert readers.cache_age_hours(spark, path) is None
    for hours, force in ((23, False), (23, False), (0, False), (23, True)):
        assert readers.cached_bars(spark, path, "us", make, hours, force).first()["close"] is None
    assert len(made) == 3


def test_files(spark, tmp_path):
    """Readers and sinks that no query uses."""
    (tmp_path / "opt/year=2023").mkdir(parents=True)
    (tmp_path / "opt/year=2024").mkdir()
    (tmp_path / "opt/year=2023/a.csv").write_text("Trade Date,Underlying,Volume\n2023-05-01,X,5\n")
    (tmp_path / "opt/year=2024/a.csv").write_text("Trade Date,Underlying,Volume\n2024-05-01,X,7\n")
    assert [(r["trade_date"], r["volume"]) for r in readers.read_options_volume(spark, str(tmp_path / "opt"), [2024]).collect()] == [(dt.date(2024, 5, 1), 7.0)]
    assert readers.read_options_volume(spark, str(tmp_path / "opt")).count() == 2
    (tmp_path / "bars.csv").write_text("symbol,dt,open,high,low,close,volume\nX,2024-01-02,1,2,0.5,NaN,10\nX,2024-01-03,1,2,0.5,1.5,10\n")
    bars = readers.read_bars(spark, str(tmp_path / "bars.csv"), "us", "csv")
    assert [(r["close"], r["universe"]) for r in bars.orderBy("dt").collect()] == [(None, "us"), (1.5, "us")]
    assert readers.closes(bars).columns == ["symbol", "dt", "close"]
    scored = spark.createDataFrame([("T", "s", 1.0, 1.0, 1.0, 1.0, "MARKUP", 1.0, 1.0, w, 1.0) for w in (0.1, 0.9)], readers.LEADERS)
    sinks.write_leaders(scored, str(tmp_path / "leaders_20240105"))
    log = readers.read_leader_log(spark, str(tmp_path / "leaders_*")).collect()
    assert [(r["as_of"], r["wls"]) for r in log] == [(dt.date(2024, 1, 5), 0.9), (dt.date(2024, 1, 5), 0.1)]
    (tmp_path / "cap.csv").write_text("ticker,cap_musd\nA,60000\nB,\n")
    assert sorted((r["ticker"], r["cap_musd"]) for r in readers.read_market_cap(spark, str(tmp_path / "cap.csv")).collect()) == [("A", 60000.0), ("B", None)]


def test_report_of_every_section(spark):
    price = spark.createDataFrame([(1, "A", 0.2), (2, "B", 0.1)], "rank int, symbol string, momentum double")
    flow = spark.createDataFrame([(1, "A", 2.5, 0.6, 0.5, "r"), (2, "B", -1.0, 0.6, 0.5, "r")], "rank int, symbol string, flow_mom double, flow_dispersion double, flow_breadth double, regime string")
    alerts = spark.createDataFrame([("B", "ALERT"), ("A", None)], "symbol string, alert string")
    state = spark.createDataFrame([(0.01, 0.2, 1.6)], "sector_dispersion double, breadth_signal double, vix_z double")
    text = "\n".join(sinks.daily_report("2024-01-05", price, flow, alerts, state))
    assert "| 1 | A | 2.5000 | Fuerte entrada |" in text and "- ALERT: B" in text and "ALTA VOLATILIDAD" in text and "Strongest outflow: B" in text
    key = spark.createDataFrame([("K", 1.7, 2, day(0), "FUERTEMENTE ALCISTA"), ("L", 2.0, 1, day(0), "FUERTEMENTE ALCISTA")], "key string, z double, instruments long, report_dt date, label string")
    section = sinks.positioning_section(key, "2024-01-20")
    assert "Positioning is 19 days old." in section and section.index("| L | 2.0000 | 1 | FUERTEMENTE ALCISTA |") < section.index("| K | 1.7000 | 2 | FUERTEMENTE ALCISTA |")
    assert sinks.positioning_section(key.limit(0), "2024-01-20")[-1].startswith("No relevant")
    hits = spark.createDataFrame([("Large", 5, 0.6), ("Small", 9, 0.4)], "bucket string, n long, hit_rate double")
    report = "\n".join(sinks.validation_report({5: hits.drop("bucket")}, 0.2, None, {5: hits}))
    assert "- 5 bars: n 5, hit_rate 0.6000" in report and "## Mid capitalisation\n\n- 5 bars: too few data" in report and "Rank persistence: n/a" in report
