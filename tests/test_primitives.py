"""Rolling helpers against pandas, null patterns included."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.functions import primitives as p


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400).cumsum()
    x[rng.random(400) < 0.08] = np.nan
    x[:7] = np.nan
    x[200:225] = np.nan
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [("A", d, None if np.isnan(v) else float(v)) for d, v in zip(days, x, strict=True)]
    return spark.createDataFrame(rows, "symbol string, dt date, x double"), pd.Series(x)


def got(df, column):
    return pd.Series([r[column] for r in df.orderBy("dt").collect()], dtype=float)


def same(a, b, tol=1e-9):
    assert (a.isna() == b.isna()).all()
    assert np.nanmax(np.abs(a - b)) < tol


def test_rolling_mean_and_std(series):
    df, x = series
    w = p.over(20)
    same(got(df.withColumn("y", p.roll(F.avg, F.col("x"), w, 10)), "y"), x.rolling(20, min_periods=10).mean())
    same(got(df.withColumn("y", p.roll(F.stddev_samp, F.col("x"), w, 10)), "y"), x.rolling(20, min_periods=10).std())


def test_robust_z(series):
    df, x = series
    med = x.rolling(60, min_periods=20).median()
    mad = (x - med).abs().rolling(60, min_periods=20).median().replace(0, np.nan)
    same(got(p.robust_z(df, "x", "y", 60, mp=20, limit=5.0), "y"), ((x - med) / (1.4826 * mad)).clip(-5, 5))


@pytest.mark.parametrize(("kw", "mp"), [({"span": 5}, 1), ({"span": 10}, 20), ({"halflife": 2}, 10)])
def test_ewm(series, kw, mp):
    df, x = series
    same(got(p.ewm(df, "x", "y", p.decay_of(**kw), mp=mp), "y"), x.ewm(**kw, min_periods=mp).mean(), 1e-8)


def test_ewm_recursive(series):
    df, x = series
    clean = df.filter("x is not null")
    same(got(p.ewm(clean, "x", "y", p.decay_of(halflife=5), adjust=False), "y"), x.dropna().ewm(halflife=5, adjust=False).mean().reset_index(drop=True), 1e-8)


def test_share_below(series):
    df, x = series
    want = x.dropna().reset_index(drop=True).rolling(120).apply(lambda v: (v[-1] > v[:-1]).sum() / (len(v) - 1), raw=True)
    same(got(p.share_below(df.filter("x is not null"), "x", "y", 120), "y"), want)


def test_average_rank(spark):
    df = spark.createDataFrame([("g", v) for v in (3.0, 1.0, 3.0, 2.0, None)], "g string, v double")
    out = {(r["v"], r["r"]) for r in df.withColumn("r", p.rank_share(F.col("v"), ["g"])).collect()}
    assert out == {(1.0, 0.25), (2.0, 0.5), (3.0, 0.875), (None, None)}


def test_null_safety(spark):
    df = spark.createDataFrame([(None, 0.0), (2.0, 0.0), (-9.0, 3.0)], "x double, y double")
    rows = df.select(p.clip(F.col("x"), -1, 1).alias("c"), p.div(F.col("x"), F.col("y")).alias("d"), p.flag(F.col("x") > 1).alias("f")).collect()
    assert [tuple(r) for r in rows] == [(None, None, 0), (1.0, None, 1), (-1.0, -3.0, 0)]


def test_past_does_not_see_the_future(series):
    df, _ = series
    whole = got(p.ewm(p.robust_z(df, "x", "z", 60, mp=20), "z", "y", 0.8), "y")
    cut = got(p.ewm(p.robust_z(df.filter("dt < date '2020-09-01'"), "x", "z", 60, mp=20), "z", "y", 0.8), "y")
    same(whole[: len(cut)].reset_index(drop=True), cut, 1e-12)
