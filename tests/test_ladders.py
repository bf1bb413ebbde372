"""Thresholds of the ladders, at and around the edges."""

import pytest
from pyspark.sql import functions as F

from marketloom.functions import ladders as lad


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(("score", "label"), [(0.6, "WEAK RISK-ON"), (0.601, "RISK-ON"), (0.5, "NEUTRAL"), (0.4, "WEAK RISK-OFF"), (0.3, "RISK-OFF"), (None, "RISK-OFF")])
def test_regime_label(spark, score, label):
    assert value(spark, lad.regime_label(F.lit(score).cast("double"))) == label


@pytest.mark.parametrize(("z", "label"), [(1.5, "ALCISTA"), (1.51, "FUERTEMENTE ALCISTA"), (0.5, "NEUTRAL"), (-0.5, "NEUTRAL"), (-1.5, "BAJISTA"), (-1.6, "FUERTEMENTE BAJISTA")])
def test_positioning(spark, z, label):
    assert value(spark, lad.positioning_label(F.lit(z))) == label


@pytest.mark.parametrize(("score", "label"), [(0.7, "DISTRIBUCION FUERTE"), (0.69, "POSIBLE DISTRIBUCION"), (0.4, "POSIBLE DISTRIBUCION"), (0.39, "SIN SENAL")])
def test_alert_is_inclusive(spark, score, label):
    assert value(spark, lad.alert_level(F.lit(score))) == label


def test_window_truncates_and_is_bounded(spark):
    assert [value(spark, lad.adaptive_window(F.lit(v))) for v in (-9.0, 0.1, 9.0)] == [90, 58, 30]


def test_phase_order(spark):
    got = lambda p, f, a: value(spark, lad.phase(F.lit(p), F.lit(f), F.lit(a)))
    assert got(1.1, -0.6, 0.0) == "DISTRIBUCION CONFIRMADA"
    assert got(0.6, -0.1, 0.0) == "DISTRIBUCION TEMPRANA"
    assert got(-0.6, 0.6, 0.0) == "ACUMULACION FUERTE"
    assert got(0.0, -0.6, 0.0) == "AGOTAMIENTO"


def test_driver_confidence(spark):
    got = lambda xs: value(spark, lad.driver_confidence(F.lit("A"), F.array(*map(F.lit, xs)).cast("array<string>") if xs is not None else F.lit(None).cast("array<string>")))
    assert [got(None), got([]), got(["A"]), got(["B", "A", "A"]), got(["B", "A", "A", "A", "A"])] == ["MEDIUM", "LOW", "LOW", "MEDIUM", "HIGH"]


def test_caps(spark):
    assert [value(spark, lad.cap_class(F.lit(v).cast("double"))) for v in (None, 50000.0, 50001.0, 10000.0)] == ["Unknown", "Mid", "Large", "Small"]
