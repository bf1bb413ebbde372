"""Queries of the sector snapshot, options structure and futures positioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ladders as lad
from ..operators import bars as b
from ..operators import features as f
from ..operators import options as op
from ..operators import snapshot as s
from . import features as pf
from . import oracle as o
from .output import result, sql_result

QUERIES, ORACLES = {}, {}
W = "PARTITION BY symbol ORDER BY dt"
#: The futures map for the nations that stand in for markets.
MAP = {"SPY": "nation_1", "XLK": "NATION_2$", "XLF": "nation.3", "XLI": "NATION_4", "XLP": "NATION_5", "XLV": "NATION_6", "XLU": "NATION_7", "RATES_2Y": "NATION_8", "FED": "NATION_9", "SOFR": "NATION_10", "RATES_10Y": "NATION_11", "RATES_LONG": "NATION_12|NATION_13", "USD": "NATION_2[0-4]", "VOL": "NATION"}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


CALM = "(1 / (1 + coalesce(greatest(vix_z - 0.5, 0.0), 0.0)))"
SNAP = [
    f"sn0 AS (SELECT act.*, rel / nullif(lag(rel, 20) OVER ({W}), 0) - 1 AS pm FROM act)",
    "hm AS (SELECT report_dt, cot_z AS home_z FROM ct WHERE market = (SELECT max(market) FROM ct WHERE regexp_matches(market, 'nation_1', 'i')))",
    "sn1 AS (SELECT sn0.*, breadth_signal, vix_z, home_z, CASE WHEN count(flow_mom) OVER (PARTITION BY sn0.dt) >= 2 THEN stddev_samp(flow_mom) OVER (PARTITION BY sn0.dt) END AS flow_dispersion FROM sn0 LEFT JOIN feat ON feat.dt = sn0.dt ASOF LEFT JOIN hm ON sn0.dt >= hm.report_dt)",
    "sn2 AS (SELECT *, tanh(pm) AS tp, tanh(flow_mom) AS tf, tanh(flow_acc) AS ta, tanh(vol_z) AS tv FROM sn1)",
    "sn3 AS (SELECT *, CASE WHEN abs(-tp * tf) < 0.02 THEN 0.0 ELSE -tp * tf END AS dv FROM sn2)",
    """sn4 AS (SELECT *, 2 * dv + 0.8 * ((-tf - dv) * (CASE WHEN abs(tf) < 0.2 THEN 0.5 ELSE 1.0 END)) + (CASE WHEN ta < 0 THEN -ta ELSE -1.5 * ta END) + (CASE WHEN flow_mom < 0 THEN 0.8 * tv ELSE 0.0 END) AS risk_score,
      0.4::DOUBLE * (CASE WHEN pm > 0 AND flow_mom < 0 THEN 1 ELSE 0 END) + 0.2::DOUBLE * (CASE WHEN flow_mom < -0.1 THEN 1 ELSE 0 END) + 0.3::DOUBLE * (CASE WHEN flow_acc < 0 THEN 1 ELSE 0 END) + 0.1::DOUBLE * (CASE WHEN vol_z > 1 THEN 1 ELSE 0 END) AS binary_score,
      CASE WHEN price_z > 1 AND flow_mom < -0.5 THEN 'DISTRIBUCION CONFIRMADA' WHEN price_z > 0.5 AND flow_mom < 0 THEN 'DISTRIBUCION TEMPRANA' WHEN price_z < -0.5 AND flow_mom > 0.5 THEN 'ACUMULACION FUERTE' WHEN price_z < 0 AND flow_mom > 0 THEN 'ACUMULACION'
        WHEN flow_mom > 0 AND acc_z > 0 THEN 'CONFIRMACION ALCISTA' WHEN flow_mom < 0 AND acc_z < 0 THEN 'CONFIRMACION BAJISTA' WHEN abs(price_z) < 0.2 AND flow_mom < -0.5 THEN 'AGOTAMIENTO' ELSE 'NEUTRAL' END AS phase, -tp * tf AS divergence FROM sn3)""",
    "pe0 AS (SELECT symbol, dt, list(flow_mom) OVER (PARTITION BY symbol ORDER BY dt ROWS 2 PRECEDING) AS l FROM sn4 WHERE flow_mom IS NOT NULL)",
    f"pe AS (SELECT a.symbol, a.dt, last_value(l IGNORE NULLS) OVER (PARTITION BY a.symbol ORDER BY a.dt ROWS UNBOUNDED PRECEDING) AS l FROM sn4 a LEFT JOIN pe0 ON pe0.symbol = a.symbol AND pe0.dt = a.dt)",
    """sn5 AS (SELECT sn4.*, 1 / (1 + exp(-risk_score / 1.5)) AS p_cont, 1 / (1 + exp(-5 * (binary_score - 0.5))) AS p_bin,
      0.4 * flow_mom + 0.3 * pm + 0.2 * ta + 0.1 * vol_z + (CASE WHEN phase IN ('ACUMULACION', 'ACUMULACION FUERTE') THEN 0.2 WHEN phase IN ('DISTRIBUCION CONFIRMADA', 'DISTRIBUCION TEMPRANA') THEN -0.2 ELSE 0.0 END) AS opportunity,
      abs(divergence) * (0.5 * abs(vol_z) + 0.5 * abs(flow_acc)) AS rawc,
      CASE WHEN l IS NULL OR len(l) < 3 THEN 'SIN_DATOS' WHEN (l[1] > 0)::INT + (l[2] > 0)::INT + (l[3] > 0)::INT >= 2 THEN 'PERSISTENCIA_ALCISTA' WHEN (l[1] < 0)::INT + (l[2] < 0)::INT + (l[3] < 0)::INT >= 2 THEN 'PERSISTENCIA_BAJISTA' ELSE 'TRANSICION' END AS persistence
      FROM sn4 JOIN pe USING (symbol, dt))""",
    f"""sn AS (SELECT *, CASE WHEN risk_score > 1.2 THEN 'FUERTE' WHEN risk_score > 0.6 THEN 'MODERADA' WHEN risk_score > 0.3 THEN 'DEBIL' ELSE 'NINGUNA' END AS distribution_class,
      CASE WHEN risk_score > 1.2 THEN 'ALTA' WHEN rawc > 0.6 THEN 'ALTA' WHEN rawc > 0.3 THEN 'MEDIA' ELSE 'BAJA' END AS confidence,
      CASE WHEN opportunity > 0.4 THEN 'OPORTUNIDAD CLARA' WHEN opportunity > 0.2 THEN 'OPORTUNIDAD MODERADA' WHEN opportunity > 0.05 THEN 'SEGUIR CON PRUDENCIA' ELSE 'NO OPERAR' END AS operability,
      CASE WHEN flow_mom > 0.2 THEN 'ALCISTA' WHEN flow_mom < -0.2 THEN 'BAJISTA' ELSE 'TRANSICION' END AS direction,
      CASE WHEN persistence = 'TRANSICION' AND phase = 'ACUMULACION' THEN 'SEÑAL TEMPRANA' WHEN persistence LIKE 'PERSISTENCIA%' THEN 'SEÑAL CONSOLIDADA' ELSE 'NEUTRAL' END AS signal_state,
      CASE WHEN binary_score >= 0.7 THEN 'DISTRIBUCION FUERTE' WHEN binary_score >= 0.4 THEN 'POSIBLE DISTRIBUCION' ELSE 'SIN SENAL' END AS alert_level,
      CASE WHEN flow_mom > 2 THEN 'Fuerte entrada' WHEN flow_mom > 0.8 THEN 'Entrada moderada' WHEN flow_mom < -2 THEN 'Fuerte salida' WHEN flow_mom < -0.8 THEN 'Salida moderada' ELSE 'Neutral' END AS flow_intensity,
      CASE WHEN flow_dispersion > 0.5 THEN 'Alta dispersion (rotacion)' WHEN flow_dispersion > 0.2 THEN 'Dispersion moderada (transicion)' ELSE 'Baja dispersion (trend)' END AS dispersion_text,
      CASE WHEN vix_z > 1.5 THEN 'ALTA VOLATILIDAD' WHEN vix_z > 1 THEN 'Volatilidad elevada' END AS vix_text,
      (0.4 * p_bin + 0.3 * p_cont + 0.3 * (tanh(risk_score * (1 + 0.3 * coalesce(home_z, 0)) * {CALM}) + 1) / 2) * {CALM} AS unified, risk_score * (1 + 0.3 * coalesce(home_z, 0)) AS macro_adjusted, risk_score * (1 + 0.3 * coalesce(home_z, 0)) * {CALM} AS volatility_adjusted,
      greatest(0.0, abs(pm) + abs(flow_mom) - 0.1 * abs(vol_z)) AS signal_quality,
      greatest(0.0, least(1.0, 0.4 * greatest(0.0, breadth_signal) + 0.3 * (1 - (CASE WHEN vix_z IS NOT NULL THEN least(vix_z, 2.0) END) / 2) + 0.3 * (1 - flow_dispersion))) AS system_confidence FROM sn5)""",
]
COT = [
    """ct0 AS (SELECT n_name AS market, date_trunc('week', l_shipdate)::DATE AS report_dt, coalesce(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN l_quantity::BIGINT END), 0)::DOUBLE AS asset_long,
      coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity::BIGINT END), 0)::DOUBLE AS asset_short FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
    "ct1 AS (SELECT *, asset_long - asset_short AS net_position, count(*) OVER (PARTITION BY market) AS n FROM ct0)",
    f"ct AS (SELECT *, {o.roll('avg({})', 'net_position', 52, 10, 'market', 'report_dt')} AS mean, {o.roll('stddev_samp({})', 'net_position', 52, 10, 'market', 'report_dt')} AS std, {o.zs('net_position', 52, 10, 0.0, 'market', 'report_dt')} AS cot_z FROM ct1 WHERE n >= 10)",
]
LABELS = ["symbol", "dt", "phase", "persistence", "distribution_class", "confidence", "operability", "direction", "signal_state", "alert_level", "flow_intensity", "dispersion_text", "vix_text"]
SCORES = ["risk_score", "binary_score", "divergence", "p_cont", "p_bin", "opportunity", "unified", "macro_adjusted", "volatility_adjusted", "signal_quality", "system_confidence"]


@query("p06_p23_p26_p27_r29_snapshot", sql_result([*pf.BASE, o.bench(), o.FEAR, pf.REL, pf.ACT, pf.FEAT, *COT, *SNAP], "sn", LABELS, SCORES))
def snapshot(spark, d):
    market, bench = b.market(spark, d), b.benchmark(spark, d)
    home = op.home_positioning(op.positioning_z(b.positioning(spark, d)), MAP["SPY"])
    return result(s.snapshot(market, bench, f.features_daily(market, bench, b.fear(spark, d)), home), LABELS, SCORES)


def tanh_z(src: str, out: str, x: str, col: str, n: int) -> list[str]:
    return [o.robust(src, f"{out}_z", x, "z__", n, n, 1e-9, 5.0, key="one"), f"{out} AS (SELECT * EXCLUDE (z__), tanh(z__) AS {col} FROM {out}_z)"]


OPTIONS = [
    "ov AS (SELECT o_orderdate::DATE AS dt, o_orderpriority AS u, sum(floor(o_totalprice)::BIGINT)::DOUBLE AS v FROM orders GROUP BY 1, 2)",
    "pc0 AS (SELECT o_orderdate::DATE AS dt, 1 AS one, count(*) FILTER (o_orderstatus = 'O')::DOUBLE / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS pcr FROM orders GROUP BY 1)",
    f"pc1 AS (SELECT dt, one, -coalesce(last_value(pcr IGNORE NULLS) OVER {o.win(None, 'one')}, 1.0) AS minus FROM pc0)",
    *tanh_z("pc1", "pc", "minus", "sentiment", 60),
    "ah0 AS (SELECT dt, 1 AS one, sum(v) AS v FROM ov GROUP BY dt)",
    f"ah1 AS (SELECT *, v / nullif({o.roll('avg({})', 'v', 60, 1, 'one')}, 0) AS rel FROM ah0)",
    *tanh_z("ah1", "ah", "rel", "activity", 60),
    "fr0 AS (SELECT dt, 1 AS one, sum(v * v) / nullif(sum(v) * sum(v), 0) AS h FROM ov GROUP BY dt)",
    f"fr1 AS (SELECT *, {o.roll('avg({})', 'h', 5, 1, 'one')} AS hhi FROM fr0)",
    *tanh_z("fr1", "fr", "hhi", "fragmentation", 120),
    f"om0 AS (SELECT dt, coalesce(sentiment, 0) AS sentiment, coalesce(activity, 0) AS activity, hhi, coalesce(fragmentation, 0) AS fragmentation FROM pc JOIN ah USING (dt) JOIN fr USING (dt))",
    f"om1 AS (SELECT *, {o.clip('0.4 * sentiment + 0.35 * activity + 0.25 * fragmentation', -1, 1)} AS oms FROM om0)",
    "om AS (SELECT *, CASE WHEN oms > 0.5 THEN 'ESTABLE' WHEN oms < -0.5 THEN 'FRÁGIL' ELSE 'NEUTRO' END AS oms_class, CASE WHEN oms > 0.5 THEN 1.10 WHEN oms < -0.5 THEN 0.85 ELSE 1.0 END AS risk_bias, CASE WHEN oms > 0.5 THEN 1.05 WHEN oms < -0.5 THEN 0.90 ELSE 1.0 END AS confidence_boost FROM om1)",
]
OMS = (["dt", "oms_class"], ["sentiment", "activity", "hhi", "fragmentation", "oms", "risk_bias", "confidence_boost"])


@query("r32_r35_p29_j3_j4_a5_options", sql_result(OPTIONS, "om", *OMS))
def options(spark, d):
    return result(op.market_structure(b.put_call(spark, d), b.options_volume(spark, d)), *OMS)


@query("r30_r31_positioning_z", sql_result(COT, "ct", ["market", "report_dt"], ["net_position", "mean", "std", "cot_z"]))
def positioning(spark, d):
    return result(op.positioning_z(b.positioning(spark, d)), ["market", "report_dt"], ["net_position", "mean", "std", "cot_z"])


VALUES = "mm(key, pattern) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in MAP.items()) + ")"
BY_KEY = [
    VALUES,
    "sk0 AS (SELECT key, median(cot_z) AS z, count(*)::BIGINT AS instruments, max(report_dt) AS report_dt FROM ct JOIN mm ON regexp_matches(market, pattern, 'i') AND NOT regexp_matches(market, 'MICRO|NANO', 'i') WHERE report_dt = (SELECT max(report_dt) FROM ct) GROUP BY key)",
    "sk AS (SELECT *, CASE WHEN z > 1.5 THEN 'FUERTEMENTE ALCISTA' WHEN z > 0.5 THEN 'ALCISTA' WHEN z < -1.5 THEN 'FUERTEMENTE BAJISTA' WHEN z < -0.5 THEN 'BAJISTA' ELSE 'NEUTRAL' END AS label, date_diff('day', report_dt, DATE '2001-11-10') > 8 AS stale FROM sk0 WHERE z IS NOT NULL)",
]


#: Each market's own last row in place of the last report date's rows.
LATEST = "lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY report_dt DESC) AS back FROM ct) WHERE back = 1)"
BY_OWN_DATE = [VALUES, LATEST, BY_KEY[1].replace("FROM ct JOIN", "FROM lt JOIN").replace("WHERE report_dt = (SELECT max(report_dt) FROM ct) ", ""), BY_KEY[2]]


@query("a6_latest_by_market", sql_result([*COT, LATEST], "lt", ["market", "report_dt"], ["net_position", "cot_z"]))
def latest(spark, d):
    return result(op.latest_by_market(op.positioning_z(b.positioning(spark, d))), ["market", "report_dt"], ["net_position", "cot_z"])


def by_key(spark, d, by_market=False):
    rows = spark.createDataFrame(list(MAP.items()), "key string, pattern string")
    return op.sector_positioning(op.positioning_z(b.positioning(spark, d)), rows, by_market)


@query("j7_a6_a7_p38_p39_sector_positioning", sql_result([*COT, *BY_KEY], "sk", ["key", "instruments", "report_dt", "label", "stale"], ["z"]))
def sector_positioning(spark, d):
    df = by_key(spark, d).withColumn("stale", lad.stale(F.to_date(F.lit("2001-11-10")), F.col("report_dt")))
    return result(df, ["key", "instruments", "report_dt", "label", "stale"], ["z"])


def z_of(k: str) -> str:
    return f"coalesce((SELECT z FROM sk WHERE key = '{k}'), 0)::DOUBLE"


FACTORS = [
    f"""sf0 AS (SELECT list_aggregate([{z_of('SPY')}, {z_of('XLK')}, {z_of('XLF')}, {z_of('XLI')}], 'median') AS risk, list_aggregate([{z_of('XLP')}, {z_of('XLV')}, {z_of('XLU')}], 'median') AS defensive,
      (0.5 * {z_of('RATES_2Y')} + 0.3 * {z_of('FED')} + 0.2 * {z_of('SOFR')}) / 3 AS short_rates, (0.6 * {z_of('RATES_10Y')} + 0.4 * {z_of('RATES_LONG')}) / 2 AS long_rates, {z_of('SPY')} AS home)""",
    "sf AS (SELECT *, risk - defensive AS rotation, long_rates - short_rates AS curve_spread, CASE WHEN risk - defensive > 0.2 AND home > 0 THEN 'ACUMULACION FUERTE' WHEN risk - defensive > 0 THEN 'ACUMULACION DEBIL' ELSE 'NEUTRAL/DEBIL' END AS inferred FROM sf0)",
]
FACTOR_OUT = (["inferred"], ["risk", "defensive", "rotation", "short_rates", "long_rates", "curve_spread"])


@query("a8_synthetic_factors", sql_result([*COT, *BY_OWN_DATE, *FACTORS], "sf", *FACTOR_OUT))
def factors(spark, d):
    return result(op.synthetic_factors(by_key(spark, d, by_market=True)), *FACTOR_OUT)


@query("s11_a25_merge_positioning", sql_result([*COT[:1], "mg AS (SELECT market, report_dt, CASE WHEN report_dt < DATE '2000-01-01' THEN asset_long ELSE asset_long + 1 END AS asset_long, asset_short FROM ct0)"], "mg", ["market", "report_dt"], ["asset_long", "asset_short"]))
def merge(spark, d):
    cot = b.positioning(spark, d)
    new = cot.withColumn("asset_long", F.col("asset_long") + 1)
    return result(op.merge_positioning(cot.filter("report_dt < date '2000-01-01'"), new), ["market", "report_dt"], ["asset_long", "asset_short"])
