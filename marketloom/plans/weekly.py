"""Queries of the weekly layer and of the integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.primitives import decay_of, unit
from ..operators import bars as b
from ..operators import features as f
from ..operators import integrity as g
from ..operators import weekly as w
from . import features as pf
from . import oracle as o
from .output import result, sql_result

QUERIES, ORACLES = {}, {}
W = "PARTITION BY symbol ORDER BY dt"
EQUITY, CREDIT = ["AFRICA", "AMERICA", "ASIA", "EUROPE"], "MIDDLE EAST"
ROLES = {"home": "AFRICA", "credit": CREDIT, "usd": CREDIT}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


FRIDAYS = [
    f"wk0 AS (SELECT symbol, dt, close, volume, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret, close * volume AS dv FROM m_region WHERE isodow(dt) = 5)",
    "wk AS (SELECT * FROM wk0 WHERE dt IN (SELECT dt FROM wk0 GROUP BY dt HAVING count(ret) = (SELECT count(DISTINCT symbol) FROM wk0)))",
]
SIGNALS = [
    o.robust("wk", "sg1", "dv", "z", 60, 20, 0.0, 5.0),
    o.ewm("sg1", "sg2", "z", "flow_pressure", decay_of(halflife=2), 10),
    f"sg3 AS (SELECT *, {o.roll('stddev_samp({})', 'ret', 20, 20)} AS vol20 FROM sg2)",
    f"sg4 AS (SELECT *, {o.roll('quantile_cont({}, 0.1)', 'vol20', 252, 20)} AS q FROM sg3)",
    "sg5 AS (SELECT symbol, greatest(coalesce(arg_max(q, dt), 0.01), 0.01) AS floor FROM sg4 GROUP BY symbol)",
    "sg AS (SELECT sg4.*, ret / (CASE WHEN vol20 IS NOT NULL THEN greatest(vol20, floor) END) AS risk_direction FROM sg4 JOIN sg5 USING (symbol))",
    f"lg0 AS (SELECT symbol, dt, row_number() OVER ({W}) AS n, lag(flow_pressure) OVER ({W}) AS flow_pressure, lag(risk_direction) OVER ({W}) AS risk_direction, lag(ret) OVER ({W}) AS ret FROM sg)",
    "lg AS (SELECT * FROM lg0 WHERE n > 1)",
]
BASE = [o.market(), *FRIDAYS, *SIGNALS]


def weekly(spark, d):
    return w.weekly_data(b.market(spark, d))


def signals(spark, d):
    return w.risk_direction(w.flow_pressure(weekly(spark, d)))


def late(spark, d):
    return w.lagged(signals(spark, d), "flow_pressure", "risk_direction", "ret")


@query("a12_r36_r37_weekly_signals", sql_result(BASE, "sg", ["symbol", "dt"], ["ret", "dv", "flow_pressure", "vol20", "risk_direction"]))
def weekly_signals(spark, d):
    return result(signals(spark, d), ["symbol", "dt"], ["ret", "dv", "flow_pressure", "vol20", "risk_direction"])


VOLR = [
    f"vr0 AS (SELECT symbol, dt, {o.roll('stddev_samp({})', 'ret', 156, 52)} AS s, {o.roll('stddev_samp({})', 'ret', 20, 20)} AS v FROM lg WHERE ret IS NOT NULL)",
    "vr1 AS (SELECT symbol, median(s) AS mid, count(*) AS n, arg_max(v, dt) AS now FROM vr0 GROUP BY symbol)",
    "vr2 AS (SELECT symbol, any_value(mid) AS mid, any_value(n) AS n, any_value(now) AS now, median(abs(s - mid)) AS mad FROM vr0 JOIN vr1 USING (symbol) GROUP BY symbol)",
    "vr3 AS (SELECT symbol, CASE WHEN n < 156 THEN 1.0 ELSE (now - mid) / (1.4826 * mad + 1e-9) END AS regime FROM vr2)",
    "vr AS (SELECT *, (SELECT median(regime) FROM vr3) AS overall FROM vr3)",
]


@query("r38_volatility_regime", sql_result([*BASE, *VOLR], "vr", ["symbol"], ["regime", "overall"]))
def volatility_regime(spark, d):
    return result(w.volatility_regime(late(spark, d)), ["symbol"], ["regime", "overall"])


ALIGN = [
    "al0 AS (SELECT dt, symbol, ret FROM lg WHERE ret IS NOT NULL AND dt IN (SELECT DISTINCT dt FROM lg WHERE ret IS NOT NULL ORDER BY dt DESC LIMIT 12))",
    "al1 AS (SELECT a.symbol, b.symbol AS other, CASE WHEN count(*) >= 12 THEN corr(a.ret, b.ret) END AS c FROM al0 a JOIN al0 b ON a.dt = b.dt AND a.symbol < b.symbol GROUP BY 1, 2)",
    "al AS (SELECT coalesce(avg(c), 0.5) AS alignment FROM al1)",
]


@query("r41_region_alignment", sql_result([*BASE, *ALIGN], "al", [], ["alignment"]))
def alignment(spark, d):
    return result(w.region_alignment(late(spark, d).filter("ret is not null")), [], ["alignment"])


COH = [
    "co0 AS (SELECT dt, " + ", ".join(f"max(CASE WHEN symbol = 'AFRICA' THEN {c} END) AS h{i}, median(CASE WHEN symbol IN ('AMERICA', 'ASIA', 'EUROPE') THEN {c} END) AS o{i}" for i, c in enumerate(("flow_pressure", "risk_direction"))) + " FROM lg GROUP BY dt ORDER BY dt DESC LIMIT 12)",
    f"co AS (SELECT CASE WHEN count(*) < 12 THEN 0.0 ELSE coalesce({o.clip('(corr(h0, o0) + corr(h1, o1)) / 2', -1, 1)}, 0.0) END AS coherence FROM co0)",
]


@query("r42_coherence", sql_result([*BASE, *COH], "co", [], ["coherence"]))
def coherence(spark, d):
    return result(w.coherence(late(spark, d), "AFRICA", EQUITY[1:]), [], ["coherence"])


LABEL = "CASE WHEN score > 0.6 THEN 'RISK-ON' WHEN score > 0.5 THEN 'WEAK RISK-ON' WHEN score > 0.4 THEN 'NEUTRAL' WHEN score > 0.3 THEN 'WEAK RISK-OFF' ELSE 'RISK-OFF' END"
_F = lambda s: f"(SELECT flow_pressure FROM gl0 WHERE symbol = '{s}')"
_SUM = " + ".join(f"(tanh({_F(s)}) + 1) / 2" for s in EQUITY)
STATE = [
    "gl0 AS (SELECT * FROM lg WHERE dt = (SELECT max(dt) FROM lg))",
    f"""gl1 AS (SELECT max(dt) AS dt, (median(flow_pressure) FILTER (symbol <> '{CREDIT}') + max(flow_pressure) FILTER (symbol = 'EUROPE')) / 2 - max(flow_pressure) FILTER (symbol = '{CREDIT}') AS capital_rotation,
      sum(CASE WHEN symbol <> '{CREDIT}' AND flow_pressure > 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS participation, sum(CASE WHEN symbol <> '{CREDIT}' AND risk_direction > 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE AS risk_breadth,
      abs({_F('AFRICA')}) > 2 * abs(median(flow_pressure) FILTER (symbol IN ('AMERICA', 'ASIA', 'EUROPE'))) AS dominance,
      {o.clip(f"0.5 * ({_SUM}) / 4 + 0.45 * sum(CASE WHEN symbol <> '{CREDIT}' AND flow_pressure > 0 THEN 1 ELSE 0 END) / 4 + 0.05 * (tanh({_F(CREDIT)}) * tanh({_F('AFRICA')}) + 1) / 2", 0, 1)} AS score FROM gl0)""",
    f"us AS (SELECT close / nullif(lag(close, 9) OVER (ORDER BY dt), 0) - 1 AS t, dt FROM wk WHERE symbol = '{CREDIT}')",
    f"gl AS (SELECT *, {LABEL} AS label, (SELECT CASE WHEN t > 0.02 THEN 'STRONG' WHEN t < -0.02 THEN 'WEAK' ELSE 'NEUTRAL' END FROM us ORDER BY dt DESC LIMIT 1) AS usd FROM gl1)",
]
STATE_OUT = (["dt", "label", "usd", "dominance"], ["capital_rotation", "participation", "risk_breadth", "score"])


@query("a9_a10_p30_p33_p34_p36_global_state", sql_result([*BASE, *STATE], "gl", *STATE_OUT))
def global_state(spark, d):
    return result(w.global_state(late(spark, d), weekly(spark, d), ROLES, EQUITY, [CREDIT], ["EUROPE"]), *STATE_OUT)


THURSDAYS = f"th AS (SELECT * FROM (SELECT symbol, dt, close, volume, close / nullif(lag(close) OVER ({W}), 0) - 1 AS ret, close * volume AS dv FROM m_region WHERE isodow(dt) = 4) WHERE ret IS NOT NULL)"
PWM = [
    f"pw1 AS (SELECT *, {o.roll('stddev_samp({})', 'ret', 20, 20)} AS vol20, quantile_cont(ret, 0.01) OVER (PARTITION BY symbol) AS lo, quantile_cont(ret, 0.99) OVER (PARTITION BY symbol) AS hi, row_number() OVER ({W}) AS k FROM th)",
    f"pw2 AS (SELECT *, {o.roll('quantile_cont({}, 0.1)', 'vol20', 252, 20)} AS fl FROM pw1)",
    o.robust("pw2", "pw3", "dv", "pz", 60, 20, 0.0, 5.0),
    "pw4 AS (SELECT t.symbol, t.k, (count(*) FILTER (u.dv < t.dv) + (count(*) FILTER (u.dv = t.dv) + 1) / 2.0::DOUBLE) / count(*) AS rk, count(*) AS n FROM pw3 t JOIN pw3 u ON t.symbol = u.symbol AND u.k BETWEEN t.k - 251 AND t.k GROUP BY 1, 2)",
    "pw5 AS (SELECT pw3.*, CASE WHEN n >= 20 THEN rk END AS rk, 0.6 * pz + 0.4 * least(greatest(ret, lo), hi) / (CASE WHEN vol20 IS NOT NULL AND fl IS NOT NULL THEN greatest(vol20, fl, 0.01) END) AS raw0 FROM pw3 JOIN pw4 USING (symbol, k))",
    "pw6 AS (SELECT *, CASE WHEN rk > 0.99 AND abs(ret) < 0.5 * vol20 THEN raw0 * 0.5 ELSE raw0 END AS raw FROM pw5)",
    o.robust("pw6", "pw7", "raw", "pz2", 60, 20, 0.0, 5.0),
    o.ewm("pw7", "pwm", "pz2", "pwm", decay_of(halflife=2), 10),
]


@query("a13_r39_participation_momentum", sql_result([o.market(), THURSDAYS, *PWM], "pwm", ["symbol", "dt"], ["vol20", "pwm"]))
def participation(spark, d):
    return result(w.participation_momentum(w.weekly_data_v3(b.market(spark, d))), ["symbol", "dt"], ["vol20", "pwm"])


_P = lambda s: f"(SELECT pwm FROM p30 WHERE symbol = '{s}')"
_POS = lambda ss: "(" + " + ".join(f"(CASE WHEN {_P(s)} > 0 THEN 1 ELSE 0 END)" for s in ss) + f") / {len(ss)}.0::DOUBLE"
STATE3 = [
    "p30 AS (SELECT * FROM pwm WHERE dt = (SELECT max(dt) FROM pwm))",
    f"""p31 AS (SELECT (SELECT max(dt) FROM pwm) AS dt, {_POS(EQUITY)} AS geo_breadth, {_POS([*EQUITY, CREDIT])} AS growth_breadth, {_POS(['EUROPE'])} AS inflation_breadth, {_POS([CREDIT, 'ASIA'])} AS defensive_breadth,
      {o.clip('0.5 * (' + ' + '.join(o.unit(_P(s)) for s in EQUITY) + f") / 4 + 0.45 * {o.unit('list_aggregate([' + ', '.join(_P(s) for s in EQUITY) + '], ' + chr(39) + 'median' + chr(39) + ')')} + 0.05 * (CASE WHEN sign({_P(CREDIT)}) = sign({_P('AFRICA')}) THEN 1 ELSE 0 END)", 0, 1)} AS score,
      tanh({_P('AFRICA')}) * tanh(list_aggregate([{_P('AMERICA')}, {_P('ASIA')}, {_P('EUROPE')}], 'median')) AS coherence,
      CASE WHEN {_P('AFRICA')} > 0 AND {_P(CREDIT)} > 0 THEN 'LIQUIDITY' WHEN {_P('EUROPE')} > 0 AND {_P(CREDIT)} > 0 THEN 'REFLATION' WHEN {_P('ASIA')} > 0 AND {_P(CREDIT)} > 0 THEN 'DEFENSIVE' ELSE 'MIXED' END AS driver, 'MEDIUM' AS confidence)""",
    f"p3 AS (SELECT *, {LABEL} AS label FROM p31)",
]
STATE3_OUT = (["dt", "driver", "confidence", "label"], ["geo_breadth", "growth_breadth", "inflation_breadth", "defensive_breadth", "score", "coherence"])


@query("a11_p31_p32_p35_global_state_v3", sql_result([o.market(), THURSDAYS, *PWM, *STATE3], "p3", *STATE3_OUT))
def global_state_v3(spark, d):
    return result(w.global_state_v3(w.participation_momentum(w.weekly_data_v3(b.market(spark, d))), EQUITY, CREDIT, CREDIT, "EUROPE", "ASIA"), *STATE3_OUT)


STAB = [
    "st0 AS (SELECT symbol, dt, flow_pressure AS x, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS r FROM lg)",
    f"st1 AS (SELECT symbol, dt, {o.roll('stddev_samp({})', 'x', 252, 12)} AS h FROM st0 WHERE x IS NOT NULL)",
    "st2 AS (SELECT symbol, count(*) AS n, arg_max(h, dt) AS historic FROM st1 GROUP BY symbol)",
    "st3 AS (SELECT symbol, CASE WHEN count(x) >= 2 THEN stddev_samp(x) END AS recent FROM st0 WHERE r <= 12 GROUP BY symbol)",
    "st4 AS (SELECT symbol, CASE WHEN count(x) >= 60 THEN median(x) END AS mid, arg_max(x, dt) AS now FROM st0 WHERE r <= 60 GROUP BY symbol)",
    "st5 AS (SELECT symbol, median(abs(x - mid)) AS mad, any_value(mid) AS mid, any_value(now) AS now FROM st0 JOIN st4 USING (symbol) WHERE r <= 60 GROUP BY symbol)",
    "st6 AS (SELECT symbol, CASE WHEN n >= 12 AND historic <> 0 THEN 1 - least(recent / nullif(historic, 0), 1.0) END AS stability, n >= 60 AND abs((now - mid) / nullif(1.4826 * mad, 0)) > 2.5 AS sh FROM st2 JOIN st3 USING (symbol) JOIN st5 USING (symbol))",
    "st AS (SELECT symbol, stability, (CASE WHEN stability < 0.5 THEN 1 ELSE 0 END)::INT AS unstable, (CASE WHEN sh THEN 1 ELSE 0 END)::INT AS shift FROM st6)",
]


@query("r43_r44_stability", sql_result([*BASE, *STAB], "st", ["symbol", "unstable", "shift"], ["stability"]))
def stability(spark, d):
    return result(w.stability(late(spark, d), "flow_pressure"), ["symbol", "unstable", "shift"], ["stability"])


STRESS = [
    "cs0 AS (SELECT a.symbol || '|' || b.symbol AS symbol, a.dt, a.ret AS x, b.ret AS y, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.dt) AS k FROM wk a JOIN wk b ON a.dt = b.dt AND a.symbol < b.symbol)",
    "cs1 AS (SELECT t.symbol, t.k, any_value(t.dt) AS dt, sum(q) AS sw, sum(q * u.x) AS sx, sum(q * u.y) AS sy, sum(q * u.x * u.x) AS sxx, sum(q * u.y * u.y) AS syy, sum(q * u.x * u.y) AS sxy FROM cs0 t JOIN cs0 u ON t.symbol = u.symbol AND u.k <= t.k, LATERAL (SELECT pow(1 - 2.0::DOUBLE / 61, t.k - u.k) AS q) GROUP BY 1, 2)",
    "cs2 AS (SELECT dt, k, sxy / sw - sx / sw * sy / sw AS c, sxx / sw - sx / sw * sx / sw AS vx, syy / sw - sy / sw * sy / sw AS vy FROM cs1)",
    "cs3 AS (SELECT dt, 1 AS one, avg(CASE WHEN k > 1 AND vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END) AS mean_corr FROM cs2 GROUP BY dt)",
    o.robust("cs3", "cs4", "mean_corr", "stress_z", 156, 52, 1e-9, key="one"),
    "cs AS (SELECT *, (CASE WHEN stress_z > 2 THEN 1 ELSE 0 END)::INT AS stress FROM cs4)",
]


@query("r40_correlation_stress", sql_result([o.market(), *FRIDAYS, *STRESS], "cs", ["dt", "stress"], ["mean_corr", "stress_z"]))
def correlation_stress(spark, d):
    return result(w.correlation_stress(weekly(spark, d)), ["dt", "stress"], ["mean_corr", "stress_z"])


HYST = [
    "hy0 AS (SELECT symbol, dt, round((tanh(flow_mom) + 1) / 2, 9) AS score, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS k FROM fm WHERE flow_mom IS NOT NULL AND isodow(dt) = 5)",
    f"hy1 AS (SELECT *, {LABEL} AS fresh FROM hy0)",
    """hy2 AS (SELECT symbol, dt, k, score, fresh AS label, 1 AS count FROM hy1 WHERE k = 1
      UNION ALL SELECT n.symbol, n.dt, n.k, n.score,
        CASE WHEN n.fresh <> p.label AND n.fresh IN ('RISK-ON', 'WEAK RISK-ON') AND p.label IN ('NEUTRAL', 'WEAK RISK-OFF', 'RISK-OFF') AND p.count < 3 THEN p.label ELSE n.fresh END,
        CASE WHEN n.fresh = p.label OR (n.fresh IN ('RISK-ON', 'WEAK RISK-ON') AND p.label IN ('NEUTRAL', 'WEAK RISK-OFF', 'RISK-OFF') AND p.count < 3) THEN p.count + 1 ELSE 1 END
      FROM hy2 p JOIN hy1 n ON n.symbol = p.symbol AND n.k = p.k + 1)""",
]


def hysteresis_scores(spark, d):
    df = f.flow_momentum(b.market(spark, d)).filter("flow_mom is not null").filter(F.weekday("dt") == 4)
    return df.select("symbol", "dt", F.round(unit(F.col("flow_mom")), 9).alias("score"))


@query("a28_regime_hysteresis", sql_result([*pf.BASE, *HYST], "hy2", ["symbol", "dt", "label", "count"], ["score"]).replace("WITH ", "WITH RECURSIVE ", 1))
def hysteresis(spark, d):
    return result(w.regime_hysteresis(hysteresis_scores(spark, d)), ["symbol", "dt", "label", "count"], ["score"])


HELD = [
    "rh0 AS (SELECT *, k - row_number() OVER (PARTITION BY symbol, fresh ORDER BY k) AS island FROM hy1)",
    "rh AS (SELECT symbol, dt, score, fresh AS label, row_number() OVER (PARTITION BY symbol, fresh, island ORDER BY k) AS persistence FROM rh0)",
]


@query("p36_s13_regime_history", sql_result([*pf.BASE, *HYST[:2], *HELD], "rh", ["symbol", "dt", "label", "persistence"], ["score"]))
def regime_history(spark, d):
    return result(w.regime_history(hysteresis_scores(spark, d)), ["symbol", "dt", "label", "persistence"], ["score"])


NEED = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "ATLANTIS"]
REQUIRED = "rq(symbol) AS (VALUES " + ", ".join(f"('{s}')" for s in NEED) + ")"


@query("v1_integrity", sql_result([o.market(), REQUIRED, "v1 AS (SELECT rq.symbol, count(close)::BIGINT AS valid_rows, count(m.symbol) > 0 AS present, count(close) >= 200 AS ok FROM rq LEFT JOIN m_region m USING (symbol) GROUP BY rq.symbol)"], "v1", ["symbol", "valid_rows", "present", "ok"]))
def integrity(spark, d):
    need = spark.createDataFrame([(s,) for s in NEED], "symbol string")
    return g.integrity(b.market(spark, d), need).select("symbol", "valid_rows", "present", "ok")


def verdict(strict: bool) -> list[str]:
    bad = "max_ret > 0.25" if strict else "max_ret > 0.40"
    text = "'DATA ISSUE (extreme weekly return >25%)'" if strict else "'DATA ISSUE (extreme weekly return >40%)'"
    volume = "WHEN min_volume < 0 THEN 'DATA ISSUE (negative volume)' " if strict else ""
    mild = "" if strict else "WHEN max_ret > 0.25 THEN 'EXTREME EVENT (ret >25%, señal válida pero inusual)' "
    return [
        f"ck0 AS (SELECT *, abs(close / nullif(lag(close, 5) OVER ({W}), 0) - 1) AS r5 FROM m_region)",
        "ck1 AS (SELECT symbol, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS null_share, min(close) AS min_close, max(r5) AS max_ret, min(volume) AS min_volume FROM ck0 GROUP BY symbol)",
        f"ck AS (SELECT *, CASE WHEN null_share > 0.1 THEN 'DATA ISSUE (NaNs >10%)' WHEN min_close <= 0 THEN 'DATA ISSUE (close <=0)' {volume}WHEN {bad} THEN {text} {mild}END AS issue, coalesce(NOT (null_share > 0.1 OR min_close <= 0 OR {bad}{' OR min_volume < 0' if strict else ''}), true) AS valid FROM ck1)",
    ]


@query("v2_global_gate", sql_result([o.market(), *verdict(False)], "ck", ["symbol", "issue", "valid"], ["null_share", "min_close", "max_ret"]))
def gate(spark, d):
    return result(g.global_gate(b.market(spark, d)), ["symbol", "issue", "valid"], ["null_share", "min_close", "max_ret"])


@query("v3_global_gate_strict", sql_result([o.market(), *verdict(True)], "ck", ["symbol", "issue", "valid"], ["null_share", "min_close", "max_ret"]))
def gate_strict(spark, d):
    return result(g.global_gate(b.market(spark, d), strict=True), ["symbol", "issue", "valid"], ["null_share", "min_close", "max_ret"])


@query("v4_series_gate", sql_result([o.market(), "v4 AS (SELECT symbol, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) <= 0.2 AND count(close) >= 60 AS ok FROM m_region GROUP BY symbol)"], "v4", ["symbol", "ok"]))
def series_gate(spark, d):
    return g.series_gate(b.market(spark, d)).select("symbol", "ok")


@query("v5_v6_coverage", sql_result([o.market(), REQUIRED, "v6 AS (SELECT symbol AS missing, (SELECT count(DISTINCT symbol) FROM m_region) < 6 * 0.7 AS low_coverage FROM rq WHERE symbol NOT IN (SELECT symbol FROM m_region))"], "v6", ["missing", "low_coverage"]))
def coverage(spark, d):
    need = spark.createDataFrame([(s,) for s in NEED], "symbol string")
    return g.coverage(b.market(spark, d), need)


@query("a26_distinct_symbols_by_year", sql_result([o.market(), "ds AS (SELECT DISTINCT symbol, year(dt)::INT AS y FROM m_region WHERE close IS NOT NULL)"], "ds", ["symbol", "y"]))
def distinct_symbols(spark, d):
    return b.market(spark, d).filter("close is not null").select("symbol", F.year("dt").alias("y")).distinct()
