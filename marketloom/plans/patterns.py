"""Queries of bar patterns, macro scores, flow attribution and the causal chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ladders as lad
from ..functions.primitives import decay_of
from ..operators import bars as b
from ..operators import causal as c
from ..operators import features as f
from ..operators import macro as m
from ..operators import patterns as p
from . import features as pf
from . import oracle as o
from .output import result, sql_result

QUERIES, ORACLES = {}, {}
ROLES = {"credit_up": "AFRICA", "credit_down": "AMERICA", "long_rate": "ASIA", "short_rate": "EUROPE"}
W = "PARTITION BY symbol ORDER BY dt"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def score_sql(src: str) -> list[str]:
    mean_volume = o.roll("avg({})", "volume", 20, 20)
    return [
        f"s1 AS (SELECT * FROM {src} WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL)",
        f"s2 AS (SELECT *, ({o.roll('max({})', 'high', 20, 20)} - {o.roll('min({})', 'low', 20, 20)}) / nullif(close, 0) AS compression, {o.zs('volume', 20, 20)} AS vz, close / nullif(lag(close, 20) OVER ({W}), 0) - 1 AS pc, {o.roll('avg({})', 'close', 50, 50)} AS ma FROM s1)",
        o.robust("s2", "s3", "pc", "pz", 60, 20, 0.0, 5.0),
        f"""s4 AS (SELECT *, {o.sigmoid('vz - pz')} AS absorption,
          (CASE WHEN low < lag(low) OVER ({W}) AND close > open AND volume > 1.5 * {mean_volume} THEN 1 ELSE 0 END)::INT AS spring,
          (CASE WHEN close > {o.roll('max({})', 'high', 20, 20, shift=1)} AND volume > {mean_volume} THEN 1 ELSE 0 END)::INT AS sos,
          (CASE WHEN abs(ma - lag(ma) OVER ({W})) < 0.1 * {o.roll('stddev_samp({})', 'close', 50, 50)} THEN 1 ELSE 0 END)::INT AS suppression FROM s3)""",
        f"sc AS (SELECT *, {o.clip('0.25 * (1 - (CASE WHEN compression IS NOT NULL THEN least(compression, 1.0) END)) + 0.25 * ' + o.clip('absorption', 0, 2) + ' / 2 + 0.2 * spring + 0.2 * sos + 0.1 * suppression', 0, 1)} AS score FROM s4)",
    ]


PHASE = [
    f"p1 AS (SELECT * EXCLUDE (rn), row_number() OVER ({W})::INT AS rn, {o.roll('avg({})', 'close', 50, 50)} / nullif({o.roll('avg({})', 'close', 200, 200)}, 0) - 1 AS trend, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r1 FROM sc)",
    f"p2 AS (SELECT *, {o.roll('stddev_samp({})', 'r1', 20, 20)} AS v20 FROM p1)",
    f"p3 AS (SELECT *, v20 / (avg(v20) OVER ({W} ROWS UNBOUNDED PRECEDING) + 1e-9) AS vol_norm FROM p2)",
    """p4 AS (SELECT *, CASE WHEN rn < 60 THEN 'INSUFICIENTE' WHEN spring = 1 THEN 'SPRING' WHEN sos = 1 THEN 'MARKUP INIT' WHEN score > 0.7 THEN 'ACCUMULATION' WHEN score > 0.5 THEN 'LATE ACCUMULATION' ELSE 'NEUTRAL' END AS phase,
      CASE WHEN rn < 200 THEN 'INSUFICIENT_DATA' WHEN trend > 0.02 AND vol_norm < 1 AND score > 0.6 THEN 'MARKUP' WHEN trend < -0.02 THEN 'DISTRIBUTION' WHEN compression < 0.3 AND score > 0.5 THEN 'ACCUMULATION' ELSE 'RANGE' END AS structure FROM p3)""",
    "ph AS (SELECT *, CASE WHEN rn > 200 THEN structure END AS structure_series, CASE WHEN rn > 60 THEN score END AS score_series FROM p4)",
]
PARTS = ["compression", "absorption", "score"]
FLAGS = ["symbol", "dt", "spring", "sos", "suppression"]


@query("w01_w06_pattern_score", sql_result([o.market(), *score_sql("m_region")], "sc", FLAGS, PARTS))
def pattern_score(spark, d):
    return result(p.pattern_score(b.market(spark, d)), FLAGS, PARTS)


STRUCT = (["symbol", "dt", "phase", "structure", "structure_series"], ["trend", "vol_norm", "score_series"])


@query("w07_w10_p41_phases", sql_result([o.market(), *score_sql("m_region"), *PHASE], "ph", *STRUCT))
def phases(spark, d):
    return result(p.phases(b.market(spark, d)), *STRUCT)


MOVE = f"""tr0 AS (SELECT symbol, dt, rn, structure_series AS n, score_series - lag(score_series, 5) OVER ({W}) AS g, lag(structure_series, 5) OVER ({W}) AS b FROM ph),
 tr AS (SELECT symbol, dt, CASE WHEN rn < 6 THEN 'SIN DATOS SUFICIENTES' WHEN n IS NULL OR b IS NULL THEN 'DATOS INSUFICIENTES' WHEN n = b THEN 'ESTABLE (' || n || ')'
   WHEN b IN ('RANGE', 'ACCUMULATION') AND n = 'MARKUP' THEN 'TRANSICIÓN ALCISTA: ' || b || ' → ' || n || (CASE WHEN g > 0.2 THEN ' (FUERTE)' ELSE ' (DÉBIL)' END)
   WHEN (b = 'MARKUP' AND n = 'DISTRIBUTION') OR (b = 'DISTRIBUTION' AND n = 'RANGE') THEN 'TRANSICIÓN BAJISTA: ' || b || ' → ' || n || (CASE WHEN -g > 0.2 THEN ' (FUERTE)' ELSE ' (DÉBIL)' END)
   ELSE 'CAMBIO DE FASE: ' || b || ' → ' || n END AS transition FROM tr0)"""


@query("w11_transitions", sql_result([o.market(), *score_sql("m_region"), *PHASE, MOVE], "tr", ["symbol", "dt", "transition"]))
def transitions(spark, d):
    return result(p.transitions(p.phases(b.market(spark, d))), ["symbol", "dt", "transition"])


def signal(z: str) -> str:
    return f"(2 * ((1 - {o.clip(z, 0, 2)} / 2) - 0.5))"


MACRO = [
    "mi AS (SELECT dt, 1 AS one, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {r}" for r, s in ROLES.items()) + ", any_value(vix) AS vix, any_value(bench) AS benchmark FROM m_region LEFT JOIN fear USING (dt) LEFT JOIN bench USING (dt) GROUP BY dt)",
    "mj AS (SELECT mi.*, breadth_signal, feat.vix_z, credit_up / nullif(credit_down, 0) AS credit, long_rate / 100 - short_rate / 100 AS curve, row_number() OVER (ORDER BY dt) AS rn FROM mi LEFT JOIN feat USING (dt))",
    o.robust("mj", "mk", "credit", "credit_z", 60, 20, 0.0, 5.0, key="one"),
    o.robust("mk", "ml", "curve", "curve_z", 120, 20, 0.0, 5.0, key="one"),
    o.robust("ml", "mn", "vix", "vix_rz", 60, 20, 0.0, 5.0, key="one"),
    f"mo AS (SELECT *, CASE WHEN count(vix) OVER {o.win(5, 'one')} >= 5 THEN regr_slope(vix, rn) OVER {o.win(5, 'one')} END AS vix_slope FROM mn)",
    f"mp AS (SELECT *, tanh(0.3 * {signal('credit_z')} + 0.3 * {signal('curve_z')} + 0.2 * (2 * (exp(-vix_rz) * (1 - tanh(vix_slope)) - 0.5)) + 0.2 * {o.clip('coalesce(breadth_signal, 0.0)', -1, 1)}) AS macro_score FROM mo)",
    "mac AS (SELECT *, CASE WHEN rn > 60 THEN macro_score END AS macro FROM mp)",
]
MACRO_BASE = [o.market(), pf.FLOW, *pf.FLOW_Z, o.bench(), o.FEAR, pf.REL, pf.FEAT, *MACRO]


def macro_of(spark, d):
    market, bench, vix = b.market(spark, d), b.benchmark(spark, d), b.fear(spark, d)
    return m.macro_inputs(market, vix, bench, ROLES), f.features_daily(market, bench, vix)


@query("w12_w13_macro_series", sql_result(MACRO_BASE, "mac", ["dt"], ["credit_z", "curve_z", "vix_rz", "vix_slope", "macro"]))
def macro_series(spark, d):
    return result(m.macro_series(*macro_of(spark, d)), ["dt"], ["credit_z", "curve_z", "vix_rz", "vix_slope", "macro"])


_TREND = f"5 * ({o.roll('avg({})', 'benchmark', 50, 50, 'one')} / nullif({o.roll('avg({})', 'benchmark', 200, 200, 'one')}, 0) - 1)"
REGIME = [
    f"rg0 AS (SELECT dt, 0.4 * {o.unit(_TREND)} + 0.2 * {o.clip('(breadth_signal + 0.5) / 1.5', 0, 1)} + 0.2 * {o.clip('exp(-vix_z) * (1 - tanh(vix_slope))', 0, 1)} + 0.2 * (1 - {o.clip('credit_z', 0, 2)} / 2) AS s FROM mac)",
    f"rg1 AS (SELECT dt, coalesce({o.clip('s', 0, 1)}, 0.5) AS regime_score FROM rg0)",
    "rg AS (SELECT *, CASE WHEN regime_score > 0.6 THEN 'EXPANSION' WHEN regime_score < 0.4 THEN 'CONTRACTION' ELSE 'TRANSITION' END AS regime FROM rg1)",
]


@query("w14_regime_score", sql_result([*MACRO_BASE, *REGIME], "rg", ["dt", "regime"], ["regime_score"]))
def regime_score(spark, d):
    return result(m.regime_score(*macro_of(spark, d)), ["dt", "regime"], ["regime_score"])


def orth(src: str, out: str, base: str, target: str, col: str) -> str:
    w = o.win(60)
    cov = f"(CASE WHEN count({base} + {target}) OVER {w} >= 60 THEN covar_samp({base}, {target}) OVER {w} END)"
    return f"{out} AS (SELECT *, {target} - {cov} / ({o.roll('var_samp({})', base, 60, 60)} + 1e-9) * {base} AS {col} FROM {src})"


def below(src: str, out: str, x: str, col: str) -> list[str]:
    """Share of the previous 119 rows strictly below, full window only; with its 70 % threshold."""
    return [
        f"{out}_n AS (SELECT *, row_number() OVER ({W}) AS k, count({x}) OVER {o.win(120)} AS have FROM {src})",
        f"{out}_j AS (SELECT t.symbol, t.k, count(*) FILTER (u.{x} < t.{x}) AS less FROM {out}_n t JOIN {out}_n u ON u.symbol = t.symbol AND u.k BETWEEN t.k - 119 AND t.k WHERE t.have = 120 GROUP BY 1, 2)",
        f"{out}_p AS (SELECT n.* EXCLUDE (k, have), (less / 119.0::DOUBLE - 0.5) * 2 AS {col} FROM {out}_n n LEFT JOIN {out}_j j ON n.symbol = j.symbol AND n.k = j.k)",
        f"{out} AS (SELECT *, {o.roll('quantile_cont({}, 0.7)', col, 120, 120)} AS {col}_p70 FROM {out}_p)",
    ]


ATTR = [
    f"at1 AS (SELECT *, {o.roll('avg({})', 'sign(flow)', 20, 20)} AS p0, {o.roll('avg({})', 'flow', 20, 20)} AS mu, {o.roll('stddev_samp({})', 'flow', 20, 20)} AS sd FROM flow)",
    f"at2 AS (SELECT *, mu / (sd + 1e-9) AS i0, {o.roll('avg({})', 'abs(flow - mu)', 20, 20)} / ({o.roll('avg({})', 'abs(flow)', 20, 20)} + 1e-9) AS r0 FROM at1)",
    o.robust("at2", "at3", "p0", "persistence", 60, 60, 1e-9),
    o.robust("at3", "at4", "i0", "intensity", 60, 60, 1e-9),
    o.robust("at4", "at5", "r0", "irregularity", 60, 60, 1e-9),
    orth("at5", "at6", "persistence", "intensity", "io"),
    orth("at6", "at7", "persistence", "irregularity", "ia"),
    orth("at7", "at8", "io", "ia", "iro"),
    *below("at8", "at9", "persistence", "persistence_orth"),
    *below("at9", "at10", "io", "intensity_orth"),
    *below("at10", "at11", "iro", "irregularity_orth"),
    """att AS (SELECT *, CASE WHEN persistence_orth > persistence_orth_p70 AND intensity_orth > intensity_orth_p70 THEN 'CONVICTION' WHEN irregularity_orth > irregularity_orth_p70 THEN 'MECHANICAL'
      WHEN intensity_orth > intensity_orth_p70 THEN 'PASSIVE' ELSE 'NEUTRAL' END AS flow_type FROM at11)""",
]
# ranks among neighbours hang on the last bits of nearly equal residuals, so these go out with the z-scores they rank
ATTRIBUTION = (["symbol", "dt"], ["persistence", "intensity", "irregularity", "persistence_orth"])


@query("r16_r19_flow_attribution", sql_result([o.market(), pf.FLOW, *ATTR], "att", ["symbol", "dt", "flow_type"], [*ATTRIBUTION[1], "intensity_orth", "irregularity_orth", "persistence_orth_p70", "intensity_orth_p70", "irregularity_orth_p70"]))
def attribution(spark, d):
    return result(c.flow_attribution(b.market(spark, d)), ["symbol", "dt", "flow_type"], [*ATTRIBUTION[1], "intensity_orth", "irregularity_orth", "persistence_orth_p70", "intensity_orth_p70", "irregularity_orth_p70"])


COMPOSITE = [
    "cf1 AS (SELECT *, 0.5 * persistence_orth + 0.3 * intensity_orth - 0.2 * irregularity_orth AS signal FROM att)",
    f"cf2 AS (SELECT *, signal - lag(signal, 3) OVER ({W}) AS d1 FROM cf1)",
    f"cf3 AS (SELECT *, d1 - lag(d1, 3) OVER ({W}) AS d2 FROM cf2)",
    o.ewm("cf3", "cf4", "d2", "flow_momentum", decay_of(span=5)),
    f"cf AS (SELECT *, {o.clip('1 - ' + o.roll('stddev_samp({})', 'signal', 5, 5), 0, 1)} AS flow_stability FROM cf4)",
]


@query("r15_r23_composite_flow", sql_result([o.market(), pf.FLOW, *ATTR, *COMPOSITE], "cf", ["symbol", "dt"], ["signal", "flow_momentum", "flow_stability"]))
def composite(spark, d):
    return result(c.composite_flow(c.flow_attribution(b.market(spark, d))), ["symbol", "dt"], ["signal", "flow_momentum", "flow_stability"])


def residual_sql(src: str, out: str, x: str, y: str, col: str, n: int) -> list[str]:
    return [
        f"{out}_n AS (SELECT *, row_number() OVER ({W}) AS k FROM {src})",
        f"{out}_p AS (SELECT t.symbol, t.k, u.{x} AS x, u.{y} AS y, median(u.{y}) OVER (PARTITION BY t.symbol, t.k) AS med FROM {out}_n t JOIN {out}_n u ON u.symbol = t.symbol AND u.k BETWEEN t.k - {n} AND t.k - 1 WHERE u.{x} IS NOT NULL AND u.{y} IS NOT NULL AND t.k > {n})",
        f"{out}_w AS (SELECT *, 1 / (1 + abs(y - med)) AS w FROM {out}_p)",
        f"{out}_s AS (SELECT symbol, k, count(*) AS n, stddev_pop(x) AS sx0, avg(y) AS my, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM {out}_w GROUP BY 1, 2)",
        f"{out}_b AS (SELECT *, (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) AS slope FROM {out}_s)",
        f"{out} AS (SELECT a.* EXCLUDE (k), CASE WHEN n < 2 OR n IS NULL THEN NULL WHEN sx0 < 1e-9 THEN a.{y} - my ELSE a.{y} - ((sy - slope * sx) / sw + slope * a.{x}) END AS {col} FROM {out}_n a LEFT JOIN {out}_b b ON a.symbol = b.symbol AND a.k = b.k)",
    ]


def decay_sql(src: str, out: str, x: str, col: str) -> list[str]:
    return [
        f"{out}_f AS (SELECT symbol, dt, {x} FROM {src} WHERE {x} IS NOT NULL)",
        o.ewm(f"{out}_f", f"{out}_g", x, "smooth__", decay_of(halflife=5), adjust=False),
        f"{out} AS (SELECT s.*, CASE WHEN count(s.{x}) OVER (PARTITION BY symbol) >= 5 THEN last_value(smooth__ IGNORE NULLS) OVER {o.win(None)} ELSE s.{x} END AS {col} FROM {src} s LEFT JOIN (SELECT symbol, dt, smooth__ FROM {out}_g) g USING (symbol, dt))",
    ]


CHAIN = [
    f"""ch0 AS (SELECT cf.symbol, cf.dt, cf.signal, mac.macro, ph.structure, CASE WHEN mac.macro - lag(mac.macro, 5) OVER w > 0.2 AND cf.signal - lag(cf.signal, 5) OVER w > 0.2 THEN 1
      WHEN mac.macro - lag(mac.macro, 5) OVER w < -0.2 AND cf.signal - lag(cf.signal, 5) OVER w < -0.2 THEN -1 ELSE 0 END AS transition
      FROM cf JOIN mac USING (dt) JOIN ph ON ph.symbol = cf.symbol AND ph.dt = cf.dt WINDOW w AS (PARTITION BY cf.symbol ORDER BY cf.dt))""",
    "ch1 AS (SELECT symbol, dt, macro, signal FROM ch0 WHERE macro IS NOT NULL AND signal IS NOT NULL)",
    o.robust("ch1", "ch2", "macro", "macro_z", 60, 60, 1e-9),
    o.robust("ch2", "ch3", "signal", "flow_z", 60, 60, 1e-9),
    "ch4 AS (SELECT * FROM ch3 WHERE macro_z IS NOT NULL AND flow_z IS NOT NULL)",
    *residual_sql("ch4", "ch5", "macro_z", "flow_z", "flow_orthogonal", 60),
    "ch6 AS (SELECT ch0.*, macro_z, flow_z, flow_orthogonal FROM ch0 LEFT JOIN (SELECT symbol, dt, macro_z, flow_z, flow_orthogonal FROM ch5) USING (symbol, dt))",
    *decay_sql("ch6", "ch7", "macro", "macro_smooth"),
    *decay_sql("ch7", "ch8", "flow_orthogonal", "flow_smooth"),
    "ch9 AS (SELECT *, (CASE structure WHEN 'MARKUP' THEN 1 WHEN 'DISTRIBUTION' THEN -1 ELSE 0 END)::DOUBLE AS sv, tanh(flow_smooth) AS fs, tanh(macro_smooth) AS ms FROM ch8)",
    "ch10 AS (SELECT *, 2 * sv - 1 AS ss, (fs + ms + 2 * sv - 1) / 3 AS mu FROM ch9)",
    f"ch11 AS (SELECT *, {o.clip('(0.5 * fs + 0.3 * ms + 0.2 * ss) * (1 - sqrt(((fs - mu) * (fs - mu) + (ms - mu) * (ms - mu) + (ss - mu) * (ss - mu)) / 3))', -1, 1)} AS edge, {o.clip('(0.5 * abs(macro_smooth) + 0.5 * abs(flow_smooth)) * (ms * fs + 1) / 2 * (CASE WHEN sv = 0 THEN 0.5 ELSE 1.0 END)', 0, 1)} AS truth, (1 + (sign(flow_smooth) = sign(macro_smooth))::INT + (sign(sv) = sign(macro_smooth))::INT) / 3.0::DOUBLE AS alignment FROM ch10 WHERE flow_smooth IS NOT NULL AND macro_smooth IS NOT NULL)",
    "ch AS (SELECT *, sv <> 0 AND NOT truth < 0.5 AND NOT abs(edge) < 0.3 AS tradeable FROM ch11)",
]
CHAIN_OUT = (["symbol", "dt", "transition", "tradeable"], ["macro_z", "flow_z", "flow_orthogonal", "macro_smooth", "flow_smooth", "edge", "truth", "alignment"])


@query("r20_r22_p2_p5_causal_chain", sql_result([*MACRO_BASE, *ATTR, *COMPOSITE, *score_sql("m_region"), *PHASE, *CHAIN], "ch", *CHAIN_OUT))
def causal(spark, d):
    market = b.market(spark, d)
    chain = c.causal_chain(c.composite_flow(c.flow_attribution(market)), m.macro_series(*macro_of(spark, d)), p.phases(market))
    args = [F.col(x) for x in ("macro_smooth", "flow_smooth", "structure_value")]
    chain = chain.filter("flow_smooth is not null and macro_smooth is not null").withColumn("edge", lad.edge(*args)).withColumn("truth", lad.truth(*args)).withColumn("alignment", lad.alignment(*args))
    return result(chain.withColumn("tradeable", lad.tradeable(F.col("edge"), F.col("truth"), F.col("structure_value"))), *CHAIN_OUT)


@query("p01_adaptive_window", sql_result([*MACRO_BASE, f"aw AS (SELECT dt, trunc({o.clip('60 * (1 - 0.25 * ' + o.clip('vix_z', -2, 2) + ')', 30, 90)})::INT AS win FROM feat)"], "aw", ["dt", "win"]))
def window(spark, d):
    return macro_of(spark, d)[1].select("dt", lad.adaptive_window(F.col("vix_z")).alias("win"))


@query("p24_macro_label", sql_result([*MACRO_BASE, "mlb AS (SELECT dt, CASE WHEN macro > 0.5 THEN 'RISK-ON' WHEN macro < -0.5 THEN 'RISK-OFF' ELSE 'NEUTRAL' END AS label FROM mac)"], "mlb", ["dt", "label"]))
def macro_label(spark, d):
    return m.macro_series(*macro_of(spark, d)).select("dt", lad.macro_label(F.col("macro")).alias("label"))
