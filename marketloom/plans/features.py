"""Queries of the price and flow features."""

from __future__ import annotations

from ..functions.primitives import decay_of
from ..operators import bars as b
from ..operators import features as f
from . import oracle as o
from .output import result, sql_result

FLOW = "flow AS (SELECT *, ret * dollar_vol AS flow FROM m_region)"
FLOW_Z = [o.robust("flow", "fz", "flow", "flow_z", 60, 20, 0.0, 5.0), o.ewm("fz", "fm0", "flow_z", "flow_mom0", decay_of(span=10), 20), "fm AS (SELECT * EXCLUDE (flow_mom0), CASE WHEN count(volume) OVER (PARTITION BY symbol) = 0 THEN 0.0 ELSE flow_mom0 END AS flow_mom FROM fm0)"]
RADAR = """last AS (SELECT symbol, dt, flow_mom FROM fm WHERE dt = (SELECT max(dt) FROM fm)),
 cr AS (SELECT stddev_samp(flow_mom) AS flow_dispersion, avg(CASE WHEN flow_mom > 0 THEN 1 ELSE 0 END) AS flow_breadth FROM last),
 rad AS (SELECT *, row_number() OVER (ORDER BY flow_mom DESC NULLS LAST, symbol)::INT AS rank,
   CASE WHEN flow_breadth > 0.6 THEN 'ENTRADA GENERALIZADA (riesgo-on)' WHEN flow_dispersion > 0.5 THEN 'ROTACION FUERTE (flujos dispersos)' ELSE 'FLUJO SELECTIVO' END AS regime FROM last, cr)"""
REL = "rel AS (SELECT fm.*, bench, close / nullif(bench, 0) AS rel FROM fm LEFT JOIN bench USING (dt))"
ACT = f"""act0 AS (SELECT *, {o.zs('dollar_vol_smoothed', 20, 20)} AS vol_z, {o.zs('rel', 60, 20)} AS price_z, flow_mom - {o.roll('avg({})', 'flow_mom', 5, 5)} AS flow_acc FROM rel),
 act AS (SELECT *, {o.zs('flow_acc', 20, 10, 1e-9)} AS acc_z FROM act0)"""
MOM = """mom0 AS (SELECT symbol, dt, rel / nullif(lag(rel, 20) OVER (PARTITION BY symbol ORDER BY dt), 0) - 1 AS momentum FROM rel),
 mom AS (SELECT *, row_number() OVER (ORDER BY momentum DESC NULLS LAST, symbol)::INT AS rank FROM mom0 WHERE dt = (SELECT max(dt) FROM mom0))"""
FEAT = f"""br0 AS (SELECT dt, symbol, CASE WHEN close > {o.roll('avg({})', 'close', 100, 100)} THEN 1 ELSE 0 END AS above FROM m_region),
 br AS (SELECT dt, -sum((above - 0.5::DOUBLE) / (SELECT count(DISTINCT symbol) FROM m_region)) AS breadth_signal FROM br0 GROUP BY dt),
 lr AS (SELECT dt, ln(rel) - lag(ln(rel), 20) OVER (PARTITION BY symbol ORDER BY dt) AS mom FROM rel),
 sp AS (SELECT dt, CASE WHEN count(mom) >= 2 THEN stddev_samp(mom) END AS sector_dispersion FROM lr GROUP BY dt),
 vz AS (SELECT dt, {o.zs('vix', 100, 100, key='')} AS vix_z FROM fear),
 feat AS (SELECT dt, breadth_signal, sector_dispersion, vix_z, (CASE WHEN vix_z > 1.5 THEN 1 ELSE 0 END)::INT AS stress FROM br JOIN sp USING (dt) JOIN vz USING (dt) WHERE sector_dispersion IS NOT NULL AND vix_z IS NOT NULL)"""
REGIME = """CASE WHEN stress = 1 OR vix_z > 1.5 THEN 'RISK OFF (estres alto)' WHEN breadth_signal > 0.2 AND sector_dispersion < 0.02 THEN 'TREND STRONG (seguir lider)'
 WHEN breadth_signal < -0.2 AND sector_dispersion > 0.03 THEN 'ROTATION ACTIVE (cambio de lider)' WHEN breadth_signal > 0 THEN 'EXPANSION (rotacion moderada)' ELSE 'NEUTRAL' END"""
ACTION = """CASE WHEN stress = 1 OR vix_z > 1.5 THEN 'Reducir exposicion a ciclicos, aumentar defensivos o efectivo.' WHEN breadth_signal > 0.2 AND sector_dispersion < 0.02 THEN 'Mantener exposicion en el sector lider.'
 WHEN breadth_signal < -0.2 AND sector_dispersion > 0.03 THEN 'Rotacion activa. Esperar nuevo lider.' WHEN breadth_signal > 0 THEN 'Entorno favorable para ciclicos. Seguir rotacion.' ELSE 'Sin senal clara. Esperar.' END"""
BASE = [o.market(), FLOW, *FLOW_Z]

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


FRAME = ["open", "high", "low", "close", "volume", "dollar_vol", "dollar_vol_smoothed", "ret"]


@query("s3_j1_j2_r45_market_frame", sql_result([o.market()], "m_region", ["symbol", "dt"], FRAME))
def market_frame(spark, d):
    return result(b.market(spark, d), ["symbol", "dt"], FRAME)


@query("s3_stock_bars_weekly", sql_result([o.bars("stock", "week")], "bars_stock", ["symbol", "dt"], FRAME[:5]))
def stock_bars(spark, d):
    return result(b.weekly_bars(b.daily_bars(b.trades(spark, d, "stock"))), ["symbol", "dt"], FRAME[:5])


VARIANTS = ["z_features", "z_options", "z_stock", "z_tanh"]


@query("r01_r05_robust_z", sql_result([o.market(), FLOW, o.robust("flow", "v1", "flow", "z_features", 60, 20, 0.0, 5.0), o.robust("v1", "v2", "flow", "z_options", 60, 60, 1e-9, 5.0), o.robust("v2", "v3", "flow", "z_stock", 60, 60, 1e-9), "v4 AS (SELECT *, tanh(z_options) AS z_tanh FROM v3)"], "v4", ["symbol", "dt"], VARIANTS))
def robust(spark, d):
    return result(f.robust_variants(b.market(spark, d)), ["symbol", "dt"], VARIANTS)


@query("r13_flow_momentum_series", sql_result(BASE, "fm", ["symbol", "dt"], ["flow_z", "flow_mom"]))
def flow_series(spark, d):
    return result(f.flow_momentum(b.market(spark, d)), ["symbol", "dt"], ["flow_z", "flow_mom"])


RADAR_OUT = (["symbol", "dt", "rank", "regime"], ["flow_mom", "flow_dispersion", "flow_breadth"])


@query("r13_a2_a3_flow_radar", sql_result([*BASE, RADAR], "rad", *RADAR_OUT))
def flow_radar(spark, d):
    return result(f.flow_radar(b.market(spark, d)), *RADAR_OUT)


@query("r13_flow_radar_weekly", sql_result([o.market("region", "week"), *BASE[1:], RADAR], "rad", *RADAR_OUT))
def flow_radar_weekly(spark, d):
    return result(f.flow_radar(b.market(spark, d, grain="week")), *RADAR_OUT)


ACTIVITY = ["vol_z", "price_z", "flow_acc", "acc_z"]


@query("r06_r09_j5_activity", sql_result([*BASE, o.bench(), REL, ACT], "act", ["symbol", "dt"], ACTIVITY))
def activity(spark, d):
    return result(f.activity(b.market(spark, d), b.benchmark(spark, d)), ["symbol", "dt"], ACTIVITY)


FEATURES = (["dt", "stress"], ["breadth_signal", "sector_dispersion", "vix_z"])


@query("r10_r11_features_daily", sql_result([*BASE, o.bench(), o.FEAR, REL, FEAT], "feat", *FEATURES))
def features_daily(spark, d):
    return result(f.features_daily(b.market(spark, d), b.benchmark(spark, d), b.fear(spark, d)), *FEATURES)


@query("r12_a1_price_momentum", sql_result([*BASE, o.bench(), REL, MOM], "mom", ["symbol", "dt", "rank"], ["momentum"]))
def price_momentum(spark, d):
    return result(f.price_momentum(b.market(spark, d), b.benchmark(spark, d)), ["symbol", "dt", "rank"], ["momentum"])


RADAR14 = (["symbol", "rank", "regime", "action"], ["momentum", "breadth_signal", "sector_dispersion", "vix_z"])


@query("r14_p25_radar", sql_result([*BASE, o.bench(), o.FEAR, REL, MOM, FEAT, f"r14 AS (SELECT symbol, rank, momentum, feat.* EXCLUDE (dt), {REGIME} AS regime, {ACTION} AS action FROM mom, feat WHERE feat.dt = (SELECT max(dt) FROM feat))"], "r14", *RADAR14))
def radar(spark, d):
    return result(f.radar(b.market(spark, d), b.benchmark(spark, d), b.fear(spark, d)), *RADAR14)


@query(
    "p40_cross_alerts",
    sql_result([*BASE, RADAR, o.bench(), REL, MOM, """al AS (SELECT mom.symbol, mom.rank AS price_rank, rad.rank AS flow_rank, (SELECT count(*) FROM mom) AS n FROM mom JOIN rad USING (symbol)),
 al2 AS (SELECT *, CASE WHEN price_rank <= 2 AND flow_rank > n - 2 THEN 'RED' WHEN price_rank > n - 2 AND flow_rank <= 2 THEN 'GREEN' END AS alert FROM al)"""], "al2", ["symbol", "price_rank", "flow_rank", "alert"]),
)
def cross_alerts(spark, d):
    market = b.market(spark, d)
    return result(f.cross_alerts(f.price_momentum(market, b.benchmark(spark, d)), f.flow_radar(market)), ["symbol", "price_rank", "flow_rank", "alert"])


RANKVOL = """rv0 AS (SELECT symbol, dt, flow_mom FROM fm WHERE dt IN (SELECT DISTINCT dt FROM fm ORDER BY dt DESC LIMIT 5)),
 rv1 AS (SELECT symbol, dt, rank() OVER (PARTITION BY dt ORDER BY flow_mom DESC) + (count(*) OVER (PARTITION BY dt, flow_mom) - 1) / 2.0::DOUBLE AS r FROM rv0 WHERE flow_mom IS NOT NULL),
 rv2 AS (SELECT dt, abs(r - lag(r) OVER (PARTITION BY symbol ORDER BY dt)) AS step FROM rv1),
 rv3 AS (SELECT dt, avg(step) AS step FROM rv2 WHERE step IS NOT NULL GROUP BY dt),
 rv AS (SELECT avg(step) / (SELECT count(DISTINCT symbol) FROM rv0) AS ranking_volatility FROM rv3)"""


@query("r46_ranking_volatility", sql_result([*BASE, RANKVOL], "rv", [], ["ranking_volatility"]))
def ranking_volatility(spark, d):
    return result(f.ranking_volatility(f.flow_momentum(b.market(spark, d))), [], ["ranking_volatility"])


CORR = """mc0 AS (SELECT dt, symbol, ret FROM m_region WHERE ret IS NOT NULL AND dt IN (SELECT DISTINCT dt FROM m_region ORDER BY dt DESC LIMIT 60)),
 mc1 AS (SELECT corr(a.ret, b.ret) AS c FROM mc0 a JOIN mc0 b ON a.dt = b.dt AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol),
 mc AS (SELECT avg(c) AS mean_correlation, (CASE WHEN avg(c) > 0.7 THEN 1 ELSE 0 END)::INT AS high FROM mc1)"""


@query("a17_mean_correlation", sql_result([o.market(), CORR], "mc", ["high"], ["mean_correlation"]))
def mean_correlation(spark, d):
    return result(f.mean_correlation(b.market(spark, d)), ["high"], ["mean_correlation"])


DISP = """dh0 AS (SELECT dt, CASE WHEN count(flow_mom) >= 2 THEN stddev_samp(flow_mom) END AS dispersion FROM fm GROUP BY dt),
 dh1 AS (SELECT * FROM dh0 WHERE dispersion IS NOT NULL ORDER BY dt DESC LIMIT 60),
 dh AS (SELECT *, (SELECT quantile_cont(dispersion, 0.7) FROM dh1) AS high_line, (SELECT quantile_cont(dispersion, 0.3) FROM dh1) AS low_line FROM dh1)"""


@query("s20_dispersion_history", sql_result([*BASE, DISP], "dh", ["dt"], ["dispersion", "high_line", "low_line"]))
def dispersion_history(spark, d):
    return result(f.dispersion_history(f.flow_momentum(b.market(spark, d))), ["dt"], ["dispersion", "high_line", "low_line"])
