"""Queries of stock metrics, leadership and forward validation (weekly bars of brands within part types)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.primitives import decay_of, ordered
from ..operators import bars as b
from ..operators import leaders as ld
from . import oracle as o
from .output import result, sql_result
from .patterns import PHASE, score_sql

QUERIES, ORACLES = {}, {}
W = "PARTITION BY symbol ORDER BY dt"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


STOCKS = o.market("stock", "week")
SECTORS = o.bars("sector", "week")


def stocks(spark, d):
    return b.market(spark, d, "stock", "week")


def sectors(spark, d):
    return b.weekly_bars(b.daily_bars(b.trades(spark, d, "sector")))


def holdings(spark, d):
    return b.trades(spark, d, "stock").select("symbol").distinct().withColumn("sector", F.substring_index("symbol", "|", 1))


@query("r24_rsi", sql_result([STOCKS, f"rs0 AS (SELECT *, close - lag(close) OVER ({W}) AS dd FROM m_stock)", o.ewm("rs0", "rs1", "CASE WHEN dd IS NOT NULL THEN greatest(dd, 0) END", "ag", decay_of(alpha=1 / 14), 14), o.ewm("rs1", "rs2", "CASE WHEN dd IS NOT NULL THEN -least(dd, 0) END", "al", decay_of(alpha=1 / 14), 14), "rs AS (SELECT symbol, dt, 100 - 100 / (1 + ag / (al + 1e-9)) AS rsi FROM rs2)"], "rs", ["symbol", "dt"], ["rsi"]))
def rsi(spark, d):
    return result(ld.rsi(stocks(spark, d)), ["symbol", "dt"], ["rsi"])


SERIES = [
    "sr0 AS (SELECT m.*, split_part(m.symbol, '|', 1) AS sector, s.close AS sector_close FROM m_stock m LEFT JOIN bars_sector s ON s.symbol = split_part(m.symbol, '|', 1) AND s.dt = m.dt)",
    "sr1 AS (SELECT *, close / nullif(sector_close, 0) AS rs, ret * dollar_vol AS flow FROM sr0)",
    o.robust("sr1", "sr2", "flow", "fz", 60, 60, 1e-9),
    o.ewm("sr2", "sr3", "fz", "flow_z", decay_of(span=5)),
    f"""sr4 AS (SELECT *, ln(rs) - lag(ln(rs), 20) OVER ({W}) AS rs_mom, coalesce({o.roll('sum({})', '(CASE WHEN fz > 0 THEN 1 ELSE 0 END)', 10, 10)}, 0) AS persistence_10d,
      (CASE WHEN close > 1.15 * {o.roll('avg({})', 'close', 20, 20)} THEN 1 ELSE 0 END)::INT AS extended, (CASE WHEN volume > 2 * {o.roll('avg({})', 'volume', 20, 20)} THEN 1 ELSE 0 END)::INT AS climax FROM sr3)""",
    *score_sql("m_stock"),
    *PHASE,
    f"sh AS (SELECT symbol, dt, score AS pattern_score, phase AS pattern_phase, {o.roll('avg({})', 'score', 10, 10)} / ({o.roll('stddev_samp({})', 'score', 10, 10)} + 1e-9) * tanh({o.roll('avg({})', 'score', 10, 10)}) AS stability FROM ph)",
    "sr5 AS (SELECT sr4.*, pattern_score, pattern_phase, stability FROM sr4 LEFT JOIN sh USING (symbol, dt))",
    f"ser AS (SELECT *, {o.roll('sum({})', '(CASE WHEN greatest(fz * pattern_score, CASE WHEN fz * pattern_score IS NULL THEN NULL ELSE 0.0 END) > 0.25 THEN 1 ELSE 0 END)', 5, 5)} AS pattern_persistence FROM sr5)",
    "met AS (SELECT *, tanh(flow_z) AS flow_tanh FROM ser WHERE dt = (SELECT max(dt) FROM ser) AND rs_mom IS NOT NULL AND flow_z IS NOT NULL)",
]
METRICS = (["symbol", "sector", "dt", "pattern_phase", "extended", "climax"], ["rs", "rs_mom", "flow_tanh", "pattern_score", "stability", "persistence_10d", "pattern_persistence"])


def series(spark, d):
    return ld.stock_series(stocks(spark, d), sectors(spark, d), holdings(spark, d))


@query("a15_r25_r28_j6_stock_metrics", sql_result([STOCKS, SECTORS, *SERIES], "met", *METRICS))
def metrics(spark, d):
    # a flat stock's flow_z is 0 / 1e-9 large; its tanh is what six digits can hold
    return result(ld.stock_metrics(series(spark, d)).withColumn("flow_tanh", F.tanh("flow_z")), *METRICS)


def lead_sql(src: str, group: str) -> list[str]:
    p = f"OVER (PARTITION BY {group})"
    return [
        f"le1 AS (SELECT *, median(rs_mom) {p} AS m1, median(flow_z) {p} AS m2, CASE WHEN count(pattern_score) {p} = count(*) {p} THEN pattern_score / (quantile_cont(pattern_score, 0.7) {p} + 1e-9) END AS rws, median(stability) {p} AS m4 FROM {src})",
        f"le2 AS (SELECT *, median(abs(rs_mom - m1)) {p} AS a1, median(abs(flow_z - m2)) {p} AS a2, median(rws) {p} AS m3, median(abs(stability - m4)) {p} AS a4, rank() OVER (PARTITION BY {group} ORDER BY rs_mom) + (count(*) OVER (PARTITION BY {group}, rs_mom) - 1) / 2.0::DOUBLE AS r1, rank() OVER (PARTITION BY {group} ORDER BY flow_z) + (count(*) OVER (PARTITION BY {group}, flow_z) - 1) / 2.0::DOUBLE AS r2 FROM le1)",
        f"le3 AS (SELECT *, median(abs(rws - m3)) {p} AS a3, CASE WHEN count(*) {p} >= 5 THEN corr(r1, r2) {p} END AS rho FROM le2)",
        f"""le AS (SELECT *, {o.clip('(rs_mom - m1) / (greatest(a1, 0.001) + 1e-9)', -3, 3)} AS rs_z, {o.clip('(flow_z - m2) / (greatest(a2, 0.001) + 1e-9)', -3, 3)} AS flow_n, {o.clip('(rws - m3) / (1.4826 * a3 + 1e-9)', -3, 3)} AS rws_z, {o.clip('(stability - m4) / (1.4826 * a4 + 1e-9)', -3, 3)} AS stab_z FROM le3)""",
        "lw AS (SELECT *, 0.35 * rs_z + 0.30 * (CASE WHEN rho > 0.7 THEN 1 - least(1.0, (rho - 0.7) / 0.3) ELSE 1.0 END) * flow_n + 0.25 * rws_z + 0.10 * stab_z AS wls FROM le)",
    ]


TOP = "lt AS (SELECT *, (rank() OVER (PARTITION BY sector ORDER BY wls) + (count(*) OVER (PARTITION BY sector, wls) - 1) / 2.0::DOUBLE) / count(wls) OVER (PARTITION BY sector) AS sector_rank_pct, row_number() OVER (PARTITION BY sector ORDER BY wls DESC NULLS LAST, symbol)::INT AS place FROM lw)"
LEADERS = (["symbol", "sector", "place"], ["rs_z", "flow_n", "rws_z", "stab_z", "rho", "wls", "sector_rank_pct"])


@query("a14_a16_a27_leaders", sql_result([STOCKS, SECTORS, *SERIES, *lead_sql("met", "sector"), TOP, "l3 AS (SELECT * FROM lt WHERE place <= 3)"], "l3", *LEADERS))
def leaders(spark, d):
    return result(ld.leaders(ld.leadership(ld.stock_metrics(series(spark, d)), ["sector"]), ["sector"]), *LEADERS)


# the log that validation reads: momentum over 8 weeks as the score, every week that has it, per type and brand
LOG = [
    f"lo0 AS (SELECT symbol, split_part(symbol, '|', 1) AS sector, dt, close / nullif(lag(close, 8) OVER ({W}), 0) - 1 AS wls FROM m_stock)",
    "lo AS (SELECT symbol, sector, dt, wls FROM lo0 WHERE wls IS NOT NULL)",
]


def log(spark, d):
    df = stocks(spark, d).select("symbol", F.substring_index("symbol", "|", 1).alias("sector"), "dt", (F.col("close") / F.nullif(F.lag("close", 8).over(ordered()), F.lit(0.0)) - 1).alias("wls"))
    return df.filter("wls is not null")


def fwd(src: str, out: str, h: int, col: str) -> str:
    return f"{out} AS (SELECT symbol, dt, lead(close, {h}) OVER ({W}) / nullif(close, 0) - 1 AS {col} FROM {src} WHERE close IS NOT NULL)"


@query("a20_j10_forward_returns", sql_result([STOCKS, fwd("m_stock", "fw", 5, "ret_fwd")], "fw", ["symbol", "dt"], ["ret_fwd"]))
def forward(spark, d):
    return result(ld.forward_returns(stocks(spark, d), 5), ["symbol", "dt"], ["ret_fwd"])


HORIZONS = (5, 20, 60)


def evaluate_sql(extra: str) -> list[str]:
    first = f"{extra}, " if extra else ""
    group = f"GROUP BY {extra}" if extra else ""
    out = [
        f"ev0 AS (SELECT *, row_number() OVER (PARTITION BY {first}dt, sector ORDER BY wls DESC NULLS LAST, symbol) AS place FROM lb)",
    ]
    for h in HORIZONS:
        out += [
            fwd("m_stock", f"f1_{h}", h, "ret_fwd"),
            fwd("bars_sector", f"f2_{h}", h, "ret_etf"),
            f"ev1_{h} AS (SELECT ev0.*, ret_fwd, ret_etf, ret_fwd - ret_etf AS rel FROM ev0 LEFT JOIN f1_{h} USING (symbol, dt) LEFT JOIN f2_{h} f2 ON f2.symbol = ev0.sector AND f2.dt = ev0.dt WHERE place <= 3 AND ret_fwd IS NOT NULL)",
            f"ev_{h} AS (SELECT {first}{h}::INT AS horizon, count(*)::BIGINT AS observations, avg(CASE WHEN ret_fwd > 0 THEN 1 ELSE 0 END) AS hit_rate, CASE WHEN count(rel) > 0 THEN avg(CASE WHEN rel > 0 THEN 1 ELSE 0 END) END AS hit_rate_relative, avg(rel) AS alpha, avg(ret_fwd) AS mean_return, avg(ret_etf) AS mean_etf_return FROM ev1_{h} {group})",
        ]
    return [*out, "ev AS (" + " UNION ALL ".join(f"SELECT * FROM ev_{h}" for h in HORIZONS) + ")"]


def evaluated(spark, d, logged, extra=()):
    """A row (a bucket) for each horizon."""
    each = [ld.evaluate(logged, stocks(spark, d), sectors(spark, d), h, extra).withColumn("horizon", F.lit(h)) for h in HORIZONS]
    return result(reduce(DataFrame.unionByName, each), [*extra, "horizon", "observations"], EVAL)


CAPS = "cap AS (SELECT symbol, CASE WHEN max(volume) IS NULL THEN 'Unknown' WHEN max(volume) * 100 > 50000 THEN 'Large' WHEN max(volume) * 100 > 10000 THEN 'Mid' ELSE 'Small' END AS bucket FROM bars_stock GROUP BY symbol)"
EVAL = ["hit_rate", "hit_rate_relative", "alpha", "mean_return", "mean_etf_return"]


@query("a21_evaluate_horizon", sql_result([STOCKS, SECTORS, *LOG, "lb AS (SELECT * FROM lo)", *evaluate_sql("")], "ev", ["horizon", "observations"], EVAL))
def evaluate(spark, d):
    return evaluated(spark, d, log(spark, d))


@query("a22_p37_j8_evaluate_buckets", sql_result([STOCKS, SECTORS, *LOG, CAPS, "lb AS (SELECT lo.*, bucket FROM lo JOIN cap USING (symbol))", *evaluate_sql("bucket")], "ev", ["bucket", "horizon", "observations"], EVAL))
def evaluate_buckets(spark, d):
    bars = b.weekly_bars(b.daily_bars(b.trades(spark, d, "stock")))
    caps = ld.buckets(bars.groupBy("symbol").agg((F.max("volume") * 100).alias("cap_musd")))
    return evaluated(spark, d, log(spark, d).join(caps, "symbol"), ("bucket",))


TURN = [
    "to0 AS (SELECT sector, dt, symbol FROM (SELECT *, row_number() OVER (PARTITION BY dt, sector ORDER BY wls DESC NULLS LAST, symbol) AS place FROM lo) WHERE place <= 3)",
    "to1 AS (SELECT sector, dt, lag(dt) OVER (PARTITION BY sector ORDER BY dt) AS before FROM (SELECT DISTINCT sector, dt FROM to0))",
    "to2 AS (SELECT d.sector, d.dt, count(*) AS n, count(p.symbol) AS same FROM to1 d JOIN to0 t ON t.sector = d.sector AND t.dt = d.dt LEFT JOIN to0 p ON p.sector = d.sector AND p.dt = d.before AND p.symbol = t.symbol WHERE d.before IS NOT NULL GROUP BY 1, 2)",
    "tu AS (SELECT avg(1 - same / n::DOUBLE) AS turnover FROM to2)",
]


@query("a23_j9_turnover", sql_result([STOCKS, *LOG, *TURN], "tu", [], ["turnover"]))
def turnover(spark, d):
    return result(ld.turnover(log(spark, d)), [], ["turnover"])


PERSIST = [
    "rp0 AS (SELECT sector, dt, lead(dt) OVER (PARTITION BY sector ORDER BY dt) AS nxt FROM (SELECT DISTINCT sector, dt FROM lo))",
    "rp1 AS (SELECT x.sector, x.dt, x.symbol, x.wls AS a, y.wls AS b FROM rp0 JOIN lo x ON x.sector = rp0.sector AND x.dt = rp0.dt JOIN lo y ON y.sector = rp0.sector AND y.dt = rp0.nxt AND y.symbol = x.symbol)",
    "rp2 AS (SELECT *, rank() OVER (PARTITION BY sector, dt ORDER BY a) + (count(*) OVER (PARTITION BY sector, dt, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY sector, dt ORDER BY b) + (count(*) OVER (PARTITION BY sector, dt, b) - 1) / 2.0::DOUBLE AS rb FROM rp1)",
    "rp AS (SELECT avg(rho) AS rank_persistence FROM (SELECT corr(ra, rb) AS rho FROM rp2 GROUP BY sector, dt HAVING count(*) >= 3))",
]


@query("a24_rank_persistence", sql_result([STOCKS, *LOG, *PERSIST], "rp", [], ["rank_persistence"]))
def rank_persistence(spark, d):
    return result(ld.rank_persistence(log(spark, d)), [], ["rank_persistence"])


SIGNAL = [
    f"es0 AS (SELECT symbol, dt, (tanh(ret) + 1) / 2 AS p, lead(close, 5) OVER ({W}) / nullif(close, 0) - 1 AS fr FROM m_stock)",
    f"es1 AS (SELECT *, coalesce(lag(p) OVER ({W}) > 0.7, false) AS hot FROM es0)",
    "es AS (SELECT symbol, count(*) FILTER (hot)::BIGINT AS n_signals, avg(fr) FILTER (hot) - avg(fr) AS alpha, avg(CASE WHEN fr > 0 THEN 1 ELSE 0 END) FILTER (hot) AS hit_ratio, CASE WHEN count(*) FILTER (hot) = 0 THEN 'No hubo señales con probabilidad > 0.7 en el periodo analizado.' END AS message FROM es1 GROUP BY symbol)",
]


@query("a18_a19_evaluate_signal", sql_result([STOCKS, *SIGNAL], "es", ["symbol", "n_signals", "message"], ["alpha", "hit_ratio"]))
def evaluate_signal(spark, d):
    df = stocks(spark, d).withColumn("p", (F.tanh("ret") + 1) / 2).withColumn("fr", F.lead("close", 5).over(ordered()) / F.nullif(F.col("close"), F.lit(0.0)) - 1)
    return result(ld.evaluate_signal(df, "p", "fr"), ["symbol", "n_signals", "message"], ["alpha", "hit_ratio"])
