"""Building blocks of the DuckDB checks: chains of CTEs over the same tables.  Written apart from the Spark side."""

from __future__ import annotations

JOIN = {
    "region": "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "nation": "JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    "stock": "JOIN part ON l_partkey = p_partkey",
    "sector": "JOIN part ON l_partkey = p_partkey",
    "market": "",
}
SYMBOL = {"region": "r_name", "nation": "n_name", "stock": "p_type || '|' || p_brand", "sector": "p_type", "market": "'MARKET'"}


def bars(level: str = "region", grain: str = "day") -> str:
    """CTEs t_<level>, bars_<level>."""
    tie = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
    day = f"""t_{level} AS (SELECT {SYMBOL[level]} AS symbol, l_shipdate::DATE AS dt, floor(l_extendedprice / l_quantity * 100) / 100.0::DOUBLE AS price, l_quantity AS qty,
        row_number() OVER (PARTITION BY {SYMBOL[level]}, l_shipdate::DATE ORDER BY {tie}) AS k FROM lineitem {JOIN[level]}),
    d_{level} AS (SELECT symbol, dt, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(qty::BIGINT)::DOUBLE AS volume FROM t_{level} GROUP BY ALL)"""
    if grain == "week":
        return day + f""",
    bars_{level} AS (SELECT symbol, date_trunc('week', dt)::DATE AS dt, arg_min(open, d.dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, d.dt) AS close, sum(volume) AS volume FROM d_{level} d GROUP BY symbol, date_trunc('week', dt)::DATE)"""
    return day + f", bars_{level} AS (SELECT * FROM d_{level})"


def market(level: str = "region", grain: str = "day") -> str:
    """CTE m_<level>: the filled spine with rn, dollar volume and returns."""
    fill = ", ".join(f"last_value(b.{c} IGNORE NULLS) OVER w AS {c}" for c in ("open", "high", "low", "close", "volume"))
    return (
        bars(level, grain)
        + f""",
    g_{level} AS (SELECT s.symbol, c.dt FROM (SELECT DISTINCT symbol FROM bars_{level}) s, (SELECT DISTINCT dt FROM bars_{level}) c),
    f_{level} AS (SELECT g.symbol, g.dt, {fill} FROM g_{level} g LEFT JOIN bars_{level} b USING (symbol, dt) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.dt ROWS UNBOUNDED PRECEDING)),
    m_{level} AS (SELECT *, close * volume AS dollar_vol, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS rn,
        avg(close * volume) OVER (PARTITION BY symbol ORDER BY dt ROWS 2 PRECEDING) AS dollar_vol_smoothed FROM f_{level} WINDOW w AS (PARTITION BY symbol ORDER BY dt))"""
    )


def bench(grain: str = "day") -> str:
    """CTE bench(dt, bench)."""
    return bars("market", grain) + ", bench AS (SELECT dt, close AS bench FROM bars_market)"


FEAR = "fear AS (SELECT l_shipdate::DATE AS dt, sum(round(l_discount * 100)::BIGINT) * 4.0::DOUBLE / count(*) AS vix FROM lineitem GROUP BY 1)"


def win(n: int | None, key: str = "symbol", time: str = "dt", shift: int = 0) -> str:
    part = f"PARTITION BY {key} " if key else ""
    first = "UNBOUNDED" if n is None else str(n - 1 + shift)
    last = "CURRENT ROW" if not shift else f"{shift} PRECEDING"
    return f"({part}ORDER BY {time} ROWS BETWEEN {first} PRECEDING AND {last})"


def roll(agg: str, x: str, n: int | None, mp: int, key: str = "symbol", time: str = "dt", shift: int = 0) -> str:
    """agg holds {} for the value."""
    w = win(n, key, time, shift)
    return f"(CASE WHEN count({x}) OVER {w} >= {mp} THEN {agg.format(f'({x})::DOUBLE')} OVER {w} END)"


def robust(src: str, out: str, x: str, col: str, n: int, mp: int, eps: float = 0.0, limit: float | None = None, key: str = "symbol", time: str = "dt") -> str:
    """CTE ``out``: ``src`` with column ``col``, the robust z of x."""
    z = f"(({x}) - __med) / nullif(1.4826 * {roll('median({})', '__dev', n, mp, key, time)} + {eps!r}, 0)"
    z = f"(CASE WHEN {z} IS NOT NULL THEN least(greatest({z}, {-limit!r}), {limit!r}) END)" if limit else z
    return f"""{out}_a AS (SELECT *, {roll('median({})', x, n, mp, key, time)} AS __med FROM {src}),
    {out}_b AS (SELECT *, abs(({x}) - __med) AS __dev FROM {out}_a),
    {out} AS (SELECT * EXCLUDE (__med, __dev), {z} AS {col} FROM {out}_b)"""


def zs(x: str, n: int, mp: int, eps: float = 0.0, key: str = "symbol", time: str = "dt") -> str:
    return f"(({x}) - {roll('avg({})', x, n, mp, key, time)}) / nullif({roll('stddev_samp({})', x, n, max(mp, 2), key, time)} + {eps!r}, 0)"


def ewm(src: str, out: str, x: str, col: str, decay: float, mp: int = 1, key: str = "symbol", time: str = "dt", adjust: bool = True) -> str:
    """CTE ``out``: ``src`` with column ``col``, by a join on row distance."""
    import math

    k = math.ceil(math.log(1e-16) / math.log(decay))
    share = f"pow({decay!r}, t.__n - u.__n)"
    if adjust:
        value = f"sum({share} * u.__x) / sum({share})"
    else:
        value = f"sum(CASE WHEN u.__n = 1 THEN {share} ELSE {1 - decay!r} * {share} END * u.__x)"
    return f"""{out}_a AS (SELECT *, ({x})::DOUBLE AS __x, row_number() OVER (PARTITION BY {key} ORDER BY {time}) AS __n FROM {src}),
    {out}_b AS (SELECT t.{key} AS __k, t.__n AS __r, {value} AS __e FROM {out}_a t JOIN {out}_a u ON t.{key} = u.{key} AND u.__n BETWEEN t.__n - {k} AND t.__n AND u.__x IS NOT NULL GROUP BY 1, 2),
    {out}_c AS (SELECT a.*, b.__e FROM {out}_a a LEFT JOIN {out}_b b ON a.{key} = b.__k AND a.__n = b.__r),
    {out} AS (SELECT * EXCLUDE (__x, __n, __e), CASE WHEN count(__x) OVER {win(None, key, time)} >= {mp} THEN last_value(__e IGNORE NULLS) OVER {win(None, key, time)} END AS {col} FROM {out}_c)"""


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {float(lo)!r}), {float(hi)!r}) END)"


def unit(x: str) -> str:
    return f"((tanh({x}) + 1) / 2)"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round(({c})::DOUBLE, {digits}) AS {c}" for c in columns)
