"""Weekly cross-region layer: flow pressure, risk direction, regimes, alignment, stability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ladders as lad
from ..functions.primitives import change, clip, correlation, decay_of, div, ewm, flag, median, ordered, over, quantile, robust_z, roll, rolling_rank
from ..streaming.bars import next_regime


def weekly_data(market: DataFrame) -> DataFrame:
    """Fridays only (a Friday without a bar day is skipped), returns, weeks that every symbol has."""
    df = market.filter(F.weekday("dt") == 4).select("symbol", "dt", "close", "volume")
    df = df.withColumn("ret", change(F.col("close"), 1, ordered())).withColumn("dv", F.col("close") * F.col("volume"))
    n = df.select("symbol").distinct().agg(F.count("*").alias("n"))
    full = df.groupBy("dt").agg(F.count("ret").alias("have")).crossJoin(F.broadcast(n)).filter("have = n").select("dt")
    return df.join(full, "dt", "left_semi")


def weekly_data_v3(market: DataFrame) -> DataFrame:
    """Thursdays; with fewer than five of them the last close of each week ending on Sunday."""
    thursdays = market.filter(F.weekday("dt") == 3).select("symbol", "dt", "close", "volume")
    few = F.broadcast(thursdays.agg((F.count_distinct("dt") < 5).alias("few")))
    week = F.date_add(F.to_date(F.date_trunc("week", "dt")), 6)
    known = market.filter("close is not null").groupBy("symbol", week.alias("dt")).agg(F.max_by("close", "dt").alias("close"), F.max_by("volume", "dt").alias("volume"))
    out = thursdays.crossJoin(few).filter("not few").drop("few").unionByName(known.crossJoin(few).filter("few").drop("few"))
    return out.withColumn("ret", change(F.col("close"), 1, ordered())).withColumn("dv", F.col("close") * F.col("volume")).filter("ret is not null")


def flow_pressure(weekly: DataFrame) -> DataFrame:
    """Smoothed robust z of weekly dollar volume."""
    return ewm(robust_z(weekly, "dv", "__z", 60, mp=20, limit=5.0), "__z", "flow_pressure", decay_of(halflife=2), mp=10).drop("__z")


def risk_direction(weekly: DataFrame) -> DataFrame:
    """Return over volatility, which is floored by its own 10 % quantile as of the last week (a look-ahead that
    the analytics have) and by 0.01."""
    df = weekly.withColumn("vol20", roll(F.stddev_samp, F.col("ret"), over(20), 20))
    df = df.withColumn("__q", roll(quantile(0.1), F.col("vol20"), over(252), 20))
    last = df.groupBy("symbol").agg(F.greatest(F.coalesce(F.max_by("__q", "dt"), F.lit(0.01)), F.lit(0.01)).alias("floor"))
    df = df.join(last, "symbol")
    return df.withColumn("risk_direction", div(F.col("ret"), F.when(F.col("vol20").isNotNull(), F.greatest("vol20", "floor")))).drop("__q", "floor")


def lagged(df: DataFrame, *columns: str) -> DataFrame:
    """All signals one week late, the first week gone."""
    w = ordered()
    df = df.withColumn("__n", F.row_number().over(w))
    for c in columns:
        df = df.withColumn(c, F.lag(c).over(w))
    return df.filter("__n > 1").drop("__n")


def volatility_regime(weekly: DataFrame) -> DataFrame:
    """Per symbol the robust z of the last 20 weeks' volatility against the three-year one (1.0 below 156 weeks),
    and the median over symbols."""
    df = weekly.filter("ret is not null").withColumn("__s", roll(F.stddev_samp, F.col("ret"), over(156), 52)).withColumn("__v", roll(F.stddev_samp, F.col("ret"), over(20), 20))
    mid = df.groupBy("symbol").agg(median(F.col("__s")).alias("mid"), F.count("*").alias("n"), F.max_by("__v", "dt").alias("now"))
    mad = df.join(mid, "symbol").groupBy("symbol").agg(median(F.abs(F.col("__s") - F.col("mid"))).alias("mad"), F.first("mid").alias("mid"), F.first("n").alias("n"), F.first("now").alias("now"))
    by = mad.select("symbol", F.when(F.col("n") < 156, 1.0).otherwise((F.col("now") - F.col("mid")) / (1.4826 * F.col("mad") + 1e-9)).alias("regime"))
    return by.withColumn("overall", F.percentile("regime", F.lit(0.5)).over(Window.partitionBy(F.lit(1))))


def region_alignment(weekly: DataFrame, window: int = 12, regions: DataFrame | None = None) -> DataFrame:
    """Mean pairwise correlation of the regions' returns over ``window`` weeks, at the last week that has it for
    every pair; 0.5 without such a week or without two regions.

    ``regions`` (region, symbol) is configuration; a region's return is the mean of its symbols'.  Without it every
    symbol is a region.  A region without any symbol here does not count.
    """
    x = weekly.select("dt", F.col("symbol").alias("region"), "ret")
    if regions is not None:
        x = weekly.join(F.broadcast(regions.select("region", "symbol")), "symbol").groupBy("dt", "region").agg(F.avg("ret").alias("ret"))
    pairs = x.alias("a").join(x.alias("b"), (F.col("a.dt") == F.col("b.dt")) & (F.col("a.region") < F.col("b.region")))
    pairs = pairs.select("a.dt", F.concat_ws("|", "a.region", "b.region").alias("symbol"), F.col("a.ret").alias("x"), F.col("b.ret").alias("y"))
    both = F.when(F.col("x").isNotNull(), F.col("y"))
    by = pairs.withColumn("c", F.when(F.count(both).over(over(window)) >= window, correlation(F.col("x"), F.col("y"), over(window))))
    by = by.groupBy("dt").agg(F.count("c").alias("n"), F.avg("c").alias("mean")).crossJoin(F.broadcast(pairs.agg(F.count_distinct("symbol").alias("all"))))  # one row
    return by.agg(F.coalesce(F.max_by(F.when(F.col("n") == F.col("all"), F.col("mean")), F.when(F.col("n") == F.col("all"), F.col("dt"))), F.lit(0.5)).alias("alignment"))


def coherence(signals: DataFrame, home: str, others: list[str], window: int = 12) -> DataFrame:
    """Mean of the correlations of flow and of direction between home and the others' median, last weeks."""
    f = lambda c: F.max(F.when(F.col("symbol") == home, F.col(c))).alias(f"h_{c}")
    g = lambda c: F.percentile(F.when(F.col("symbol").isin(*others), F.col(c)), F.lit(0.5)).alias(f"o_{c}")
    by = signals.groupBy("dt").agg(f("flow_pressure"), g("flow_pressure"), f("risk_direction"), g("risk_direction")).orderBy(F.desc("dt")).limit(window)
    both = by.agg(F.count("*").alias("n"), correlation(F.col("h_flow_pressure"), F.col("o_flow_pressure")).alias("a"), correlation(F.col("h_risk_direction"), F.col("o_risk_direction")).alias("b"))
    value = F.coalesce(clip((F.col("a") + F.col("b")) / 2, -1, 1), F.lit(0.0))
    return both.select(F.when(F.col("n") < window, 0.0).otherwise(value).alias("coherence"))


def global_state(signals: DataFrame, weekly: DataFrame, roles: dict[str, str], equity: list[str], bonds: list[str], goods: list[str]) -> DataFrame:
    """A9, A10, P30, P33, P34, P36 of the last week: one row.  roles: home, credit, usd."""
    last = signals.join(F.broadcast(signals.agg(F.max("dt").alias("dt"))), "dt", "left_semi")
    one = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col(c)))
    # a member without a value leaves the group without a median
    mid = lambda group: F.when(F.count(F.when(F.col("symbol").isin(*group) & F.col("flow_pressure").isNull(), 1)) == 0, F.percentile(F.when(F.col("symbol").isin(*group), F.col("flow_pressure")), F.lit(0.5)))
    share = lambda c: F.sum(F.when(F.col("symbol").isin(*equity), flag(F.col(c) > 0)).otherwise(0)) / float(len(equity))
    others = [s for s in equity if s != roles["home"]]
    aggs = [mid(equity).alias("m_eq"), mid(bonds).alias("m_bo"), mid(goods).alias("m_go"), mid(others).alias("m_ot"), share("flow_pressure").alias("participation"), share("risk_direction").alias("risk_breadth"), one(roles["credit"], "flow_pressure").alias("credit")]
    df = last.agg(F.max("dt").alias("dt"), *aggs, *[one(s, "flow_pressure").alias(f"f{i}") for i, s in enumerate(equity)])
    usd = weekly.filter(F.col("symbol") == roles["usd"]).withColumn("before", F.lag("close", 9).over(ordered())).orderBy(F.desc("dt")).limit(1).select(lad.usd_trend(F.col("close"), F.col("before")).alias("usd"))
    flows = [F.col(f"f{i}") for i in range(len(equity))]
    home = flows[equity.index(roles["home"])]
    df = df.withColumn("capital_rotation", (F.col("m_eq") + F.col("m_go")) / 2 - F.col("m_bo")).withColumn("dominance", lad.dominance(home, F.col("m_ot")))
    df = df.withColumn("score", lad.global_score([home, *[f for f in flows if f is not home]], F.col("credit"))).withColumn("label", lad.regime_label(F.col("score")))
    return df.crossJoin(F.broadcast(usd))


def participation_momentum(weekly: DataFrame) -> DataFrame:
    """Participation-weighted momentum of the older layer (winsorised at full-sample quantiles)."""
    df = weekly.withColumn("vol20", roll(F.stddev_samp, F.col("ret"), over(20), 20))
    df = df.withColumn("__f", roll(quantile(0.1), F.col("vol20"), over(252), 20))
    edges = df.groupBy("symbol").agg(F.percentile("ret", F.lit(0.01)).alias("lo"), F.percentile("ret", F.lit(0.99)).alias("hi"))
    df = df.join(edges, "symbol")
    adj = F.when(F.col("vol20").isNotNull() & F.col("__f").isNotNull(), F.greatest("vol20", "__f", F.lit(0.01)))
    df = robust_z(df, "dv", "__p", 60, mp=20, limit=5.0)
    df = df.withColumn("__raw", 0.6 * F.col("__p") + 0.4 * F.least(F.greatest("ret", "lo"), F.col("hi")) / adj)
    df = rolling_rank(df, "dv", "__rank", 252, 20)
    shock = F.coalesce((F.col("__rank") > 0.99) & (F.abs("ret") < 0.5 * F.col("vol20")), F.lit(False))
    df = df.withColumn("__raw", F.when(shock, F.col("__raw") * 0.5).otherwise(F.col("__raw")))
    df = robust_z(df, "__raw", "__z", 60, mp=20, limit=5.0)
    return ewm(df, "__z", "pwm", decay_of(halflife=2), mp=10).drop("__f", "lo", "hi", "__p", "__raw", "__rank", "__z")


def global_state_v3(pwm: DataFrame, geo: list[str], credit: str, bonds: str, goods: str, gold: str) -> DataFrame:
    """A11, P31, P32, P35 and the label of the last week: one row.  The first of ``geo`` is home."""
    last = pwm.join(F.broadcast(pwm.agg(F.max("dt").alias("dt"))), "dt", "left_semi")
    one = lambda s: F.max(F.when(F.col("symbol") == s, F.col("pwm")))
    names = {**{f"g{i}": s for i, s in enumerate(geo)}, "credit": credit, "bonds": bonds, "goods": goods, "gold": gold}
    df = last.agg(F.max("dt").alias("dt"), *[one(s).alias(n) for n, s in names.items()])
    g = [F.col(f"g{i}") for i in range(len(geo))]
    share = lambda xs: sum((flag(x > 0) for x in xs[1:]), flag(xs[0] > 0)) / float(len(xs))
    c = F.col
    df = df.withColumn("geo_breadth", share(g)).withColumn("growth_breadth", share([*g, c("credit")])).withColumn("inflation_breadth", share([c("goods")])).withColumn("defensive_breadth", share([c("bonds"), c("gold")]))
    df = df.withColumn("score", lad.global_score_v3(g, c("credit"))).withColumn("coherence", lad.coherence_product(g[0], lad.median_of(*g[1:])))
    df = df.withColumn("driver", lad.risk_driver(g[0], c("bonds"), c("goods"), c("credit"), c("gold")))
    return df.withColumn("confidence", lad.driver_confidence(c("driver"), F.lit(None).cast("array<string>"))).withColumn("label", lad.regime_label(c("score")))


def stability(series: DataFrame, x: str, window: int = 12) -> DataFrame:
    """R43 and R44 per symbol: 1 - recent / historic std, its flag, and the regime shift at the last row."""
    df = series.withColumn("__rn", F.row_number().over(ordered("symbol").orderBy(F.desc("dt"))))
    known = df.filter(F.col(x).isNotNull())
    recent = df.filter(F.col("__rn") <= window).groupBy("symbol").agg(F.when(F.count(x) >= 2, F.stddev_samp(x)).alias("recent"))
    historic = known.withColumn("__h", roll(F.stddev_samp, F.col(x), over(252), window)).groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("__h", "dt").alias("historic"))
    mid = df.filter(F.col("__rn") <= 60).groupBy("symbol").agg(F.when(F.count(x) >= 60, F.percentile(x, F.lit(0.5))).alias("mid"), F.max_by(x, "dt").alias("now"))
    dev = df.filter(F.col("__rn") <= 60).join(mid, "symbol").groupBy("symbol").agg(F.percentile(F.abs(F.col(x) - F.col("mid")), F.lit(0.5)).alias("mad"), F.first("mid").alias("mid"), F.first("now").alias("now"))
    out = historic.join(recent, "symbol").join(dev, "symbol")
    steady = F.when((F.col("n") >= window) & (F.col("historic") != 0), 1 - F.least(F.col("recent") / F.nullif(F.col("historic"), F.lit(0.0)), F.lit(1.0)))
    shift = (F.col("n") >= 60) & (F.abs(div(F.col("now") - F.col("mid"), 1.4826 * F.col("mad"))) > 2.5)
    return out.select("symbol", steady.alias("stability"), flag(steady < 0.5).alias("unstable"), flag(shift).alias("shift"))


def correlation_stress(weekly: DataFrame, span: int = 60, window: int = 156, mp: int = 52) -> DataFrame:
    """R40 as intended: mean pairwise exponentially weighted correlation of each week, its robust z over three years
    and a flag above 2.  (The analytics group by asset instead of week there, which yields (False, 0.0) always.)"""
    x = weekly.select("dt", "symbol", "ret")
    pairs = x.alias("a").join(x.alias("b"), (F.col("a.dt") == F.col("b.dt")) & (F.col("a.symbol") < F.col("b.symbol")))
    df = pairs.select(F.concat_ws("|", "a.symbol", "b.symbol").alias("symbol"), F.col("a.dt").alias("dt"), F.col("a.ret").alias("x"), F.col("b.ret").alias("y"))
    df = df.withColumns({"xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y")})
    for n in ("x", "y", "xx", "yy", "xy"):  # weighted means over a bounded frame
        df = ewm(df, n, f"m_{n}", decay_of(span=span))
    m = lambda n: F.col(f"m_{n}")
    cov, vx, vy = m("xy") - m("x") * m("y"), m("xx") - m("x") * m("x"), m("yy") - m("y") * m("y")
    df = df.withColumn("n", F.row_number().over(ordered())).withColumn("c", F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)))
    mean = df.groupBy("dt").agg(F.avg("c").alias("mean_corr")).withColumn("one", F.lit(1))
    mean = robust_z(mean, "mean_corr", "stress_z", window, mp=mp, eps=1e-9, key="one")
    return mean.select("dt", "mean_corr", "stress_z", flag(F.col("stress_z") > 2).alias("stress"))


def regime_row(history: DataFrame | None, now: DataFrame) -> DataFrame:
    """The row (ts, regime, score, persistence) to append to the history for ``now`` (ts, score; one row).

    The label has no hysteresis; persistence is the last row's plus one if its label is the same, else 1.
    """
    row = now.select("ts", lad.regime_label(F.col("score")).alias("regime"), "score")
    if history is None:
        return row.withColumn("persistence", F.lit(1))
    last = history.select(F.col("regime").alias("was"), F.coalesce("persistence", F.lit(0)).alias("held"), F.col("ts").alias("at")).orderBy(F.desc("at")).limit(1)
    row = row.join(F.broadcast(last), F.lit(True), "left")  # one row
    return row.select("ts", "regime", "score", F.when(F.col("regime") == F.col("was"), F.col("held") + 1).otherwise(1).alias("persistence"))


def regime_history(scores: DataFrame, key: str = "symbol") -> DataFrame:
    """P36 for whole series: what appending ``regime_row`` week by week leaves (label and how many rows it has held)."""
    w = ordered(key)
    df = scores.withColumn("label", lad.regime_label(F.col("score"))).withColumn("__n", F.row_number().over(w))
    df = df.withColumn("__new", F.when(F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True)), F.col("__n")))
    return df.withColumn("persistence", F.col("__n") - F.last("__new", ignorenulls=True).over(over(None, key)) + 1).drop("__n", "__new")


def regime_hysteresis(scores: DataFrame, key: str = "symbol") -> DataFrame:
    """Per key the labels of scores in time order, upgrades only after three weeks in the old label.

    The state machine takes one pass over the key's ordered scores (a weekly series), which no window can express.
    """
    types = dict(scores.select(key, "dt", "score").dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["dt", "score"], na_position="first")
        label, count, out = None, 0, []
        for score in rows["score"]:
            label, count = next_regime(score, label, count)
            out.append((label, count))
        return rows.assign(label=[x[0] for x in out], count=[x[1] for x in out])

    schema = f"`{key}` {types[key]}, dt {types['dt']}, score {types['score']}, label string, count int"
    return scores.select(key, "dt", "score").groupBy(key).applyInPandas(run, schema)
