"""Null-safe column helpers and rolling windows that count rows of a symbol's calendar.

Missing values are NULL, never NaN.  A rolling aggregate is NULL until ``mp`` non-null values lie in its frame (the
window length unless given), whatever Spark's own aggregates would make of fewer.  All windows of one series share one
partitioning and order, so Catalyst plans one exchange and one sort for a chain of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "dt"
Agg = Callable[[Column], Column]


def over(n: int | None = None, key: str | tuple[str, ...] = KEY, time: str = TIME, shift: int = 0) -> WindowSpec:
    """The last ``n`` rows up to the current one (all of them for None), ``shift`` rows earlier."""
    keys = (key,) if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(time)
    return w.rowsBetween(Window.unboundedPreceding if n is None else -(n - 1) - shift, -shift)


def ordered(key: str | tuple[str, ...] = KEY, time: str = TIME) -> WindowSpec:
    keys = (key,) if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(time)


def roll(agg: Agg, x: Column, w: WindowSpec, mp: int) -> Column:
    return F.when(F.count(x).over(w) >= mp, agg(x).over(w))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def quantile(q: float) -> Agg:
    return lambda x: F.percentile(x, F.lit(q))


def div(a: Column, b: Column) -> Column:
    """NULL where the divisor is 0 or NULL."""
    return a / F.nullif(b, F.lit(0.0))


def correlation(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows that have both, as an aggregate or over a window; NULL without spread."""
    whole = lambda c: c if w is None else c.over(w)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return div(whole(F.covar_pop(x, y)), whole(F.stddev_pop(a)) * whole(F.stddev_pop(b)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def flag(condition: Column) -> Column:
    """1 or 0; 0 where the comparison is NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def change(x: Column, n: int, w: WindowSpec) -> Column:
    """x / x n rows ago - 1."""
    return div(x, F.lag(x, n).over(w)) - 1


def diff(x: Column, n: int, w: WindowSpec) -> Column:
    return x - F.lag(x, n).over(w)


def ffill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w)


def zscore(df: DataFrame, x: str, out: str, n: int, mp: int | None = None, eps: float = 0.0, key=KEY, time: str = TIME) -> DataFrame:
    """(x - mean) / (std + eps) over the last n rows; NULL where the divisor is 0."""
    mp = n if mp is None else mp
    w, c = over(n, key, time), F.col(x)
    return df.withColumn(out, div(c - roll(F.avg, c, w, mp), roll(F.stddev_samp, c, w, max(mp, 2)) + eps))


def robust_z(df: DataFrame, x: str, out: str, n: int, mp: int | None = None, eps: float = 0.0, limit: float | None = None, key=KEY, time: str = TIME) -> DataFrame:
    """(x - median) / (1.4826 MAD + eps) with each row's own rolling median in the deviations; clipped at +-limit.

    With ``eps`` 0 a MAD of 0 gives NULL.  The variants of the analytics differ in mp, eps and limit alone.
    """
    mp = n if mp is None else mp
    w, c = over(n, key, time), F.col(x)
    med, dev = f"__{out}_med", f"__{out}_dev"
    df = df.withColumn(med, roll(median, c, w, mp))
    df = df.withColumn(dev, F.abs(c - F.col(med)))
    z = div(c - F.col(med), 1.4826 * roll(median, F.col(dev), w, mp) + eps)
    return df.withColumn(out, clip(z, -limit, limit) if limit else z).drop(med, dev)


def frame_of(decay: float) -> int:
    """Rows after which a weight has fallen below double precision."""
    return math.ceil(math.log(1e-16) / math.log(decay))


def decay_of(span: float | None = None, halflife: float | None = None, alpha: float | None = None) -> float:
    if span is not None:
        return 1 - 2 / (span + 1)
    if halflife is not None:
        return 0.5 ** (1 / halflife)
    return 1 - alpha


def ewm(df: DataFrame, x: str, out: str, decay: float, mp: int = 1, adjust: bool = True, key=KEY, time: str = TIME) -> DataFrame:
    """Exponentially weighted mean over non-null values, weights by distance in rows, null rows included.

    Exact to double precision in a bounded frame.  A null row repeats the last value.  ``adjust=False`` is the
    recursive form, for series without nulls.
    """
    keys = (key,) if isinstance(key, str) else key
    order, k = ordered(key, time), frame_of(decay)
    df = df.withColumn("__rn", F.row_number().over(order))
    pair = F.collect_list(F.struct(F.col("__rn").alias("r"), F.col(x).alias("x"))).over(over(k + 1, keys, time))
    df = df.withColumn("__h", F.filter(pair, lambda p: p["x"].isNotNull()))
    weight = lambda p: F.pow(F.lit(decay), F.col("__rn") - p["r"])
    if adjust:
        top = F.aggregate("__h", F.lit(0.0), lambda a, p: a + weight(p) * p["x"])
        bottom = F.aggregate("__h", F.lit(0.0), lambda a, p: a + weight(p))
        value = div(top, bottom)
    else:
        share = lambda p: F.when(p["r"] == 1, weight(p)).otherwise((1 - decay) * weight(p))
        value = F.when(F.size("__h") > 0, F.aggregate("__h", F.lit(0.0), lambda a, p: a + share(p) * p["x"]))
    df = df.withColumn("__e", value)
    filled = ffill(F.col("__e"), over(None, keys, time))
    enough = F.count(F.col(x)).over(over(None, keys, time)) >= mp
    return df.withColumn(out, F.when(enough, filled)).drop("__rn", "__h", "__e")


def share_below(df: DataFrame, x: str, out: str, n: int, key=KEY, time: str = TIME) -> DataFrame:
    """Share of the previous n - 1 values strictly below the current one; a whole window of values is needed."""
    w = over(n, key, time)
    df = df.withColumn("__l", F.collect_list(F.col(x)).over(w))
    below = F.size(F.filter("__l", lambda v: v < F.col(x))) / F.lit(float(n - 1))
    return df.withColumn(out, F.when((F.size("__l") == n) & F.col(x).isNotNull(), below)).drop("__l")


def rolling_rank(df: DataFrame, x: str, out: str, n: int, mp: int, key=KEY, time: str = TIME) -> DataFrame:
    """Percent rank (ties at their average) of the current value among the last n."""
    df = df.withColumn("__l", F.collect_list(F.col(x)).over(over(n, key, time)))
    less = F.size(F.filter("__l", lambda v: v < F.col(x)))
    same = F.size(F.filter("__l", lambda v: v == F.col(x)))
    rank = (less + (same + 1) / 2) / F.size("__l")
    return df.withColumn(out, F.when((F.size("__l") >= mp) & F.col(x).isNotNull(), rank)).drop("__l")


def average_rank(x: Column, keys: list[str], descending: bool = False) -> Column:
    """Rank from 1 with ties at their average, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(x) if descending else F.asc_nulls_last(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def rank_share(x: Column, keys: list[str]) -> Column:
    """Average rank over the number of values."""
    return average_rank(x, keys) / F.count(x).over(Window.partitionBy(*keys))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit(x: Column) -> Column:
    """(tanh x + 1) / 2."""
    return (F.tanh(x) + 1) / 2
