"""Look-back indicators as window expressions.

Every function takes columns and the window to look back in (`by`: a WindowSpec partitioned by the
series and ordered by time) and returns a column: a value at a bar depends on that bar and earlier
ones only. A rolling value is null until its window holds `n` values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Bars of a chunk in `in_chunks`.
CHUNK = 1 << 16


def in_chunks(rows: DataFrame, look: int, made: Callable[[DataFrame, WindowSpec], DataFrame], keys=("symbol",), order: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """`made`(rows, by), which adds columns that look back over windows `by`, with every series cut in chunks.

    A chunk also gets the `look` rows before it, as many as a value can depend on in all (windows of windows add up);
    they go when the columns are there. So no task holds a series, and values don't depend on where it is cut.
    `order`: dense numbers.
    """
    own, reach = F.floor(F.col(order) / chunk), F.floor((F.col(order) + look) / chunk)
    spread = rows.withColumn("_chunk", F.explode(F.sequence(own, reach)))
    out = made(spread, Window.partitionBy(*keys, "_chunk").orderBy(order))
    return out.where(F.col("_chunk") == own).drop("_chunk")


def back(by: WindowSpec, n: int) -> WindowSpec:
    return by.rowsBetween(-(n - 1), 0)


def full(x: Column, agg: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(x).over(w) == n, agg)


def shift(x: Column, by: WindowSpec, n: int = 1) -> Column:
    return F.lag(x, n).over(by)


def rolling_max(x: Column, by: WindowSpec, n: int) -> Column:
    return full(x, F.max(x).over(back(by, n)), back(by, n), n)


def rolling_min(x: Column, by: WindowSpec, n: int) -> Column:
    return full(x, F.min(x).over(back(by, n)), back(by, n), n)


def sma(x: Column, by: WindowSpec, n: int) -> Column:
    return full(x, F.avg(x).over(back(by, n)), back(by, n), n)


def _summed(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def wma(x: Column, by: WindowSpec, n: int) -> Column:
    """Weights 1 to n, the latest heaviest."""
    return _summed(F.lag(x, j).over(by) * (n - j) for j in range(n)) / (n * (n + 1) / 2)  # null until there are n


def bollinger(x: Column, by: WindowSpec, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = sma(x, by, n), full(x, F.stddev_pop(x).over(back(by, n)), back(by, n), n)
    return {"bb_mid": mid, "bb_upper": mid + k * sd, "bb_lower": mid - k * sd}


def stochastic_k(high: Column, low: Column, close: Column, by: WindowSpec, k: int = 14) -> Column:
    lo, hi = rolling_min(low, by, k), rolling_max(high, by, k)
    return F.try_divide(100 * (close - lo), hi - lo)


def cci(high: Column, low: Column, close: Column, by: WindowSpec, n: int = 20) -> Column:
    tp = (high + low + close) / 3
    mean = F.avg(tp).over(back(by, n))
    mad = _summed(F.abs(F.lag(tp, j).over(by) - mean) for j in range(n)) / n
    return full(tp, F.try_divide(tp - mean, 0.015 * mad), back(by, n), n)


def mfi_flows(tp: Column, before: Column, volume: Column) -> tuple[Column, Column]:
    """Positive and negative money flow of a bar, from its typical price and the one before."""
    return F.when(tp > before, tp * volume).otherwise(0.0), F.when(tp < before, tp * volume).otherwise(0.0)


def mfi(up: Column, down: Column, by: WindowSpec, n: int = 14) -> Column:
    ups, downs = F.sum(up).over(back(by, n)), F.sum(down).over(back(by, n))
    ratio = F.try_divide(ups, F.nullif(downs, F.lit(0.0)))
    return full(up, 100 - 100 / (1 + ratio), back(by, n), n)


def swing_high(x: Column, by: WindowSpec, n: int) -> Column:
    """The highest of the n bars before this one."""
    w = by.rowsBetween(-n, -1)
    return full(x, F.max(x).over(w), w, n)


def swing_low(x: Column, by: WindowSpec, n: int) -> Column:
    w = by.rowsBetween(-n, -1)
    return full(x, F.min(x).over(w), w, n)


def higher_highs(high: Column, by: WindowSpec, n: int = 5) -> Column:
    return F.coalesce((high > swing_high(high, by, n)).cast("double"), F.lit(0.0))


def lower_lows(low: Column, by: WindowSpec, n: int = 5) -> Column:
    return F.coalesce((low < swing_low(low, by, n)).cast("double"), F.lit(0.0))


def true_range(high: Column, low: Column, close: Column, by: WindowSpec) -> Column:
    before = F.lag(close).over(by)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def fair_value_gaps(high: Column, low: Column, by: WindowSpec) -> dict[str, Column]:
    """Three-bar gaps: flags and the zone between the outer bars."""
    h2, l2 = F.lag(high, 2).over(by), F.lag(low, 2).over(by)
    bear, bull = F.coalesce(high < l2, F.lit(False)), F.coalesce(low > h2, F.lit(False))
    return {
        "fvg_bear": bear,
        "fvg_bull": bull,
        "fvg_bottom": F.when(bear, high).when(bull, h2),
        "fvg_top": F.when(bear, l2).when(bull, low),
    }


def liquidity_sweeps(high: Column, low: Column, close: Column, atr: Column, by: WindowSpec, n: int = 15, least_atr: float = 0.5) -> dict[str, Column]:
    """A bar that runs the last n bars' extreme and closes back inside, by at least so much of `atr`."""
    sh, sl = swing_high(high, by, n), swing_low(low, by, n)
    usable = atr.isNotNull() & (atr != 0)
    bear = usable & (high > sh) & (close < sh) & (high - sh >= least_atr * atr)
    bull = usable & (low < sl) & (close > sl) & (sl - low >= least_atr * atr)
    return {"sweep_bear": F.coalesce(bear, F.lit(False)), "sweep_bull": F.coalesce(bull, F.lit(False))}


def zscore(x: Column, by: WindowSpec, n: int) -> Column:
    """By the sample deviation of the window."""
    sd = F.stddev_samp(x).over(back(by, n))
    return full(x, F.try_divide(x - F.avg(x).over(back(by, n)), F.nullif(sd, F.lit(0.0))), back(by, n), n)


def log_return(x: Column, by: WindowSpec) -> Column:
    return F.ln(F.try_divide(x, F.lag(x).over(by)))


def rolling_corr(a: Column, b: Column, by: WindowSpec, n: int) -> Column:
    return full(a + b, F.corr(a, b).over(back(by, n)), back(by, n), n)


def rolling_hedge_ratio(a: Column, b: Column, by: WindowSpec, n: int) -> Column:
    """Slope of a on b by least squares."""
    return full(a + b, F.regr_slope(a, b).over(back(by, n)), back(by, n), n)
