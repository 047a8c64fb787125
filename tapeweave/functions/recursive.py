"""Exponential recursions y(t) = a x(t) + (1 - a) y(t-1), y(0) = x(0), over long series.

A series is cut into chunks. Each chunk is scanned on its own, from its first value on; a small table
of chunk ends, composed in order, gives every chunk what came before. No task ever holds a whole
series. Leading nulls give null; at later ones the value stays, and the next x weighs against what is
left of it after the rows between: y = ((1 - a)^k y + a x) / ((1 - a)^k + a) after k rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import kept
from .rolling import in_chunks, true_range

CHUNK = 100_000


def span(n: int) -> float:
    """The factor of a moving average of `n`."""
    return 2.0 / (n + 1)


def _weights(at: np.ndarray, alpha: float) -> np.ndarray:
    """The share of the value before that is left at each of the rows `at` but the first, which have an x."""
    left = np.power(1 - alpha, np.diff(at))
    return left / (left + alpha)


def scan(x: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(scan, share in it of the first x) at each row; null before the first x.

    In blocks within which products of the shares stay far from 0: there a scan is a running sum of
    inputs over the share that is left, times that share.
    """
    y, share = np.full(len(x), np.nan), np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return y, share
    own, left = np.empty(len(at)), np.empty(len(at))
    own[0], left[0] = x[at[0]], 1.0
    keep = np.concatenate([[1.0], _weights(at, alpha)])
    least = max(keep[1:].min(), 1e-12) if len(at) > 1 else 1.0
    width = int(np.clip(200 / max(-np.log(least), 1e-9), 8, 4096))
    for i in range(1, len(at), width):
        k = slice(i, min(len(at), i + width))
        part = np.cumprod(np.maximum(keep[k], 1e-12))
        own[k] = part * (own[i - 1] + np.cumsum((1 - keep[k]) * x[at[k]] / part))
        left[k] = part * left[i - 1]
    last = np.searchsorted(at, np.arange(len(x)), "right") - 1
    seen = last >= 0
    y[seen], share[seen] = own[last[seen]], left[last[seen]]
    return y, share


def ewm(rows: DataFrame, columns: dict[str, tuple[str, float]], keys=("symbol",), order: str = "bar_idx", chunk: int = CHUNK) -> DataFrame:
    """`rows` with the scans {name: (column, factor)}; `order`: dense numbers from 0 within `keys`.

    The scanned chunks are written once; their ends and the result read that table.
    """
    names = list(columns)
    base = rows.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    extra = ", ".join(f"`_y{i}` double, `_k{i}` double" for i in range(len(names)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        for i, (column, alpha) in enumerate(columns.values()):
            part[f"_y{i}"], part[f"_k{i}"] = scan(part[column].to_numpy(np.float64, na_value=np.nan), alpha)
        return part

    scanned = kept(base.groupBy(*keys, "_chunk").applyInPandas(local, f"{kinds}, _chunk long, {extra}"), "scanned")
    met = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c, _ in columns.values()}
    ends = scanned.groupBy(*keys, "_chunk").agg(*(
        F.struct(F.max_by(f"_y{i}", order).alias("y"), F.max_by(f"_k{i}", order).alias("k"), F.min_by(c, met[c]).alias("x"), F.min(met[c]).alias("first"), F.max(met[c]).alias("last")).alias(f"_e{i}")
        for i, (c, _) in enumerate(columns.values())
    ))
    # a chunk's first value follows from what came before; its end = y + k * (that - x): composed in order
    # over the chunks of a series, one row each
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carries = ends
    for i, (_, alpha) in enumerate(columns.values()):
        start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("long").alias("last"))
        carries = carries.withColumn(f"_c{i}", F.aggregate(F.collect_list(f"_e{i}").over(before), start, _composed(alpha)))
        carries = carries.withColumn(f"_d{i}", F.when(F.col(f"_c{i}.y").isNotNull(), _first(F.col(f"_c{i}"), F.col(f"_e{i}.first"), F.col(f"_e{i}.x"), alpha) - F.col(f"_e{i}.x")))
        carries = carries.withColumn(f"_c{i}", F.col(f"_c{i}.y"))
    joined = scanned.join(carries.select(*keys, "_chunk", *(f"_{x}{i}" for i in range(len(names)) for x in "cd")), [*keys, "_chunk"])
    out = (F.when(F.col(f"_y{i}").isNull(), F.col(f"_c{i}")).otherwise(F.col(f"_y{i}") + F.coalesce(F.col(f"_k{i}") * F.col(f"_d{i}"), F.lit(0.0))).alias(n) for i, n in enumerate(names))
    return joined.select(*rows.columns, *out)


def _composed(alpha: float):
    """What is carried (y, last row with an x) after one more chunk."""

    def step(carry, e):
        moved = F.when(carry["y"].isNull(), F.lit(0.0)).otherwise(e["k"] * (_first(carry, e["first"], e["x"], alpha) - e["x"]))
        return F.when(e["first"].isNull(), carry).otherwise(F.struct((e["y"] + moved).alias("y"), e["last"].alias("last")))

    return step


def _first(carry, first, x, alpha: float):
    """The value at row `first` of x, after `carry` (y, last row with an x)."""
    left = F.pow(F.lit(1 - alpha), first - carry["last"])
    return (left * carry["y"] + alpha * x) / (left + alpha)


def dema_tema(rows: DataFrame, x: str, n: int, keys=("symbol",), chunk: int = CHUNK) -> DataFrame:
    """Adds dema and tema of `x`: 2e - e(e) and 3e - 3e(e) + e(e(e))."""
    for k, source in enumerate((x, "_e1", "_e2"), 1):
        rows = ewm(rows, {f"_e{k}": (source, span(n))}, keys, chunk=chunk)
    e1, e2, e3 = (F.col(f"_e{k}") for k in (1, 2, 3))
    return rows.withColumns({"dema": 2 * e1 - e2, "tema": 3 * e1 - 3 * e2 + e3}).drop("_e1", "_e2", "_e3")


def atr(rows: DataFrame, n: int = 14, keys=("symbol",), name: str = "atr", chunk: int = CHUNK) -> DataFrame:
    ranged = in_chunks(rows, 1, lambda cut, by: cut.withColumn("_tr", true_range(F.col("high"), F.col("low"), F.col("close"), by)), keys, chunk=chunk)
    return ewm(ranged, {name: ("_tr", 1.0 / n)}, keys, chunk=chunk).drop("_tr")


def rsi(rows: DataFrame, n: int = 14, keys=("symbol",), chunk: int = CHUNK) -> DataFrame:
    """Null where nothing was lost yet."""

    def moves(cut: DataFrame, by: WindowSpec) -> DataFrame:
        d = F.col("close") - F.lag("close").over(by)
        return cut.withColumns({"_up": F.greatest(d, F.lit(0.0)) + d * 0, "_down": F.greatest(-d, F.lit(0.0)) + d * 0})

    moved = in_chunks(rows, 1, moves, keys, chunk=chunk)
    out = ewm(moved, {"_u": ("_up", 1.0 / n), "_d": ("_down", 1.0 / n)}, keys, chunk=chunk)
    return out.withColumn("rsi", 100 - 100 / (1 + F.try_divide("_u", F.nullif(F.col("_d"), F.lit(0.0))))).drop("_up", "_down", "_u", "_d")


def macd(rows: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys=("symbol",), chunk: int = CHUNK) -> DataFrame:
    both = ewm(rows, {"_f": ("close", span(fast)), "_s": ("close", span(slow))}, keys, chunk=chunk)
    line = both.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ewm(line, {"macd_signal": ("macd", span(signal))}, keys, chunk=chunk).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def adx(rows: DataFrame, n: int = 14, keys=("symbol",), chunk: int = CHUNK) -> DataFrame:
    """Directional movement counts the rise of the high if it exceeds the low's move in size, and
    mirrored for falls of the low."""

    def moves(cut: DataFrame, by: WindowSpec) -> DataFrame:
        dh, dl = F.col("high") - F.lag("high").over(by), F.col("low") - F.lag("low").over(by)
        return cut.withColumns({
            "_tr": true_range(F.col("high"), F.col("low"), F.col("close"), by),
            "_p": F.when((dh > F.abs(dl)) & (dh > 0), dh).otherwise(0.0),
            "_m": F.when((F.abs(dl) > dh) & (dl < 0), F.abs(dl)).otherwise(0.0),
        })

    smooth = ewm(in_chunks(rows, 1, moves, keys, chunk=chunk), {"_a": ("_tr", 1.0 / n), "_pp": ("_p", 1.0 / n), "_mm": ("_m", 1.0 / n)}, keys, chunk=chunk)
    di = smooth.withColumns({"plus_di": 100 * F.try_divide("_pp", "_a"), "minus_di": 100 * F.try_divide("_mm", "_a")})
    total = F.col("plus_di") + F.col("minus_di")
    dx = di.withColumn("_dx", 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.nullif(total, F.lit(0.0))))
    return ewm(dx, {"adx": ("_dx", 1.0 / n)}, keys, chunk=chunk).drop("_tr", "_p", "_m", "_a", "_pp", "_mm", "_dx")


def spread_adx(rows: DataFrame, spread: str, n: int = 14, keys=("pair",), chunk: int = CHUNK) -> DataFrame:
    """Adds adx of a single series: its rises and falls are the directional moves, their size the range."""

    def moves(cut: DataFrame, by: WindowSpec) -> DataFrame:
        d = F.col(spread) - F.lag(spread).over(by)
        return cut.withColumns({"_t": F.abs(d), "_p": F.when(d > 0, d).when(d <= 0, 0.0), "_m": F.when(d < 0, -d).when(d >= 0, 0.0)})

    smooth = ewm(in_chunks(rows, 1, moves, keys, chunk=chunk), {"_a": ("_t", 1.0 / n), "_pp": ("_p", 1.0 / n), "_mm": ("_m", 1.0 / n)}, keys, chunk=chunk)
    up, down = (100 * F.try_divide(x, F.nullif(F.col("_a"), F.lit(0.0))) for x in (F.col("_pp"), F.col("_mm")))
    dx = smooth.withColumn("_dx", 100 * F.try_divide(F.abs(up - down), F.nullif(up + down, F.lit(0.0))))
    return ewm(dx, {"adx": ("_dx", 1.0 / n)}, keys, chunk=chunk).drop("_t", "_p", "_m", "_a", "_pp", "_mm", "_dx")
