"""Splits, sessions and other predicates over bars and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSIONS = {"london": (7, 12), "ny": (13, 17), "asia": (0, 7)}


def split_by_dates(bars: DataFrame, splits: DataFrame, warmup: int = 200, keys=("symbol",)) -> DataFrame:
    """Bars with `split` for every split (split, start, stop dates, either null: open) they lie in;
    the stop day counts. Splits with fewer than warmup + 10 bars of a series are left out for it."""
    inside = (F.col("start").isNull() | (F.col("ts") >= F.col("start"))) & (F.col("stop").isNull() | (F.col("ts") < F.date_add("stop", 1)))
    cut = bars.join(F.broadcast(splits), inside).drop("start", "stop")  # a handful of literal rows
    n = F.count("*").over(Window.partitionBy("split", *keys))
    return cut.withColumn("_n", n).where(F.col("_n") >= warmup + 10).drop("_n")


def split_by_fraction(bars: DataFrame, share: float = 0.65, forward_from=None, keys=("symbol",)) -> DataFrame:
    """`split`: IS for the first share of bars (bar_idx) of a series, OOS after, FWD from a date on."""
    back = bars if forward_from is None else bars.where(F.col("ts") < F.lit(forward_from))
    sizes = back.groupBy(*keys).agg(F.count("*").alias("_n"))
    label = F.when(F.col("bar_idx") < F.floor(F.col("_n") * share), "IS").otherwise("OOS")
    if forward_from is not None:
        label = F.when(F.col("ts") >= F.lit(forward_from), "FWD").otherwise(label)
    return bars.join(sizes, [*keys]).withColumn("split", label).drop("_n")


def in_session(ts: Column, session: str) -> Column:
    """By UTC hour, the last one left out: london, ny, asia, both (london or ny) or all."""
    if session == "all":
        return F.lit(True)
    if session == "both":
        return in_session(ts, "london") | in_session(ts, "ny")
    if session not in SESSIONS:
        raise ValueError(f"unknown session: {session}")
    first, last = SESSIONS[session]
    return (F.hour(ts) >= first) & (F.hour(ts) < last)


def after_warmup(rows: DataFrame, warmup: int = 200) -> DataFrame:
    return rows.where(F.col("bar_idx") >= warmup)


def visible(trades: DataFrame, start, stop) -> DataFrame:
    """Trades that are open at some time of [start, stop]."""
    return trades.where((F.col("fill_ts") <= F.lit(stop)) & (F.coalesce("exit_ts", F.lit(stop)) >= F.lit(start)))


def really_closed(trades: DataFrame) -> DataFrame:
    return trades.where((F.col("status") == "closed") & (F.col("exit_reason") != "end_of_data"))


def last_bars(bars: DataFrame, n: int, keys=("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc())
    return bars.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def window_slices(bars: DataFrame, window: int, step: int, anchored: bool = False, keys=("symbol",)) -> DataFrame:
    """Bars (bar_idx) of every walk-forward window they belong to: window_idx and phase IS or OOS.

    IS is [w step, window + w step) (from 0 if anchored), OOS the step after it; a series of N bars
    has (N - window) // step windows. A bar's windows follow from its number.
    """
    sizes = bars.groupBy(*keys).agg(F.count("*").alias("_n"))
    i, count = F.col("bar_idx"), F.floor((F.col("_n") - window) / step)
    last_is = count - 1 if anchored else F.least(F.floor(i / step), count - 1)
    first_is = F.greatest(F.floor((i - window) / step) + 1, F.lit(0))
    oos = F.floor((i - window) / step)
    none = F.array().cast("array<struct<w:bigint,p:string>>")
    spans = F.when(last_is >= first_is, F.transform(F.sequence(first_is, last_is), lambda w: F.struct(w.alias("w"), F.lit("IS").alias("p")))).otherwise(none)
    tail = F.when((oos >= 0) & (oos < count), F.array(F.struct(oos.alias("w"), F.lit("OOS").alias("p")))).otherwise(none)
    rows = bars.join(sizes, [*keys]).withColumn("_s", F.concat(spans, tail))
    return rows.select(*bars.columns, F.explode("_s").alias("_s")).select(*bars.columns, F.col("_s.w").alias("window_idx"), F.col("_s.p").alias("phase"))
