"""Audits: features that look ahead, trades that can't be, gaps in bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def causality_audit(features: Callable[[DataFrame], DataFrame], bars: DataFrame, names: list[str], check: int = 5, rtol: float = 1e-9, keys=("symbol",)) -> DataFrame:
    """Rows (keys, bar_idx, feature, on_half, on_all) where a feature changes once later bars are seen.

    The features of the first half of each series are compared, over its last `check` bars, with
    those of the whole series; one null against a value is a violation too.
    """
    half = bars.groupBy(*keys).agg(F.floor(F.count("*") / 2).alias("_half"))
    cut = bars.join(half, [*keys]).where(F.col("bar_idx") < F.col("_half")).drop("_half")
    long = lambda df: df.select(*keys, "bar_idx", *(F.col(n).cast("double").alias(n) for n in names)).unpivot([*keys, "bar_idx"], names, "feature", "value")
    a, b = long(features(cut)).withColumnRenamed("value", "on_half"), long(features(bars)).withColumnRenamed("value", "on_all")
    last = half.select(*keys, "_half")
    both = a.join(last, [*keys]).where(F.col("bar_idx") >= F.col("_half") - check).drop("_half").join(b, [*keys, "bar_idx", "feature"])
    differs = F.col("on_half").isNull() != F.col("on_all").isNull()
    return both.where(differs | (F.abs(F.col("on_half") - F.col("on_all")) > rtol * F.abs("on_all")))


def trade_violations(trades: DataFrame, keys=("symbol",), most_open: int = 1) -> DataFrame:
    """Trades that break placed < fill < exit, or that overlap more than `most_open` others allow. A trade
    that is filled on the last bar is closed there by `end_of_data`."""
    w = Window.partitionBy(*keys).orderBy("fill_bar", "exit_bar")
    rows = trades.withColumn("_busy", F.lag("exit_bar", most_open).over(w))
    reason = F.when(F.col("placed_bar") >= F.col("fill_bar"), "filled before placed").when((F.col("fill_bar") > F.col("exit_bar")) | (F.col("fill_bar") == F.col("exit_bar")) & (F.col("exit_reason") != "end_of_data"), "closed before filled").when(F.col("_busy") > F.col("fill_bar"), "overlap")
    return rows.withColumn("violation", reason).where(reason.isNotNull()).drop("_busy")


def bar_gaps(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Bars that come later than the series' usual period after the one before: gap in seconds."""
    w = Window.partitionBy(*keys).orderBy("ts")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = bars.select(*keys, "ts", (seconds - F.lag(seconds).over(w)).alias("gap"))
    usual = rows.where("gap is not null").groupBy(*keys).agg(F.mode("gap", True).alias("period"))
    return rows.join(usual, [*keys]).where(F.col("gap") > F.col("period"))
