"""Streams: completed bars from ticks, aligned pairs, and a daily loss monitor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tick_stream(raw: DataFrame) -> DataFrame:
    """`events` rows as ticks with a zoned time, as watermarks need."""
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("id"))


def bar_stream(ticks: DataFrame, period: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Completed bars: in append mode a bar appears once the watermark has passed its end."""
    order = F.struct("ts", "id")
    bars = ticks.withWatermark("ts", late).groupBy(F.window("ts", period), "symbol").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def pair_stream(a: DataFrame, b: DataFrame, late: str = "2 hours") -> DataFrame:
    """Two streams of bars joined at equal times; both watermarked, so old bars leave the state."""
    left = a.select(F.col("ts").alias("ts"), F.col("close").alias("a_close")).withWatermark("ts", late)
    right = b.select(F.col("ts").alias("b_ts"), F.col("close").alias("b_close")).withWatermark("b_ts", late)
    return left.join(right, F.expr("ts = b_ts")).drop("b_ts")


def loss_monitor(equity: DataFrame, percent: float, initial: float) -> DataFrame:
    """The first row of each account and UTC day whose equity is percent of `initial` below the day's
    first. `equity`: account, ts, equity. State: the day, its first equity and whether it tripped."""

    def watch(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, start, tripped = state.get if state.exists else (None, 0.0, False)
        out = []
        rows = pd.concat(list(parts)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["equity"], strict=True):
            today = ts.strftime("%Y-%m-%d")
            if day is None or today > day:
                day, start, tripped = today, float(value), False
            if today == day and not tripped and value - start <= -percent / 100 * initial:
                tripped = True
                out.append((key[0], ts, float(value), start))
        state.update((day, start, tripped))
        yield pd.DataFrame(out, columns=["account", "ts", "equity", "day_start"])

    return equity.groupBy("account").applyInPandasWithState(watch, "account string, ts timestamp, equity double, day_start double", "day string, start double, tripped boolean", "append", GroupStateTimeout.NoTimeout)
