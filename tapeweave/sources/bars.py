"""Bar tables: reading, normalising, cleaning, decoding, storing.

A bar table has symbol, ts, open, high, low, close, volume and optionally spread; timestamps are UTC.
Every function takes and returns DataFrames and runs no action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OHLC = ("open", "high", "low", "close")


def read_bars_csv(spark: SparkSession, path: str, symbol: str | None = None, by_folder: str | None = None) -> DataFrame:
    """Bars from CSV: the first column is the time (UTC if it names no zone), names in any case. The symbol
    is `symbol`, or the value of the folders `by_folder`=... that the files lie in."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF("ts", *(c.strip().lower() for c in raw.columns[1:]))
    missing = [c for c in OHLC if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if "volume" not in raw.columns:
        raw = raw.withColumn("volume", F.lit(0.0))
    numbers = [c for c in (*OHLC, "volume", "spread") if c in raw.columns]
    bars = raw.select(F.to_timestamp("ts").alias("ts"), *(F.col(c).cast("double").alias(c) for c in numbers))
    if symbol is not None:
        bars = bars.select(F.lit(symbol).alias("symbol"), "*")
    elif by_folder is not None:
        bars = raw.select(F.col(by_folder.lower()).cast("string").alias("symbol"), F.to_timestamp("ts").alias("ts"), *(F.col(c).cast("double").alias(c) for c in numbers))
    return bars.na.drop(subset=list(OHLC))


def wall_clock(time: Column, convert: bool = False) -> Column:
    """A timestamp from ISO text with mixed zones: the zone is cut off, or with `convert` applied."""
    if convert:
        return F.to_utc_timestamp(F.to_timestamp(time), "UTC")
    return F.to_timestamp_ntz(F.regexp_replace(time, r"([+-]\d{2}:\d{2}|Z)$", ""))


def normalise(bars: DataFrame) -> DataFrame:
    """Lower-case names, known columns only, no rows without prices."""
    low = bars.toDF(*(c.lower() for c in bars.columns))
    keep = [c for c in ("symbol", "ts", *OHLC, "volume", "spread") if c in low.columns]
    return low.select(*keep).na.drop(subset=list(OHLC))


def well_formed() -> Column:
    """high >= low, and open and close between them; NaN and null fail."""
    ok = (F.col("high") >= F.col("low")) & F.col("open").between(F.col("low"), F.col("high")) & F.col("close").between(F.col("low"), F.col("high"))
    for c in OHLC:
        ok = ok & ~F.isnan(c)
    return F.coalesce(ok, F.lit(False))


def clean_bars(bars: DataFrame) -> DataFrame:
    return normalise(bars).where(well_formed())


def rejected_bars(bars: DataFrame) -> DataFrame:
    """What `clean_bars` drops, with the reason."""
    empty = F.greatest(*(F.col(c).isNull() | F.isnan(c) for c in OHLC))
    return bars.where(~well_formed()).withColumn("reason", F.when(empty, "no price").when(F.col("high") < F.col("low"), "high below low").otherwise("price outside range"))


def decode_trendbars(rows: DataFrame, digits: int) -> DataFrame:
    """Integer delta bars (minutes, low, d_open, d_high, d_close, volume) to prices."""
    scale = float(10**digits)
    price = lambda c: ((F.col("low") + F.col(c)) / scale).alias(c[2:])
    return rows.select("symbol", F.timestamp_seconds(F.col("minutes") * 60).cast("timestamp_ntz").alias("ts"), price("d_open"), price("d_high"), (F.col("low") / scale).alias("low"), price("d_close"), F.col("volume").cast("double").alias("volume"))


def attach_spread(bid: DataFrame, ask: DataFrame) -> DataFrame:
    """`bid` bars with the spread at the open: never below 0, and 0 without an ask bar."""
    other = ask.select("symbol", "ts", F.col("open").alias("ask_open"))
    spread = F.greatest(F.round(F.coalesce("ask_open", "open") - F.col("open"), 5), F.lit(0.0))
    return bid.join(other, ["symbol", "ts"], "left").withColumn("spread", spread).drop("ask_open")


def decode_rates(rows: DataFrame, info: DataFrame) -> DataFrame:
    """Terminal rates (symbol, time, prices, tick_volume, spread in points) with `info` (symbol, point)."""
    joined = rows.join(info, "symbol")
    return joined.select("symbol", F.timestamp_seconds("time").cast("timestamp_ntz").alias("ts"), *OHLC, F.col("tick_volume").cast("double").alias("volume"), F.round(F.col("spread") * F.col("point"), 5).alias("spread"))


def write_store(bars: DataFrame, path: str) -> None:
    """Parquet by symbol and month, so that a symbol's months are read alone."""
    bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("symbol", "month").sortWithinPartitions("symbol", "month", "ts").write.partitionBy("symbol", "month").parquet(path)


def read_store(spark: SparkSession, path: str, symbols: list[str] | None = None, months: list[str] | None = None) -> DataFrame:
    bars = spark.read.parquet(path)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if months is not None:
        bars = bars.where(F.col("month").isin(months))
    return bars.drop("month")


def resample(ticks: DataFrame, seconds: int) -> DataFrame:
    """Ticks (symbol, ts, price, id) or finer bars to bars of `seconds`; empty ones don't occur."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")
    if "price" in ticks.columns:
        order = F.struct("ts", "id")
        aggs = [F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume")]
    else:
        aggs = [F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")]
    return ticks.groupBy("symbol", start.alias("bar_ts")).agg(*aggs).withColumnRenamed("bar_ts", "ts")
