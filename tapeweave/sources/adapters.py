"""The driver's tables in the shapes of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bars import resample


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))


def bars(spark: SparkSession, sf_dir: str, seconds: int = 3600) -> DataFrame:
    return resample(ticks(spark, sf_dir), seconds)


def numbered(rows: DataFrame, keys=("symbol",), name: str = "bar_idx", day=None, order=("ts",)) -> DataFrame:
    """Dense numbers from 0 by time within `keys`, without one task for a long series: days are
    counted, the small table of days is summed up, and rows are numbered by `order` within their day."""
    day = F.to_date("ts") if day is None else day
    days = rows.groupBy(*keys, day.alias("_day")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(*keys, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy(*keys, "_day").orderBy(*order)
    local = rows.withColumn("_day", day).withColumn("_local", F.row_number().over(inner) - 1)
    return local.join(starts, [*keys, "_day"]).withColumn(name, (F.col("_first") + F.col("_local")).cast("long")).drop("_day", "_first", "_local")


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = numbered(bars(spark, sf_dir))
    swap = F.col("bar_idx") % 97 == 5
    return b.withColumns({"high": F.when(swap, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(F.col("bar_idx") % 89 != 7, F.col("close"))})


TRADE_ORDER = ("exit_ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades, with the columns of `TRADE_ORDER`."""
    li = table(spark, sf_dir, "lineitem")
    pnl = F.floor(F.col("l_extendedprice") * (F.col("l_discount") - 0.05) + 0.5) / 100  # cents, half up
    return li.select(
        F.col("l_returnflag").alias("run"),
        F.when(F.col("l_linestatus") == "F", "LONG").otherwise("SHORT").alias("side"),
        F.date_sub(F.to_date("l_shipdate"), F.col("l_linenumber").cast("int") + 1).alias("fill_ts"),
        F.to_date("l_shipdate").alias("exit_ts"),
        pnl.alias("pnl_net"),
        F.when(pnl > 0, "tp").otherwise("sl").alias("exit_reason"),
        F.col("l_quantity").cast("double").alias("size"),
        *TRADE_ORDER[1:],
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as closed trades of three runs; `seq` orders the trades of a day."""
    day = Window.partitionBy("run", "exit_ts").orderBy(*TRADE_ORDER[1:])
    return _line_trades(spark, sf_dir).withColumn("seq", F.row_number().over(day)).drop(*TRADE_ORDER[1:])


def leg_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trades with `n`, their number within run and side by exit; runs and days that are null count as
    one more each, the days last."""
    run = F.coalesce(F.concat(F.lit("="), "run"), F.lit(""))
    day = F.coalesce(F.unix_date("exit_ts").cast("long"), F.lit(1 << 40))
    order = [F.col(c).asc_nulls_last() for c in TRADE_ORDER[1:]]
    rows = _line_trades(spark, sf_dir).withColumn("_run", run)
    return numbered(rows, ("_run", "side"), "n", day, order).drop("_run", *TRADE_ORDER[1:])


def equity(spark: SparkSession, sf_dir: str, start: float = 1_000_000.0) -> DataFrame:
    """Per run and exit day: `start` and the profits so far."""
    daily = trades(spark, sf_dir).groupBy("run", F.col("exit_ts").alias("ts")).agg(F.sum(F.col("pnl_net").cast("decimal(18,2)")).alias("pnl"))
    w = Window.partitionBy("run").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    idx = F.row_number().over(Window.partitionBy("run").orderBy("ts")) - 1
    return daily.select("run", idx.cast("long").alias("bar_idx"), "ts", (F.lit(start) + F.sum("pnl").over(w).cast("double")).alias("equity"))
