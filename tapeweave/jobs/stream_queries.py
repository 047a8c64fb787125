"""Stream jobs run to the end of the files at hand (availableNow), read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters, tables
from ..streaming import bars as streams
from .bar_queries import _BARS, _TICKS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{tables.shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file events.parquet as a stream of its folder."""
    schema = adapters.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _run(out: DataFrame, mode: str = "append") -> DataFrame:
    spark = out.sparkSession
    at = _folder(spark)
    out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")



def bar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _run(streams.bar_stream(streams.tick_stream(_source(spark, sf_dir))))
    return done.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


QUERIES["r1_bar_stream"] = bar_stream
# a bar is complete once the last tick less ten minutes has passed its end
SQL["r1_bar_stream"] = f"WITH {_TICKS}, {_BARS} SELECT symbol, ts, open, high, low, close, volume FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"


def monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = streams.tick_stream(_source(spark, sf_dir))
    found = _run(streams.loss_monitor(ticks.select(F.col("symbol").alias("account"), "ts", F.col("price").alias("equity")), 5.0, 100.0))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


QUERIES["r2_loss_monitor"] = monitor
SQL["r2_loss_monitor"] = """WITH d AS (SELECT event_type AS account, ts, value AS equity, first(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts) AS day_start FROM events)
SELECT account, ts, equity, day_start FROM d WHERE equity - day_start <= -5 QUALIFY row_number() OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts) = 1"""


def pair_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = streams.tick_stream(_source(spark, sf_dir))
    shape = lambda s: ticks.where(F.col("symbol") == s).select(F.date_trunc("minute", "ts").alias("ts"), F.col("price").alias("close"))
    return _run(streams.pair_stream(shape("click"), shape("view"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


QUERIES["r3_pair_stream"] = pair_stream
SQL["r3_pair_stream"] = "SELECT date_trunc('minute', a.ts) AS ts, a.value AS a_close, b.value AS b_close FROM events a JOIN events b ON date_trunc('minute', a.ts) = date_trunc('minute', b.ts) WHERE a.event_type = 'click' AND b.event_type = 'view'"
