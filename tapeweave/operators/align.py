"""Joins in time that never see the future."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align_pair(a: DataFrame, b: DataFrame, fields=("open", "high", "low", "close")) -> DataFrame:
    """Bars of two instruments at the times both have: a_* and b_* columns."""
    left = a.select("ts", *(F.col(c).alias(f"a_{c}") for c in fields))
    right = b.select("ts", *(F.col(c).alias(f"b_{c}") for c in fields))
    return left.join(right, "ts")


def close_times(bars: DataFrame, keys=("symbol",), default_seconds: int = 60) -> DataFrame:
    """`bars` with close_ts: the next bar's open; for the last one its open and the last gap."""
    w = Window.partitionBy(*keys).orderBy("ts")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    last = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.coalesce(gap, F.lit(default_seconds * 1_000_000))).cast("timestamp_ntz")
    return bars.withColumn("close_ts", F.coalesce(F.lead("ts").over(w), last))


def attach_higher_timeframe(primary: DataFrame, secondary: DataFrame, fields: dict[str, str], keys=("symbol",)) -> DataFrame:
    """`primary` with the `fields` {theirs: ours} of the last bar of `secondary` closed by then.

    A secondary bar is seen from its close on. Series are cut at months; a month starts with what was
    last seen before it, so no task needs a whole history.
    """
    month = lambda c: F.date_trunc("month", c)
    closed = close_times(secondary, keys).select(*keys, F.col("close_ts").alias("_t"), F.struct(*(F.col(c).alias(n) for c, n in fields.items())).alias("_s"))
    left = primary.select(*keys, F.col("ts").alias("_t"), F.struct(*(c for c in primary.columns if c not in keys)).alias("_p"))
    both = left.withColumn("_s", F.lit(None).cast(closed.schema["_s"].dataType)).unionByName(closed.withColumn("_p", F.lit(None).cast(left.schema["_p"].dataType)))
    both = both.withColumn("_m", month("_t"))
    inner = Window.partitionBy(*keys, "_m").orderBy("_t", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_s", ignorenulls=True).over(inner)).where("_p is not null").drop("_s")
    months = both.groupBy(*keys, "_m").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_t"))).alias("_end"))
    carry = Window.partitionBy(*keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select(*keys, "_m", F.last("_end", ignorenulls=True).over(carry).alias("_before"))
    out = seen.join(months, [*keys, "_m"]).withColumn("_x", F.coalesce("_last", "_before"))
    return out.select(*keys, "_p.*", *(F.col(f"_x.{n}").alias(n) for n in fields.values()))


def effective_spread(bars: DataFrame, base: float, schedule: dict[int, float]) -> DataFrame:
    """`bars` with `spread`: base times the factor of the latest scheduled hour, round midnight."""
    if not base or not schedule:
        return bars.withColumn("spread", F.lit(float(base)))
    hours = sorted(schedule)
    factor = [schedule[max((h for h in hours if h <= hour), default=hours[-1])] for hour in range(24)]
    return bars.withColumn("spread", F.element_at(F.array(*(F.lit(float(f)) for f in factor)), F.hour("ts") + 1) * base)


def pair_legs(a: DataFrame, b: DataFrame, keys=("run",)) -> DataFrame:
    """The i-th closed trade (n) of leg a with the i-th of leg b; a missing b counts 0."""
    left = a.select(*keys, "n", F.col("pnl_net").alias("pnl_a"))
    right = b.select(*keys, "n", F.col("pnl_net").alias("pnl_b"))
    return left.join(right, [*keys, "n"], "left").withColumn("pnl_b", F.coalesce("pnl_b", F.lit(0.0))).withColumn("combined", F.col("pnl_a") + F.col("pnl_b"))


def symbol_ranks(bars: DataFrame) -> DataFrame:
    """(symbol, symbol_rank) of the symbols of `bars`, by name: one small row each."""
    names = bars.select("symbol").distinct()
    return names.select("symbol", (F.row_number().over(Window.orderBy("symbol")) - 1).alias("symbol_rank"))


def merge_symbols(bars: DataFrame, ranks: DataFrame) -> DataFrame:
    """Bars of a portfolio with the symbol_rank of `ranks` (symbol, symbol_rank); (ts, symbol_rank) is the
    order of events. A symbol without a rank is an error."""
    rank = F.when(F.col("symbol_rank").isNull(), F.raise_error(F.concat(F.lit("no rank for symbol "), F.coalesce("symbol", F.lit("null"))))).otherwise(F.col("symbol_rank"))
    return bars.join(ranks, "symbol", "left").withColumn("symbol_rank", rank.cast("int"))
