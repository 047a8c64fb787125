"""Trade and equity metrics: one pass each, by any keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chains

YEAR = math.sqrt(252)


def _ratio(a: Column, b: Column) -> Column:
    """a / b; infinite where b is 0 and a is not null."""
    return F.when(b == 0, F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def _stats(pnl: Column, side: Column | None) -> list[Column]:
    won = pnl > 0
    gain, loss = F.sum(F.when(won, pnl).otherwise(0.0)), F.sum(F.when(~won, pnl).otherwise(0.0))
    avg_win, avg_loss = F.coalesce(F.avg(F.when(won, pnl)), F.lit(0.0)), F.coalesce(F.avg(F.when(~won, pnl)), F.lit(0.0))
    out = [
        F.count("*").alias("n"),
        F.count_if(won).alias("wins"),
        F.count_if(~won).alias("losses"),
        F.try_divide(100.0 * F.count_if(won), F.count("*")).alias("win_rate"),
        avg_win.alias("avg_win"),
        avg_loss.alias("avg_loss"),
        F.avg(pnl).alias("expectancy"),
        _ratio(gain, F.abs(loss)).alias("profit_factor"),
        F.abs(_ratio(avg_win, avg_loss)).alias("payoff"),
        F.sum(pnl).alias("pnl"),
    ]
    if side is not None:
        out += [F.sum(F.when(side == "LONG", pnl).otherwise(0.0)).alias("pnl_long"), F.sum(F.when(side == "SHORT", pnl).otherwise(0.0)).alias("pnl_short")]
    return out


def trade_stats(trades: DataFrame, keys=("run",), runs: DataFrame | None = None) -> DataFrame:
    """Counts, rates and totals by keys; with `runs` also zero rows for runs without trades."""
    out = trades.groupBy(*keys).agg(*_stats(F.col("pnl_net"), F.col("side")))
    if runs is not None:
        out = runs.select(*keys).distinct().join(out, [*keys], "left").na.fill(0)
    return out


def side_totals(trades: DataFrame, key: str = "run") -> DataFrame:
    """Totals of each run and of each of its sides (`side` ALL) in one pass over grouping sets."""
    sets = [[F.col(key)], [F.col(key), F.col("side")]]
    grouped = trades.groupingSets(sets, key, "side").agg(F.count("*").alias("n"), F.sum("pnl_net").alias("pnl"), F.avg("pnl_net").alias("mean"), F.grouping("side").alias("_all"))
    return grouped.withColumn("side", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("side"))).drop("_all")


def breakdown(trades: DataFrame, by: str, keys=("run",)) -> DataFrame:
    """Count, win rate, sum and mean by a column, and its share of the run's trades."""
    g = trades.groupBy(*keys, by).agg(F.count("*").alias("n"), (100.0 * F.avg((F.col("pnl_net") > 0).cast("double"))).alias("win_rate"), F.sum("pnl_net").alias("pnl"), F.avg("pnl_net").alias("mean"))
    return g.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def sharpe_sortino(trades: DataFrame, bucket: Column, keys=("run",)) -> DataFrame:
    """From sums by bucket (only buckets with trades): mean / deviation over the year's root; 0 if undefined."""
    sums = trades.groupBy(*keys, bucket.alias("_b")).agg(F.sum("pnl_net").alias("x"))
    mean, sd, down = F.avg("x"), F.stddev_pop("x"), F.stddev_pop(F.when(F.col("x") < 0, F.col("x")))
    g = sums.groupBy(*keys).agg(F.count("*").alias("_n"), mean.alias("_m"), sd.alias("_s"), down.alias("_d"))
    rate = lambda d: F.when((F.col("_n") >= 2) & (F.col(d) > 0), F.col("_m") / F.col(d) * YEAR).otherwise(0.0)
    return g.select(*keys, rate("_s").alias("sharpe"), rate("_d").alias("sortino"))


def monthly(trades: DataFrame, keys=("run",)) -> DataFrame:
    """Profit by year, one column a month, 0 where none."""
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    rows = trades.withColumns({"year": F.year("exit_ts"), "_month": F.date_format("exit_ts", "MMM")})
    return rows.groupBy(*keys, "year").pivot("_month", months).agg(F.sum("pnl_net")).na.fill(0.0, months)


def spread_schedule(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """Mean spread by UTC hour over the smallest such mean; rows without a positive spread don't count."""
    hours = bars.where(F.col("spread") > 0).groupBy(*keys, F.hour("ts").alias("hour")).agg(F.avg("spread").alias("mean"))
    return hours.withColumn("factor", F.round(F.col("mean") / F.min("mean").over(Window.partitionBy(*keys)), 3)).drop("mean")


def histogram(rows: DataFrame, column: str, bins: int = 50, keys=("run",)) -> DataFrame:
    """Counts in bins of equal width between least and greatest; the greatest is in the last."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return rows.join(ends, [*keys]).groupBy(*keys, place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def drawdown(equity: DataFrame, keys=("run",), order: str = "bar_idx", chunk: int = chains.CHUNK) -> DataFrame:
    """Peak so far, fall from it in money (dd) and percent (dd_pct). `order`: whole numbers, cut every `chunk`."""
    rows = chains.running(equity, {"peak": (F.col("equity"), "max")}, keys, order, chunk)
    return rows.withColumns({"dd": F.col("equity") - F.col("peak"), "dd_pct": 100 * F.try_divide(F.col("equity") - F.col("peak"), F.col("peak"))})


def longest_run(rows: DataFrame, flag: Column, keys, order, name: str, cut: Column) -> DataFrame:
    """Most consecutive rows for which `flag` holds, by keys (0 if never).

    `cut`, which never falls in `order`, cuts each series in parts. A part comes to four numbers: its rows, the runs at
    its start and end, its longest run; those of a series, one a part, are merged in order.
    """
    part = [*keys, "_part"]
    marked = rows.select(*keys, cut.alias("_part"), F.coalesce(flag, F.lit(False)).alias("_f"), *(F.col(c) if isinstance(c, str) else c for c in order))
    w = Window.partitionBy(*part).orderBy(*order)
    same = Window.partitionBy(*part, "_f").orderBy(*order)
    islands = marked.withColumn("_i", F.row_number().over(w)).withColumn("_g", F.col("_i") - F.row_number().over(same))
    sizes = islands.groupBy(*part, "_f", "_g").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"), F.max("_i").alias("_last"))
    sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy(*part)))
    on = lambda c: F.coalesce(F.max(F.when(F.col("_f") & c, F.col("_n"))), F.lit(0).cast("long"))
    parts = sizes.groupBy(*part).agg(F.max("_all").alias("n"), on(F.col("_first") == 1).alias("head"), on(F.col("_last") == F.col("_all")).alias("tail"), on(F.lit(True)).alias("most"))
    zero = F.struct(F.lit(0).cast("long").alias("tail"), F.lit(0).cast("long").alias("most"))

    def merged(a: Column, b: Column) -> Column:
        joined = a["tail"] + b["head"]
        return F.struct(F.when(b["tail"] == b["n"], joined).otherwise(b["tail"]).alias("tail"), F.greatest(a["most"], joined, b["most"]).alias("most"))

    listed = F.array_sort(F.collect_list(F.struct("_part", "n", "head", "tail", "most")))
    return parts.groupBy(*keys).agg(F.aggregate(listed, zero, merged)["most"].alias(name))


def equity_stats(equity: DataFrame, keys=("run",), order: str = "bar_idx", chunk: int = chains.CHUNK) -> DataFrame:
    """Final equity, total return %, deepest fall in % and money, calmar and the longest fall in bars."""
    dd = drawdown(equity, keys, order, chunk)
    g = dd.groupBy(*keys).agg(F.min_by("equity", order).alias("_first"), F.max_by("equity", order).alias("final_equity"), F.min("dd_pct").alias("max_dd_pct"), F.min("dd").alias("max_dd"))
    ret = 100 * F.try_divide(F.col("final_equity") - F.col("_first"), F.col("_first"))
    g = g.withColumn("total_return", ret).withColumn("calmar", F.when(F.col("max_dd_pct") == 0, 0.0).otherwise(F.try_divide(F.col("total_return"), F.abs("max_dd_pct"))))
    return g.drop("_first").join(longest_run(dd, F.col("dd") < 0, keys, [order], "longest_dd", F.floor(F.col(order) / chunk)), [*keys])


def equity_curve(bars: DataFrame, trades: DataFrame, start: float, keys=("symbol",), chunk: int = chains.CHUNK) -> DataFrame:
    """Realised equity at each bar: `start`, less half commissions at fills, plus pnl_net at exits."""
    entry = trades.select(*keys, F.col("fill_bar").alias("bar_idx"), (-F.col("commission") / 2).alias("cash"))
    exits = trades.select(*keys, F.col("exit_bar").alias("bar_idx"), F.col("pnl_net").alias("cash"))
    cash = entry.unionByName(exits).groupBy(*keys, "bar_idx").agg(F.sum("cash").alias("cash"))
    rows = bars.select(*keys, "bar_idx", "ts").join(cash, [*keys, "bar_idx"], "left")
    return chains.running(rows, {"_won": (F.coalesce("cash", F.lit(0.0)), "sum")}, keys, chunk=chunk).select(*keys, "bar_idx", "ts", (F.lit(float(start)) + F.col("_won")).alias("equity"))


def global_equity(events: DataFrame, start: float) -> DataFrame:
    """Equity over one long series of cash events (ts, symbol_rank, cash) without one long task:
    days are summed first, the small table of days is added up, rows are added up within their day."""
    day = F.to_date("ts")
    days = events.groupBy(day.alias("_day")).agg(F.sum("cash").alias("_sum"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("_day", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_first"))
    inner = Window.partitionBy("_day").orderBy("ts", "symbol_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_day", day).withColumn("_run", F.sum("cash").over(inner)).join(starts, "_day")
    return rows.withColumn("equity", F.lit(float(start)) + F.col("_first") + F.col("_run")).drop("_day", "_run", "_first")


def floating(bars: DataFrame, trades: DataFrame, keys=("symbol",), chunk: int = chains.CHUNK) -> DataFrame:
    """Floating profit of open trades at each close: close * open quantity - its cost, both running
    sums of opening and closing events, so trades are never paired with the bars they last."""
    sign = F.when(F.col("side") == "LONG", F.col("size")).otherwise(-F.col("size"))
    opened = trades.select(*keys, F.col("fill_bar").alias("bar_idx"), sign.alias("q"), (sign * F.col("fill_price")).alias("c"))
    closed = trades.select(*keys, F.col("exit_bar").alias("bar_idx"), (-sign).alias("q"), (-sign * F.col("fill_price")).alias("c"))
    events = opened.unionByName(closed).groupBy(*keys, "bar_idx").agg(F.sum("q").alias("q"), F.sum("c").alias("c"))
    rows = bars.select(*keys, "bar_idx", "ts", "close").join(events, [*keys, "bar_idx"], "left")
    rows = chains.running(rows, {f"_{x}": (F.coalesce(x, F.lit(0.0)), "sum") for x in "qc"}, keys, chunk=chunk)
    return rows.select(*keys, "bar_idx", "ts", (F.col("close") * F.col("_q") - F.col("_c")).alias("floating"))


def comparison(stats: DataFrame, key: str = "run") -> DataFrame:
    """(metric, run, value) of a table of one row a run."""
    names = [c for c in stats.columns if c != key]
    return stats.select(key, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(key, names, "metric", "value")


def trade_log(trades: DataFrame, bars: DataFrame, keys=("symbol",)) -> DataFrame:
    """The table of trades that people read: bar numbers and ISO times of order, fill and exit, prices to
    four digits, money to two."""
    placed = bars.select(*keys, F.col("bar_idx").alias("placed_bar"), F.col("ts").alias("placed_ts"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c.replace("_ts", "_time"))
    up = lambda c, d: (F.floor(F.col(c) * 10**d + 0.5) / 10**d).alias(c)
    prices, money = ("fill_price", "exit_price", "sl", "tp"), ("pnl_gross", "pnl_net")
    rows = trades.join(placed, [*keys, "placed_bar"])
    return rows.select(*keys, "placed_bar", "fill_bar", "exit_bar", *(iso(c) for c in ("placed_ts", "fill_ts", "exit_ts")), "side", "exit_reason", *(up(c, 4) for c in prices), *(up(c, 2) for c in money))
