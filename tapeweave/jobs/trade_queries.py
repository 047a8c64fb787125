"""Queries over trades made of `lineitem` and their equity: metrics, streaks, falls; each with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, metrics, slices
from ..sources import adapters
from .bar_queries import r

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TRADES = """WITH RECURSIVE trades AS (SELECT l_returnflag AS run, CASE WHEN l_linestatus = 'F' THEN 'LONG' ELSE 'SHORT' END AS side, CAST(l_shipdate AS DATE) - (l_linenumber + 1) AS fill_ts,
  CAST(l_shipdate AS DATE) AS exit_ts, floor(l_extendedprice * (l_discount - 0.05) + 0.5) / 100 AS pnl_net, l_quantity AS size,
  row_number() OVER (PARTITION BY l_returnflag, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq FROM lineitem)"""
_EQ = f"""{_TRADES}, daily AS (SELECT run, exit_ts AS ts, sum(CAST(pnl_net AS DECIMAL(18, 2))) AS pnl FROM trades GROUP BY 1, 2),
equity AS (SELECT run, row_number() OVER w - 1 AS bar_idx, ts, 1000000.0::DOUBLE + CAST(sum(pnl) OVER w AS DOUBLE) AS equity FROM daily WINDOW w AS (PARTITION BY run ORDER BY ts)),
dd AS (SELECT *, equity - max(equity) OVER w AS dd, 100 * (equity - max(equity) OVER w) / nullif(max(equity) OVER w, 0) AS dd_pct, max(equity) OVER w AS peak FROM equity WINDOW w AS (PARTITION BY run ORDER BY bar_idx))"""


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, digits: int = 6, but=()):
    """Doubles half up by arithmetic, infinite values null."""
    out = []
    for n, kind in df.dtypes:
        c = F.col(f"`{n}`")
        out.append(r(F.when(F.abs(c) < float("inf"), c), digits).alias(n) if kind == "double" and n not in but else c)
    return df.select(*out)


_STATS = f"""count(*) AS n, count(*) FILTER (pnl_net > 0) AS wins, count(*) FILTER (pnl_net <= 0) AS losses, {r('100.0 * count(*) FILTER (pnl_net > 0) / count(*)')} AS win_rate,
{r('coalesce(avg(pnl_net) FILTER (pnl_net > 0), 0)')} AS avg_win, {r('coalesce(avg(pnl_net) FILTER (pnl_net <= 0), 0)')} AS avg_loss, {r('avg(pnl_net)')} AS expectancy,
{r('sum(CASE WHEN pnl_net > 0 THEN pnl_net ELSE 0 END) / nullif(abs(sum(CASE WHEN pnl_net <= 0 THEN pnl_net ELSE 0 END)), 0)')} AS profit_factor,
{r('abs(coalesce(avg(pnl_net) FILTER (pnl_net > 0), 0) / nullif(coalesce(avg(pnl_net) FILTER (pnl_net <= 0), 0), 0))')} AS payoff, {r('sum(pnl_net)', 2)} AS pnl,
{r("sum(CASE WHEN side = 'LONG' THEN pnl_net ELSE 0 END)", 2)} AS pnl_long, {r("sum(CASE WHEN side = 'SHORT' THEN pnl_net ELSE 0 END)", 2)} AS pnl_short"""


def _money(df, *names):
    return df.withColumns({n: r(F.col(n), 2) for n in names})


@query("a1_trade_stats", f"{_TRADES} SELECT run, {_STATS} FROM trades GROUP BY 1")
def trade_stats(spark, sf_dir):
    out = metrics.trade_stats(adapters.trades(spark, sf_dir))
    return _money(rounded(out, but=("pnl", "pnl_long", "pnl_short")), "pnl", "pnl_long", "pnl_short")


@query("a2_a3_sharpe_sortino", f"""{_TRADES}, s AS (SELECT run, exit_ts, sum(pnl_net) AS x FROM trades GROUP BY 1, 2), g AS (SELECT run, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, stddev_pop(x) FILTER (x < 0) AS d FROM s GROUP BY 1)
SELECT run, {r('CASE WHEN n >= 2 AND sd > 0 THEN m / sd * sqrt(252) ELSE 0 END')} AS sharpe, {r('CASE WHEN n >= 2 AND d > 0 THEN m / d * sqrt(252) ELSE 0 END')} AS sortino FROM g""")
def sharpe(spark, sf_dir):
    return rounded(metrics.sharpe_sortino(adapters.trades(spark, sf_dir), F.col("exit_ts")))


@query("a4_side_totals", f"{_TRADES} SELECT run, CASE WHEN grouping(side) = 1 THEN 'ALL' ELSE side END AS side, count(*) AS n, {r('sum(pnl_net)', 2)} AS pnl, {r('avg(pnl_net)')} AS mean FROM trades GROUP BY GROUPING SETS ((run), (run, side))")
def side_totals(spark, sf_dir):
    return _money(rounded(metrics.side_totals(adapters.trades(spark, sf_dir)), but=("pnl",)), "pnl")


@query("a5_by_direction", f"{_TRADES} SELECT run, side, count(*) AS n, {r('100.0 * avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r('sum(pnl_net)', 2)} AS pnl, {r('avg(pnl_net)')} AS mean, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY run)')} AS share FROM trades GROUP BY 1, 2")
def by_direction(spark, sf_dir):
    return _money(rounded(metrics.breakdown(adapters.trades(spark, sf_dir), "side"), but=("pnl",)), "pnl")


@query("a6_by_exit_reason", f"{_TRADES}, t AS (SELECT *, CASE WHEN pnl_net > 0 THEN 'tp' ELSE 'sl' END AS exit_reason FROM trades) SELECT run, exit_reason, count(*) AS n, {r('100.0 * avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r('sum(pnl_net)', 2)} AS pnl, {r('avg(pnl_net)')} AS mean, {r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY run)')} AS share FROM t GROUP BY 1, 2")
def by_reason(spark, sf_dir):
    return _money(rounded(metrics.breakdown(adapters.trades(spark, sf_dir), "exit_reason"), but=("pnl",)), "pnl")


_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@query("a7_monthly", f"{_TRADES} SELECT run, CAST(year(exit_ts) AS INTEGER) AS year, " + ", ".join(f"{r(f'coalesce(sum(pnl_net) FILTER (month(exit_ts) = {i}), 0)', 2)} AS {m}" for i, m in enumerate(_MONTHS, 1)) + " FROM trades GROUP BY 1, 2")
def monthly(spark, sf_dir):
    return rounded(metrics.monthly(adapters.trades(spark, sf_dir)), 2)


@query("a8_spread_schedule", f"""{_TRADES}, h AS (SELECT event_type AS symbol, CAST(hour(ts) AS INTEGER) AS hour, avg(event_id % 11) AS mean FROM events WHERE event_id % 11 > 0 GROUP BY 1, 2)
SELECT symbol, hour, round(mean / min(mean) OVER (PARTITION BY symbol), 3) AS factor FROM h""")
def spread_schedule(spark, sf_dir):
    t = adapters.ticks(spark, sf_dir).withColumn("spread", (F.col("id") % 11).cast("double"))
    return metrics.spread_schedule(t)


@query("a10_histogram", f"""{_TRADES}, m AS (SELECT run, min(pnl_net) AS lo, max(pnl_net) AS hi FROM trades GROUP BY 1)
SELECT run, CAST(least(floor((pnl_net - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM trades JOIN m USING (run) GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    return metrics.histogram(adapters.trades(spark, sf_dir), "pnl_net")


@query("a11_comparison", f"{_TRADES}, s AS (SELECT run, {_STATS} FROM trades GROUP BY 1) SELECT run, metric, value FROM (UNPIVOT (SELECT run, CAST(n AS DOUBLE) AS n, win_rate, expectancy, profit_factor, pnl FROM s) ON n, win_rate, expectancy, profit_factor, pnl INTO NAME metric VALUE value)")
def comparison(spark, sf_dir):
    return metrics.comparison(trade_stats(spark, sf_dir).select("run", "n", "win_rate", "expectancy", "profit_factor", "pnl"))


@query("a15_trading_days", f"{_TRADES} SELECT run, count(DISTINCT exit_ts) AS days FROM trades GROUP BY 1")
def trading_days(spark, sf_dir):
    return adapters.trades(spark, sf_dir).groupBy("run").agg(F.count_distinct("exit_ts").alias("days"))


@query("p5_filter_trades", f"{_TRADES} SELECT run, side, exit_ts, seq, pnl_net FROM trades WHERE side = 'SHORT' AND pnl_net > 0 AND run IN ('A', 'R') AND exit_ts BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def filter_trades(spark, sf_dir):
    t = adapters.trades(spark, sf_dir)
    return t.where("side = 'SHORT' AND pnl_net > 0 AND run IN ('A', 'R')").where(F.col("exit_ts").between("1997-01-01", "1997-06-30")).select("run", "side", "exit_ts", F.col("seq").cast("long").alias("seq"), "pnl_net")


@query("p6_visible_trades", f"{_TRADES} SELECT run, exit_ts, seq FROM trades WHERE fill_ts <= DATE '1996-03-10' AND exit_ts >= DATE '1996-03-01'")
def visible(spark, sf_dir):
    import datetime

    t = slices.visible(adapters.trades(spark, sf_dir), datetime.date(1996, 3, 1), datetime.date(1996, 3, 10))
    return t.select("run", "exit_ts", F.col("seq").cast("long").alias("seq"))


@query("p7_closed_trades", f"{_TRADES}, t AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'open' ELSE 'closed' END AS status, CASE WHEN seq % 7 = 0 THEN 'end_of_data' ELSE 'tp' END AS reason FROM trades) SELECT run, count(*) AS n, {r('sum(pnl_net)', 2)} AS pnl FROM t WHERE status = 'closed' AND reason <> 'end_of_data' GROUP BY 1")
def closed(spark, sf_dir):
    t = adapters.trades(spark, sf_dir).withColumns({"status": F.when(F.col("seq") % 5 == 0, "open").otherwise("closed"), "exit_reason": F.when(F.col("seq") % 7 == 0, "end_of_data").otherwise("tp")})
    return slices.really_closed(t).groupBy("run").agg(F.count("*").alias("n"), r(F.sum("pnl_net"), 2).alias("pnl"))


@query("j10_leg_pairing", f"""{_TRADES}, n AS (SELECT run, side, pnl_net, row_number() OVER (PARTITION BY run, side ORDER BY exit_ts, seq) AS n FROM trades)
SELECT a.run, count(*) AS n, {r('100.0 * avg(CASE WHEN a.pnl_net + coalesce(b.pnl_net, 0) > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {r('sum(a.pnl_net + coalesce(b.pnl_net, 0))', 2)} AS pnl
FROM n a LEFT JOIN n b ON a.run = b.run AND a.n = b.n AND b.side = 'SHORT' WHERE a.side = 'LONG' GROUP BY 1""")
def legs(spark, sf_dir):
    t = adapters.leg_trades(spark, sf_dir)
    pairs = align.pair_legs(t.where("side = 'LONG'"), t.where("side = 'SHORT'"))
    return pairs.groupBy("run").agg(F.count("*").alias("n"), r(100.0 * F.avg((F.col("combined") > 0).cast("double"))).alias("win_rate"), r(F.sum("combined"), 2).alias("pnl"))


@query("w23_drawdown", f"{_EQ} SELECT run, ts, {r('equity', 2)} AS equity, {r('peak', 2)} AS peak, {r('dd', 2)} AS dd, {r('dd_pct')} AS dd_pct FROM dd")
def drawdown(spark, sf_dir):
    d = metrics.drawdown(adapters.equity(spark, sf_dir))
    return d.select("run", "ts", *(r(F.col(c), 2).alias(c) for c in ("equity", "peak", "dd")), r(F.col("dd_pct")).alias("dd_pct"))


@query("w24_w25_equity_stats", f"""{_EQ}, i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bar_idx) - row_number() OVER (PARTITION BY run, dd < 0 ORDER BY bar_idx) AS g FROM dd),
l AS (SELECT run, coalesce(max(n) FILTER (f), 0) AS longest_dd FROM (SELECT run, dd < 0 AS f, g, count(*) AS n FROM i GROUP BY 1, 2, 3) GROUP BY 1),
a AS (SELECT run, first(equity ORDER BY bar_idx) AS f, last(equity ORDER BY bar_idx) AS final_equity, min(dd_pct) AS p, min(dd) AS d FROM dd GROUP BY 1)
SELECT run, {r('final_equity', 2)} AS final_equity, {r('p')} AS max_dd_pct, {r('d', 2)} AS max_dd, {r('100 * (final_equity - f) / f')} AS total_return, {r('CASE WHEN p = 0 THEN 0 ELSE 100 * (final_equity - f) / f / abs(p) END')} AS calmar, longest_dd FROM a JOIN l USING (run)""")
def equity_stats(spark, sf_dir):
    out = metrics.equity_stats(adapters.equity(spark, sf_dir))
    return _money(rounded(out, but=("final_equity", "max_dd")), "final_equity", "max_dd")


@query("w26_streaks", f"""{_TRADES}, i AS (SELECT run, pnl_net > 0 AS won, row_number() OVER (PARTITION BY run ORDER BY exit_ts, seq) - row_number() OVER (PARTITION BY run, pnl_net > 0 ORDER BY exit_ts, seq) AS g FROM trades),
c AS (SELECT run, won, g, count(*) AS n FROM i GROUP BY 1, 2, 3) SELECT run, max(n) FILTER (won) AS win_streak, max(n) FILTER (NOT won) AS loss_streak FROM c GROUP BY 1""")
def streaks(spark, sf_dir):
    t = adapters.trades(spark, sf_dir)
    won = metrics.longest_run(t, F.col("pnl_net") > 0, ["run"], ["exit_ts", "seq"], "win_streak", F.trunc("exit_ts", "year"))
    return won.join(metrics.longest_run(t, F.col("pnl_net") <= 0, ["run"], ["exit_ts", "seq"], "loss_streak", F.trunc("exit_ts", "year")), "run")


@query("w27_cumulative_by_direction", f"{_TRADES}, d AS (SELECT run, side, fill_ts, sum(CAST(pnl_net AS DECIMAL(18, 2))) AS p FROM trades GROUP BY 1, 2, 3) SELECT run, side, fill_ts, CAST(sum(p) OVER (PARTITION BY run, side ORDER BY fill_ts) AS DOUBLE) AS pnl FROM d")
def cumulative(spark, sf_dir):
    d = adapters.trades(spark, sf_dir).groupBy("run", "side", "fill_ts").agg(F.sum(F.col("pnl_net").cast("decimal(18,2)")).alias("p"))
    return d.select("run", "side", "fill_ts", F.sum("p").over(Window.partitionBy("run", "side").orderBy("fill_ts").rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("pnl"))


@query("w28_w29_returns_floor", f"{_EQ} SELECT run, ts, {r('(equity - lag(equity) OVER (PARTITION BY run ORDER BY bar_idx)) / nullif(lag(equity) OVER (PARTITION BY run ORDER BY bar_idx), 0)', 9)} AS ret, {r('peak * 0.9', 2)} AS floor FROM dd")
def returns_floor(spark, sf_dir):
    d = metrics.drawdown(adapters.equity(spark, sf_dir))
    before = F.lag("equity").over(Window.partitionBy("run").orderBy("bar_idx"))
    return d.select("run", "ts", r(F.try_divide(F.col("equity") - before, F.nullif(before, F.lit(0.0))), 9).alias("ret"), r(F.col("peak") * 0.9, 2).alias("floor"))


@query("w21_portfolio_equity", f"{_TRADES}, e AS (SELECT exit_ts, CASE run WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS rank, sum(CAST(pnl_net AS DECIMAL(18, 2))) AS c FROM trades GROUP BY 1, 2) SELECT exit_ts AS ts, CAST(rank AS INTEGER) AS symbol_rank, {r('1000000.0 + CAST(sum(c) OVER (ORDER BY exit_ts, rank) AS DOUBLE)', 2)} AS equity FROM e")
def portfolio_equity(spark, sf_dir):
    t = adapters.trades(spark, sf_dir).withColumn("symbol_rank", F.when(F.col("run") == "A", 0).when(F.col("run") == "N", 1).otherwise(2))
    e = t.groupBy(F.col("exit_ts").alias("ts"), "symbol_rank").agg(F.sum(F.col("pnl_net").cast("decimal(18,2)")).cast("double").alias("cash"))
    return metrics.global_equity(e, 1_000_000.0).select("ts", "symbol_rank", r(F.col("equity"), 2).alias("equity"))


@query("k3_percentiles", f"{_TRADES} SELECT run, {', '.join(f'{r(f'quantile_cont(pnl_net, {p / 100})')} AS p{p}' for p in (5, 25, 50, 75, 95))} FROM trades GROUP BY 1")
def percentiles(spark, sf_dir):
    ps = (5, 25, 50, 75, 95)
    return adapters.trades(spark, sf_dir).groupBy("run").agg(*(r(F.percentile("pnl_net", F.lit(p / 100))).alias(f"p{p}") for p in ps))


@query("s8_trade_log", f"{_TRADES} SELECT run, side, strftime(fill_ts, '%Y-%m-%dT%H:%M:%S') AS fill_time, strftime(exit_ts, '%Y-%m-%dT%H:%M:%S') AS exit_time, seq, {r('pnl_net', 2)} AS pnl_net FROM trades")
def trade_log(spark, sf_dir):
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return adapters.trades(spark, sf_dir).select("run", "side", iso("fill_ts").alias("fill_time"), iso("exit_ts").alias("exit_time"), F.col("seq").cast("long").alias("seq"), r(F.col("pnl_net"), 2).alias("pnl_net"))
