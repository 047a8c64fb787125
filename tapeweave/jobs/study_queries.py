"""Queries over the studies: fills, exits, backtests, sweeps, bootstrap, account rules, pairs."""

from __future__ import annotations

import dataclasses
import datetime
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import recursive as rec
from ..functions import rolling as roll
from ..operators import align, exits, metrics, quality
from ..operators.exits import Costs, Sizing
from ..sources import adapters, tables
from . import studies
from .bar_queries import WITH, base, r, scan_sql
from .trade_queries import _EQ, _TRADES, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
COSTS = Costs(slippage=0.01, spread=0.02, schedule={0: 1.5, 8: 1.0, 20: 2.0}, commission=0.4, commission_pct=0.001)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- fills, exits, trades ------------------------------------------------------------------------

_TRX = "x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"
_LAGS = "l AS (SELECT *, lag(f) OVER w AS f1, lag(s) OVER w AS s1, lead(open) OVER w AS next_open, lead(ts) OVER w AS next_ts FROM atr_t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"


def _signals(k: str = "2.0", rr: str = "1.5", warmup: int = 50, name: str = "sig") -> str:
    """CTEs of the cross signals; k and rr may be columns of the bars."""
    return f"""{_LAGS}, sides AS (SELECT *, CASE WHEN f1 <= s1 AND f > s THEN 'LONG' WHEN f1 >= s1 AND f < s THEN 'SHORT' END AS side FROM l WHERE bar_idx >= {warmup} AND atr IS NOT NULL),
{name} AS (SELECT symbol, bar_idx AS p, side, next_open AS raw_fill, next_ts AS fill_ts, bar_idx + 1 AS fb, close AS placed_close, ts AS placed_ts, close - CASE side WHEN 'LONG' THEN 1 ELSE -1 END * {k} * atr AS sl, close + CASE side WHEN 'LONG' THEN 1 ELSE -1 END * {k} * {rr} * atr AS tp FROM sides WHERE side IS NOT NULL)"""


_EXITS = """touch AS (SELECT g.symbol, g.p, min(b.bar_idx) AS xb FROM sig g JOIN bars b ON g.symbol = b.symbol AND b.bar_idx > g.fb
  AND CASE WHEN side = 'LONG' THEN b.low <= sl OR b.high >= tp ELSE b.high >= sl OR b.low <= tp END GROUP BY 1, 2),
ends AS (SELECT symbol, max(bar_idx) AS e FROM bars GROUP BY 1),
ex AS (SELECT g.*, coalesce(t.xb, ends.e) AS xb, t.xb IS NOT NULL AS hit, b.ts AS exit_ts, b.open AS bo, b.high AS bh, b.low AS bl, b.close AS bc FROM sig g JOIN ends ON g.symbol = ends.symbol LEFT JOIN touch t ON g.symbol = t.symbol AND g.p = t.p
  JOIN bars b ON b.symbol = g.symbol AND b.bar_idx = coalesce(t.xb, ends.e) WHERE g.raw_fill IS NOT NULL),
out AS (SELECT *, CASE WHEN NOT hit THEN 'end_of_data' WHEN side = 'LONG' THEN CASE WHEN bo <= sl THEN 'sl' WHEN bo >= tp THEN 'tp' WHEN bl <= sl THEN 'sl' ELSE 'tp' END
  ELSE CASE WHEN bo >= sl THEN 'sl' WHEN bo <= tp THEN 'tp' WHEN bh >= sl THEN 'sl' ELSE 'tp' END END AS reason,
  CASE WHEN NOT hit THEN bc WHEN side = 'LONG' THEN CASE WHEN bo <= sl OR bo >= tp THEN bo WHEN bl <= sl THEN sl ELSE tp END ELSE CASE WHEN bo >= sl OR bo <= tp THEN bo WHEN bh >= sl THEN sl ELSE tp END END AS raw_exit FROM ex)"""
_SPREAD = "0.02 * CASE WHEN hour({t}) >= 20 THEN 2.0 WHEN hour({t}) >= 8 THEN 1.0 ELSE 1.5 END::DOUBLE"
_PICK = """nxt AS (SELECT o.*, (SELECT min(q.p) FROM out q WHERE q.symbol = o.symbol AND q.p > o.xb) AS n FROM out o),
pick AS (SELECT symbol, min(p) AS p FROM nxt GROUP BY 1 UNION ALL SELECT n.symbol, n.n FROM pick k JOIN nxt n ON n.symbol = k.symbol AND n.p = k.p WHERE n.n IS NOT NULL)"""
_CHOSEN = f"""{_PICK},
done AS (SELECT o.*, raw_fill + 0.01 + CASE WHEN side = 'LONG' THEN {_SPREAD.format(t='fill_ts')} ELSE 0 END AS fill_price, raw_exit + CASE WHEN side = 'LONG' THEN 0 ELSE {_SPREAD.format(t='exit_ts')} END AS exit_price FROM out o JOIN pick USING (symbol, p)),
net AS (SELECT *, CASE WHEN side = 'LONG' THEN exit_price - fill_price ELSE fill_price - exit_price END AS gross, CASE WHEN side = 'LONG' THEN exit_price - fill_price ELSE fill_price - exit_price END - 0.401 / 2 AS pnl_net FROM done)"""
#: The same without costs.
_PLAIN = f"{_PICK}, net AS (SELECT o.*, CASE WHEN side = 'LONG' THEN raw_exit - raw_fill ELSE raw_fill - raw_exit END AS pnl_net FROM out o JOIN pick USING (symbol, p))"


def _scans(bars: str, fast: str = "10", slow: str = "30") -> str:
    """CTEs of the features; fast and slow may be columns of the bars."""
    return f"{bars}, {_TRX}, {scan_sql('f', 'x', 'close', f'2.0/({fast} + 1)')}, {scan_sql('s', 'f_t', 'close', f'2.0/({slow} + 1)')}, {scan_sql('atr', 's_t', 'tr', '1.0/14')}"


_FEATS = _scans(WITH)
_SIGNALS = _signals()
_CROSS = f"{_FEATS}, {_SIGNALS}, {_EXITS}"
#: The bars of the tables under another name, so that slices of them can be `bars`.
_ALL = WITH.replace("\nbars AS (", "\nall_bars AS (")
_GRID = "grid(combo_id, k, rr) AS (VALUES (0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE), (1, 1.0, 1.5), (2, 2.0, 1.0), (3, 2.0, 1.5), (4, 3.0, 1.0), (5, 3.0, 1.5))"


def _stats(keys: str) -> str:
    won, lost = "FILTER (pnl_net > 0)", "FILTER (NOT pnl_net > 0)"
    win, loss, gain, cost = f"coalesce(avg(pnl_net) {won}, 0)", f"coalesce(avg(pnl_net) {lost}, 0)", f"coalesce(sum(pnl_net) {won}, 0)", f"coalesce(sum(pnl_net) {lost}, 0)"
    sides = ", ".join(f"{r(f"coalesce(sum(pnl_net) FILTER (side = '{x}'), 0)")} AS pnl_{x.lower()}" for x in ("LONG", "SHORT"))
    return f"""{keys}, count(*) AS n, count(*) {won} AS wins, count(*) {lost} AS losses, {r(f'100.0 * count(*) {won} / count(*)')} AS win_rate, {r(win)} AS avg_win, {r(loss)} AS avg_loss,
{r('avg(pnl_net)')} AS expectancy, {r(f'{gain} / nullif(abs({cost}), 0)')} AS profit_factor, {r(f'abs({win} / nullif({loss}, 0))')} AS payoff, {r('sum(pnl_net)')} AS pnl, {sides}"""


def _feats(spark, sf_dir):
    return studies.features(base(spark, sf_dir), chunk=128)


def _resolved(spark, sf_dir):
    f = _feats(spark, sf_dir)
    return exits.resolve_exits(exits.resolve_fills(studies.cross_signals(f), f), f, block=32)


@query("g1_cross_signals", f"{_FEATS}, {_SIGNALS} SELECT symbol, p AS bar_idx, side, {r('sl')} AS sl, {r('tp')} AS tp FROM sig")
def cross_signals(spark, sf_dir):
    return rounded(studies.cross_signals(_feats(spark, sf_dir)).select("symbol", "bar_idx", "side", "sl", "tp"))


@query("j5_first_touch_exits", f"{_CROSS} SELECT symbol, p AS placed_bar, side, xb AS exit_bar, reason AS exit_reason, {r('raw_exit')} AS raw_exit FROM out")
def first_touch(spark, sf_dir):
    return rounded(_resolved(spark, sf_dir).where("status = 'filled'").select("symbol", "placed_bar", "side", "exit_bar", "exit_reason", "raw_exit"))


_LIMITS = "sig AS (SELECT symbol, bar_idx AS p, CASE WHEN close < open THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN close < open THEN close * 0.7 ELSE close * 1.4 END AS lp, CASE WHEN close < open THEN close * 0.3 ELSE close * 2.5 END AS sl, CASE WHEN close < open THEN close * 1.5 ELSE close * 0.5 END AS tp FROM bars)"
_LOOKS = """looks AS (SELECT g.*, b.bar_idx AS j, b.ts AS jt, CASE WHEN side = 'LONG' THEN least(b.open, lp) ELSE greatest(b.open, lp) END AS fill, CASE WHEN side = 'LONG' THEN b.low <= lp ELSE b.high >= lp END AS hit FROM sig g LEFT JOIN bars b ON g.symbol = b.symbol AND b.bar_idx BETWEEN p + 1 AND p + 4),
fills AS (SELECT symbol, p, side, any_value(sl) AS sl, any_value(tp) AS tp, min(j) FILTER (hit) AS fb, arg_min(fill, j) FILTER (hit) AS raw_fill, arg_min(jt, j) FILTER (hit) AS fill_ts, CASE WHEN count(*) FILTER (hit) > 0 THEN 'filled' WHEN max(j) >= p + 4 THEN 'expired' ELSE 'pending' END AS status FROM looks GROUP BY 1, 2, 3)"""


def _limits(spark, sf_dir):
    """A limit order at every bar: a long one below bars that fell, a short one above the others."""
    b = base(spark, sf_dir)
    long, c = F.col("close") < F.col("open"), F.col("close")
    of = lambda a, z: F.when(long, c * a).otherwise(c * z)
    s = b.select("symbol", "bar_idx", F.when(long, "LONG").otherwise("SHORT").alias("side"), F.lit("limit").alias("order_type"), of(0.7, 1.4).alias("limit_price"), F.lit(4).alias("expiry"), F.col("bar_idx").alias("signal_id"), of(0.3, 2.5).alias("sl"), of(1.5, 0.5).alias("tp"), F.lit(1.0).alias("size"))
    return s, b


@query("j4_t6_limit_fills", f"{WITH}, {_LIMITS}, {_LOOKS} SELECT symbol, p AS placed_bar, side, fb AS fill_bar, {r('raw_fill')} AS raw_fill, status FROM fills")
def limit_fills(spark, sf_dir):
    s, b = _limits(spark, sf_dir)
    return rounded(exits.resolve_fills(s, b).select("symbol", "placed_bar", "side", "fill_bar", "raw_fill", "status"))


@query("x1_t3_t6_limit_orders", f"""{WITH}, {_LIMITS.replace("sig AS", "asked AS")}, {_LOOKS.replace("sig g", "asked g")}, sig AS (SELECT * FROM fills WHERE status = 'filled'), {_EXITS},
held AS (SELECT f.symbol, f.p, f.side, f.status, f.fb, o.xb, o.reason, CASE f.status WHEN 'filled' THEN o.xb WHEN 'expired' THEN f.p + 4 END AS free FROM fills f LEFT JOIN out o ON o.symbol = f.symbol AND o.p = f.p),
nxt AS (SELECT h.*, (SELECT min(q.p) FROM held q WHERE q.symbol = h.symbol AND q.p > h.free) AS n FROM held h),
pick AS (SELECT symbol, min(p) AS p FROM nxt GROUP BY 1 UNION ALL SELECT n.symbol, n.n FROM pick k JOIN nxt n ON n.symbol = k.symbol AND n.p = k.p WHERE n.n IS NOT NULL)
SELECT symbol, p AS placed_bar, side, status, fb AS fill_bar, xb AS exit_bar, reason AS exit_reason FROM held JOIN pick USING (symbol, p)""")
def limit_orders(spark, sf_dir):
    s, b = _limits(spark, sf_dir)
    return studies.orders(b, s).select("symbol", "placed_bar", "side", "status", "fill_bar", "exit_bar", "exit_reason")


def _traded(spark, sf_dir):
    f = _feats(spark, sf_dir)
    return studies.backtest(f, studies.cross_signals(f), COSTS), f


@query("x1_backtest_trades", f"{_CROSS}, {_CHOSEN} SELECT symbol, p AS placed_bar, fb AS fill_bar, xb AS exit_bar, side, reason AS exit_reason, {r('fill_price')} AS fill_price, {r('exit_price')} AS exit_price, {r('gross')} AS pnl_gross, {r('pnl_net')} AS pnl_net FROM net")
def backtest_trades(spark, sf_dir):
    t, _ = _traded(spark, sf_dir)
    return rounded(t.select("symbol", "placed_bar", "fill_bar", "exit_bar", "side", "exit_reason", "fill_price", "exit_price", "pnl_gross", "pnl_net"))


@query("x1_backtest_metrics", f"{_CROSS}, {_CHOSEN} SELECT symbol, count(*) AS n, count(*) FILTER (pnl_net > 0) AS wins, {r('sum(pnl_net)', 4)} AS pnl, {r('avg(pnl_net)')} AS expectancy FROM net WHERE reason <> 'end_of_data' GROUP BY 1")
def backtest_metrics(spark, sf_dir):
    t, _ = _traded(spark, sf_dir)
    m = metrics.trade_stats(t.where("exit_reason <> 'end_of_data'"), ("symbol",))
    return m.select("symbol", "n", "wins", r(F.col("pnl"), 4).alias("pnl"), r(F.col("expectancy")).alias("expectancy"))


@query("w20_equity_curve", f"""{_CROSS}, {_CHOSEN}, cash AS (SELECT symbol, b, sum(c) AS c FROM (SELECT symbol, fb AS b, -0.401 / 2 AS c FROM net UNION ALL SELECT symbol, xb, pnl_net FROM net) GROUP BY 1, 2)
SELECT b.symbol, b.bar_idx, {r('10000 + sum(coalesce(c, 0)) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx)', 4)} AS equity FROM bars b LEFT JOIN cash ON b.symbol = cash.symbol AND b.bar_idx = cash.b""")
def equity_curve(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    return metrics.equity_curve(f, t, 10_000.0).select("symbol", "bar_idx", r(F.col("equity"), 4).alias("equity"))


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


@query("s8_backtest_log", f"""{_CROSS}, {_CHOSEN} SELECT symbol, p AS placed_bar, fb AS fill_bar, xb AS exit_bar, {_ISO.format('placed_ts')} AS placed_time, {_ISO.format('fill_ts')} AS fill_time, {_ISO.format('exit_ts')} AS exit_time, side, reason AS exit_reason,
{r('fill_price', 4)} AS fill_price, {r('exit_price', 4)} AS exit_price, {r('sl', 4)} AS sl, {r('tp', 4)} AS tp, {r('gross', 2)} AS pnl_gross, {r('pnl_net', 2)} AS pnl_net FROM net""")
def backtest_log(spark, sf_dir):
    """The trade log of a backtest, written as CSV and read back."""
    path = f"{tables.shared_dir(spark)}/tapeweave/log-{uuid.uuid4().hex}"
    t, f = _traded(spark, sf_dir)
    log = metrics.trade_log(t, f)
    log.write.option("header", True).csv(path)
    return spark.read.option("header", True).schema(log.schema).csv(path)


@query("g1_once_a_direction", f"""{_CROSS}, o AS (SELECT * FROM out), pick AS (SELECT symbol, min(p) AS p, arg_min(side, p) AS last FROM o GROUP BY 1
UNION ALL SELECT q.symbol, q.p, q.side FROM pick k JOIN o c ON c.symbol = k.symbol AND c.p = k.p JOIN o q ON q.symbol = k.symbol AND q.p = (SELECT min(x.p) FROM o x WHERE x.symbol = c.symbol AND x.p > c.xb AND x.side <> c.side))
SELECT symbol, p AS placed_bar, side, xb AS exit_bar FROM o JOIN pick USING (symbol, p)""")
def once_a_direction(spark, sf_dir):
    f = _feats(spark, sf_dir)
    t = studies.orders(f, studies.cross_signals(f), COSTS, once_a_direction=True).where("status = 'filled'")
    return t.select("symbol", "placed_bar", "side", "exit_bar")


@query("t1_atr_slippage", f"{_CROSS} SELECT g.symbol, g.p AS placed_bar, {r('g.raw_fill + 0.1 * l.atr')} AS fill_price FROM sig g JOIN l ON l.symbol = g.symbol AND l.bar_idx = g.p WHERE g.raw_fill IS NOT NULL")
def atr_slippage(spark, sf_dir):
    f = _feats(spark, sf_dir)
    s = studies.cross_signals(f).join(f.select("symbol", "bar_idx", "atr"), ["symbol", "bar_idx"])
    t = exits.priced(exits.resolve_exits(exits.resolve_fills(s, f), f), Costs(slippage_atr=0.1)).where("status = 'filled'")
    return rounded(t.select("symbol", "placed_bar", "fill_price"))


@query("t5_inverse_price", f"""{_CROSS}, {_CHOSEN} SELECT symbol, p AS placed_bar, {r('CASE WHEN exit_price > 0 THEN gross / exit_price ELSE gross END')} AS pnl_gross, {r('CASE WHEN exit_price > 0 THEN gross / exit_price ELSE gross END - 0.401 / 2')} AS pnl_net FROM net""")
def inverse_price(spark, sf_dir):
    """Profit in the quote currency turned into the account's at the exit price."""
    f = _feats(spark, sf_dir)
    return rounded(studies.backtest(f, studies.cross_signals(f), dataclasses.replace(COSTS, inverse_price=True)).select("symbol", "placed_bar", "pnl_gross", "pnl_net"))


@query("t8_floating_pnl", f"""{_CROSS}, {_CHOSEN} SELECT b.symbol, b.bar_idx, {r("coalesce(sum(CASE WHEN side = 'LONG' THEN b.close - fill_price ELSE fill_price - b.close END), 0)", 4)} AS floating
FROM bars b LEFT JOIN net n ON n.symbol = b.symbol AND b.bar_idx >= n.fb AND b.bar_idx < n.xb GROUP BY 1, 2""")
def floating(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    return metrics.floating(f, t).select("symbol", "bar_idx", r(F.col("floating"), 4).alias("floating"))


@query("q2_trade_invariants", f"""{_CROSS}, {_CHOSEN}, t AS (SELECT symbol, p, fb, xb, reason FROM net UNION ALL SELECT symbol || '|broken', p, CASE WHEN side = 'LONG' THEN p ELSE fb END, CASE WHEN side = 'LONG' THEN xb ELSE fb - 1 END, 'sl' FROM net),
v AS (SELECT *, lag(xb) OVER (PARTITION BY symbol ORDER BY fb, xb) AS busy FROM t)
SELECT symbol, p AS placed_bar, CASE WHEN p >= fb THEN 'filled before placed' WHEN fb > xb OR fb = xb AND reason <> 'end_of_data' THEN 'closed before filled' WHEN busy > fb THEN 'overlap' END AS violation
FROM v WHERE p >= fb OR fb > xb OR fb = xb AND reason <> 'end_of_data' OR busy > fb""")
def invariants(spark, sf_dir):
    # the trades of the backtest, which break no rule, and the same ones broken, each of which must be found
    t = _traded(spark, sf_dir)[0].select("symbol", "side", "placed_bar", "fill_bar", "exit_bar", "exit_reason")
    long = F.col("side") == "LONG"
    broken = t.select(F.concat("symbol", F.lit("|broken")).alias("symbol"), "side", "placed_bar", F.when(long, F.col("placed_bar")).otherwise(F.col("fill_bar")).alias("fill_bar"), F.when(long, F.col("exit_bar")).otherwise(F.col("fill_bar") - 1).alias("exit_bar"), F.lit("sl").alias("exit_reason"))
    return quality.trade_violations(t.union(broken)).select("symbol", "placed_bar", "violation")


@query("t2_position_size", f"{WITH} SELECT symbol, bar_idx, {r('CASE WHEN close > low THEN greatest(round_even(50 / (close - low) / 0.1, 0) * 0.1, 0.1) ELSE 0.1 END')} AS size FROM bars")
def size(spark, sf_dir):
    s = exits.position_size(F.col("close"), F.col("low"), Sizing("fixed_risk", 50.0, 0.1, 0.1))
    return base(spark, sf_dir).select("symbol", "bar_idx", r(s).alias("size"))


_TRAIL = "0.05", "0.02"


def _stop_sql(best: str, worst: str) -> str:
    t, a = _TRAIL
    return f"CASE WHEN side = 'LONG' THEN greatest(sl, CASE WHEN ({best} - raw_fill) / raw_fill >= {a} THEN {best} * (1 - {t}) END) ELSE least(sl, CASE WHEN (raw_fill - {worst}) / raw_fill >= {a} THEN {worst} * (1 + {t}) END) END"


@query("j6_trailing_stops", f"""{_FEATS}, {_SIGNALS}, path AS (SELECT g.symbol, g.p, side, sl, tp, raw_fill, b.bar_idx, b.open, b.high, b.low, max(b.high) OVER w AS top, min(b.low) OVER w AS bot, max(b.high) OVER v AS ptop, min(b.low) OVER v AS pbot
  FROM sig g JOIN bars b ON b.symbol = g.symbol AND b.bar_idx > fb WHERE raw_fill IS NOT NULL WINDOW w AS (PARTITION BY g.symbol, g.p ORDER BY b.bar_idx), v AS (PARTITION BY g.symbol, g.p ORDER BY b.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, {_stop_sql('top', 'bot')} AS stop, {_stop_sql('ptop', 'pbot')} AS held FROM path),
rs AS (SELECT *, CASE WHEN side = 'LONG' THEN CASE WHEN open <= held THEN 'gap sl' WHEN open >= tp THEN 'gap tp' WHEN low <= stop THEN 'sl' WHEN high >= tp THEN 'tp' END ELSE CASE WHEN open >= held THEN 'gap sl' WHEN open <= tp THEN 'gap tp' WHEN high >= stop THEN 'sl' WHEN low <= tp THEN 'tp' END END AS why FROM st),
hit AS (SELECT symbol, p, bar_idx AS xb, replace(why, 'gap ', '') AS reason, CASE WHEN why LIKE 'gap%' THEN open WHEN why = 'sl' THEN stop ELSE tp END AS px FROM rs WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, p ORDER BY bar_idx) = 1),
ends AS (SELECT symbol, max(bar_idx) AS xb, last(close ORDER BY bar_idx) AS px FROM bars GROUP BY 1)
SELECT g.symbol, g.p AS placed_bar, coalesce(h.xb, e.xb) AS exit_bar, coalesce(reason, 'end_of_data') AS exit_reason, {r('coalesce(h.px, e.px)')} AS raw_exit FROM sig g JOIN ends e USING (symbol) LEFT JOIN hit h ON h.symbol = g.symbol AND h.p = g.p WHERE raw_fill IS NOT NULL""")
def trailing_stops(spark, sf_dir):
    f = _feats(spark, sf_dir)
    filled = exits.resolve_fills(studies.cross_signals(f), f)
    t = exits.resolve_trailing_exits(filled, f, Costs(trail_pct=0.05, trail_activation=0.02)).where("status = 'filled'")
    return rounded(t.select("symbol", "placed_bar", "exit_bar", "exit_reason", "raw_exit"))


@query("j6_break_even", f"""{_FEATS}, {_SIGNALS}, path AS (SELECT g.symbol, g.p, side, tp, b.bar_idx, b.open, b.high, b.low, CASE WHEN coalesce(max(CASE WHEN side = 'LONG' THEN (b.high - raw_fill) / raw_fill ELSE (raw_fill - b.low) / raw_fill END) OVER v >= 0.03, false)
  THEN CASE WHEN side = 'LONG' THEN greatest(sl, raw_fill) ELSE least(sl, raw_fill) END ELSE sl END AS stop FROM sig g JOIN bars b ON b.symbol = g.symbol AND b.bar_idx > fb WHERE raw_fill IS NOT NULL WINDOW v AS (PARTITION BY g.symbol, g.p ORDER BY b.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rs AS (SELECT *, CASE WHEN side = 'LONG' THEN CASE WHEN open <= stop THEN 'gap sl' WHEN open >= tp THEN 'gap tp' WHEN low <= stop THEN 'sl' WHEN high >= tp THEN 'tp' END ELSE CASE WHEN open >= stop THEN 'gap sl' WHEN open <= tp THEN 'gap tp' WHEN high >= stop THEN 'sl' WHEN low <= tp THEN 'tp' END END AS why FROM path),
hit AS (SELECT symbol, p, bar_idx AS xb, replace(why, 'gap ', '') AS reason, CASE WHEN why LIKE 'gap%' THEN open WHEN why = 'sl' THEN stop ELSE tp END AS px FROM rs WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, p ORDER BY bar_idx) = 1),
ends AS (SELECT symbol, max(bar_idx) AS xb, last(close ORDER BY bar_idx) AS px FROM bars GROUP BY 1)
SELECT g.symbol, g.p AS placed_bar, coalesce(h.xb, e.xb) AS exit_bar, coalesce(reason, 'end_of_data') AS exit_reason, {r('coalesce(h.px, e.px)')} AS raw_exit FROM sig g JOIN ends e USING (symbol) LEFT JOIN hit h ON h.symbol = g.symbol AND h.p = g.p WHERE raw_fill IS NOT NULL""")
def break_even_stops(spark, sf_dir):
    f = _feats(spark, sf_dir)
    filled = exits.resolve_fills(studies.cross_signals(f), f)
    t = exits.resolve_trailing_exits(filled, f, Costs(break_even=0.03)).where("status = 'filled'")
    return rounded(t.select("symbol", "placed_bar", "exit_bar", "exit_reason", "raw_exit"))


_SIZED = "greatest(round_even(e * 0.02 / abs(placed_close - sl) / 0.1, 0) * 0.1, 0.1)"


@query("t2_x1_equity_sizing", f"""{_CROSS}, nxt AS (SELECT o.*, CASE WHEN side = 'LONG' THEN raw_exit - raw_fill ELSE raw_fill - raw_exit END AS unit, (SELECT min(q.p) FROM out q WHERE q.symbol = o.symbol AND q.p > o.xb) AS n FROM out o),
pick AS (SELECT symbol, min(p) AS p, 10000.0::DOUBLE AS e FROM nxt GROUP BY 1 UNION ALL SELECT s.symbol, s.n, s.e + s.size * s.unit FROM (SELECT n.symbol, n.n, k.e, n.unit, CASE WHEN e > 0 AND {_SIZED} * placed_close > 3 * e THEN greatest(floor(3 * e / placed_close / 0.1) * 0.1, 0.1) ELSE {_SIZED} END AS size FROM pick k JOIN nxt n ON n.symbol = k.symbol AND n.p = k.p WHERE n.n IS NOT NULL) s)
SELECT n.symbol, n.p AS placed_bar, {r(f'CASE WHEN e > 0 AND {_SIZED} * placed_close > 3 * e THEN greatest(floor(3 * e / placed_close / 0.1) * 0.1, 0.1) ELSE {_SIZED} END')} AS size FROM pick k JOIN nxt n ON n.symbol = k.symbol AND n.p = k.p""")
def equity_sizing(spark, sf_dir):
    f = _feats(spark, sf_dir)
    t = studies.orders(f, studies.cross_signals(f), sizing=Sizing("pct_equity", 0.02, 0.1, 0.1, 3.0, 10_000.0)).where("status = 'filled'")
    return rounded(t.select("symbol", "placed_bar", "size"))


def _shared(size: str, fits: str, rank: str) -> str:
    """One portfolio of all symbols, candidate by candidate in the order of (time, rank): equity, open positions and
    risk follow from fills and exits before it, which wait in a list; each symbol has one place."""
    return f"""{_CROSS}, ranks AS (SELECT symbol, row_number() OVER (ORDER BY {rank}) AS q FROM (SELECT DISTINCT symbol FROM bars)),
un AS (SELECT *, CASE WHEN side = 'LONG' THEN exit_price - fill_price ELSE fill_price - exit_price END - 0.401 / 2 AS unit, row_number() OVER (ORDER BY placed_ts, q, p) AS k FROM (SELECT o.*, q, raw_fill + 0.01 + CASE WHEN side = 'LONG' THEN {_SPREAD.format(t='fill_ts')} ELSE 0 END AS fill_price, raw_exit + CASE WHEN side = 'LONG' THEN 0 ELSE {_SPREAD.format(t='exit_ts')} END AS exit_price FROM out o JOIN ranks USING (symbol))),
cw AS (SELECT 0::BIGINT AS k, 10000.0::DOUBLE AS e, 0::DOUBLE AS n, 0::DOUBLE AS risk, []::STRUCT(t TIMESTAMP, q BIGINT, cash DOUBLE, n DOUBLE, risk DOUBLE)[] AS ev, []::STRUCT(s VARCHAR, f BIGINT)[] AS fr, 0::DOUBLE AS size, false AS taken
  UNION ALL SELECT k, e, n, risk, CASE WHEN taken THEN list_concat(ev, [{{'t': fill_ts, 'q': q, 'cash': -0.401 / 2 * size, 'n': 1.0::DOUBLE, 'risk': abs(fill_price - sl) * size}}, {{'t': exit_ts, 'q': q, 'cash': unit * size, 'n': -1.0::DOUBLE, 'risk': -abs(fill_price - sl) * size}}]) ELSE ev END,
    CASE WHEN taken THEN list_append(list_filter(fr, lambda x: x.s <> symbol), {{'s': symbol, 'f': xb}}) ELSE fr END, size, taken
  FROM (SELECT *, free AND {fits} AS taken FROM (SELECT *, {size} AS size FROM (
    SELECT k, symbol, q, p, fb, xb, placed_close, sl, fill_price, unit, fill_ts, exit_ts, fr, rest AS ev, e + coalesce(list_sum(list_transform(done, lambda x: x.cash)), 0) AS e, n + coalesce(list_sum(list_transform(done, lambda x: x.n)), 0) AS n, risk + coalesce(list_sum(list_transform(done, lambda x: x.risk)), 0) AS risk, len(list_filter(fr, lambda x: x.s = symbol AND x.f >= p)) = 0 AS free
    FROM (SELECT u.*, w.e, w.n, w.risk, w.fr, list_filter(w.ev, lambda x: x.t < u.placed_ts OR x.t = u.placed_ts AND x.q < u.q) AS done, list_filter(w.ev, lambda x: NOT (x.t < u.placed_ts OR x.t = u.placed_ts AND x.q < u.q)) AS rest FROM cw w JOIN un u ON u.k = w.k + 1)))))
SELECT symbol, p AS placed_bar, xb AS exit_bar, {r('size')} AS size, {r('unit * size')} AS pnl_net FROM un JOIN cw USING (k) WHERE taken"""


_EQUITY_SIZE = f"CASE WHEN e > 0 AND {_SIZED} * placed_close > 3 * e THEN greatest(floor(3 * e / placed_close / 0.1) * 0.1, 0.1) ELSE {_SIZED} END"


def _portfolio(spark, sf_dir, **caps):
    f = _feats(spark, sf_dir)
    s = studies.cross_signals(f).withColumn("portfolio", F.lit("all"))
    ranks = f.select("symbol").distinct().withColumn("symbol_rank", F.row_number().over(Window.orderBy(F.col("symbol").desc())))  # the portfolio's list
    t = studies.orders(f, s, COSTS, sizing=Sizing("pct_equity", 0.02, 0.1, 0.1, 3.0, 10_000.0), capital=("portfolio",), ranks=ranks, **caps).where("status = 'filled'")
    return rounded(t.select("symbol", "placed_bar", "exit_bar", "size", "pnl_net"))


@query("x8_shared_equity", _shared(_EQUITY_SIZE, "true", "symbol DESC"))
def shared_equity(spark, sf_dir):
    """All symbols as one portfolio whose orders are sized by its one equity."""
    return _portfolio(spark, sf_dir)


@query("x8_portfolio_caps", _shared(_EQUITY_SIZE, "n < 3 AND risk + abs(placed_close - sl) * size <= 500", "symbol DESC"))
def portfolio_caps(spark, sf_dir):
    """The same with at most three positions open at once and at most 500 at risk, over all symbols."""
    return _portfolio(spark, sf_dir, most_positions=3, most_risk=500.0)


# --- splits, sweeps, walk-forward ----------------------------------------------------------------


@query("x2_run_splits", f"""{_scans(f"""{_ALL}, cut AS (SELECT s.split, b.* FROM all_bars b JOIN (VALUES ('IS', NULL::DATE, DATE '2024-01-15'), ('OOS', DATE '2024-01-16', NULL)) s(split, a, z) ON (a IS NULL OR ts >= a) AND (z IS NULL OR ts < z + 1)),
bars AS (SELECT split || '|' || symbol AS symbol, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY split, symbol ORDER BY ts) - 1 AS bar_idx FROM cut QUALIFY count(*) OVER (PARTITION BY split, symbol) >= 40)""")},
{_signals(warmup=30)}, {_EXITS}, {_PLAIN} SELECT {_stats("symbol")} FROM net GROUP BY symbol""")
def run_splits(spark, sf_dir):
    s = spark.createDataFrame([("IS", None, datetime.date(2024, 1, 15)), ("OOS", datetime.date(2024, 1, 16), None)], "split string, start date, stop date")
    t = studies.run_splits(base(spark, sf_dir), s, 30)
    return rounded(metrics.trade_stats(t, ("symbol",)))


def _grid(spark):
    return studies.param_grid(spark, {"k": [1.0, 2.0, 3.0], "rr": [1.0, 1.5]})


@query("j12_param_grid", f"{WITH}, {_GRID} SELECT symbol, combo_id, k, rr, {r('k * avg(high - low)')} AS stop, {r('k * rr * avg(high - low)')} AS target FROM bars, grid GROUP BY symbol, combo_id, k, rr")
def param_grid(spark, sf_dir):
    # every combination for every symbol, in money of its mean range
    mean = base(spark, sf_dir).groupBy("symbol").agg(F.avg(F.col("high") - F.col("low")).alias("range"))
    each = mean.crossJoin(F.broadcast(_grid(spark)))  # at most 500 combinations
    return rounded(each.select("symbol", "combo_id", "k", "rr", (F.col("k") * F.col("range")).alias("stop"), (F.col("k") * F.col("rr") * F.col("range")).alias("target")))


@query("x3_parameter_sweep", f"""{_scans(f"""{_ALL}, {_GRID}, bars AS (SELECT symbol || '|' || combo_id AS symbol, ts, open, high, low, close, volume, bar_idx, k, rr FROM all_bars, grid)""")},
{_signals("k", "rr")}, {_EXITS}, {_PLAIN} SELECT {_stats("split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS BIGINT) AS combo_id")} FROM net GROUP BY net.symbol""")
def sweep(spark, sf_dir):
    t = studies.parameter_sweep(_feats(spark, sf_dir), _grid(spark))
    return rounded(metrics.trade_stats(t, ("symbol", "combo_id")))


_AROUND = "grid(combo_id, k, rr) AS (SELECT row_number() OVER (ORDER BY k, rr) - 1, k, rr FROM (VALUES (1.0::DOUBLE), (2.0), (3.0)) a(k), (VALUES (1.0::DOUBLE), (1.5), (1.75)) b(rr))"


@query("x3_j12_default_grid", f"""{_scans(f"""{_ALL}, {_AROUND}, bars AS (SELECT symbol || '|' || combo_id AS symbol, ts, open, high, low, close, volume, bar_idx, k, rr FROM all_bars, grid)""")},
{_signals("k", "rr")}, {_EXITS}, {_PLAIN} SELECT {_stats("split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS BIGINT) AS combo_id")} FROM net GROUP BY net.symbol""")
def default_grid_sweep(spark, sf_dir):
    params = {"k": studies.Param(1.5, step=0.5, least=1.0), "rr": studies.Param(1.5, step=0.25, most=1.75)}
    t = studies.parameter_sweep(_feats(spark, sf_dir), studies.param_grid(spark, studies.default_grid(params, {"k": 2.0})))
    return rounded(metrics.trade_stats(t, ("symbol", "combo_id")))


_SETS = [(5, 20, 1.0, 1.5), (5, 20, 2.0, 1.5), (10, 40, 2.0, 1.0), (10, 40, 3.0, 1.0)]


@query("x3_feature_sweep", f"""{_scans(f"""{_ALL}, grid(combo_id, fast, slow, k, rr) AS (VALUES {', '.join(f'({i}::BIGINT, {a}, {b}, {k}::DOUBLE, {rr}::DOUBLE)' for i, (a, b, k, rr) in enumerate(_SETS))}), bars AS (SELECT symbol || '|' || combo_id AS symbol, ts, open, high, low, close, volume, bar_idx, fast, slow, k, rr FROM all_bars, grid)""", "s.fast", "s.slow")},
{_signals("k", "rr")}, {_EXITS}, {_PLAIN} SELECT {_stats("split_part(symbol, '|', 1) AS symbol, CAST(split_part(symbol, '|', 2) AS BIGINT) AS combo_id")} FROM net GROUP BY net.symbol""")
def feature_sweep(spark, sf_dir):
    grid = spark.createDataFrame([(i, *x) for i, x in enumerate(_SETS)], "combo_id long, fast int, slow int, k double, rr double")
    t = studies.feature_sweep(base(spark, sf_dir), grid, chunk=128)
    return rounded(metrics.trade_stats(t, ("symbol", "combo_id")))


def _walk(score: str = "sums AS (SELECT symbol, count(*) AS n, sum(pnl_net) AS score FROM net GROUP BY 1)", start: str = "100 * w", net: str = _PLAIN) -> str:
    """Best combinations of in-sample windows; `score`: CTEs up to sums (symbol, n, score); start of the windows."""
    return f"""{_scans(f"""{_ALL}, {_GRID}, wins AS (SELECT sy, unnest(generate_series(0, n - 1)) AS w FROM (SELECT symbol AS sy, (count(*) - 300) // 100 AS n FROM all_bars GROUP BY 1) WHERE n > 0),
slices AS (SELECT sy, w, 'IS' AS ph, {start} AS a, 100 * w + 300 AS z FROM wins UNION ALL SELECT sy, w, 'OOS', 300 + 100 * w, 400 + 100 * w FROM wins),
bars AS (SELECT concat_ws('|', sy, w, ph, combo_id) AS symbol, ts, open, high, low, close, volume, bar_idx - a AS bar_idx, k, rr FROM all_bars JOIN slices ON symbol = sy AND bar_idx >= a AND bar_idx < z, grid)""")},
{_signals("k", "rr", 30)}, {_EXITS}, {net}, {score},
scored AS (SELECT sy, w, ph, combo_id, k, rr, coalesce(score, -999.0) AS score, coalesce(n, 0) AS n FROM slices CROSS JOIN grid LEFT JOIN sums ON sums.symbol = concat_ws('|', sy, w, ph, combo_id)),
best AS (SELECT * FROM scored WHERE ph = 'IS' QUALIFY row_number() OVER (PARTITION BY sy, w ORDER BY round(score, 9) DESC, combo_id) = 1),
walked AS (SELECT b.sy AS symbol, b.w AS window_idx, b.combo_id, b.k, b.rr, b.score AS is_score, o.score AS oos_score, o.n AS oos_n FROM best b LEFT JOIN scored o ON o.sy = b.sy AND o.w = b.w AND o.combo_id = b.combo_id AND o.ph = 'OOS')"""


_WALK = _walk()
_WALKED = f"SELECT symbol, window_idx, combo_id, k, rr, {r('is_score')} AS is_score, {r('oos_score')} AS oos_score, oos_n FROM walked"


def _rated(bucket: str, spread: str) -> str:
    """Mean over deviation of sums by bucket."""
    return f"""sums AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS n, CASE WHEN count(*) >= 2 AND {spread} > 0 THEN avg(x) / {spread} * sqrt(252) ELSE 0 END AS score FROM (SELECT symbol, {bucket} AS bk, sum(pnl_net) AS x, count(*) AS n FROM net GROUP BY 1, 2) GROUP BY 1)"""


_CALMAR = """ev AS (SELECT symbol, b, sum(c) AS c FROM (SELECT symbol, fb AS b, -0.401 / 2 AS c FROM net UNION ALL SELECT symbol, xb, pnl_net FROM net) GROUP BY 1, 2),
cv AS (SELECT symbol, b, 10000 + sum(c) OVER (PARTITION BY symbol ORDER BY b) AS eq FROM ev), pv AS (SELECT *, greatest(10000, max(eq) OVER (PARTITION BY symbol ORDER BY b)) AS pk FROM cv),
tv AS (SELECT symbol, max(100 * (pk - eq) / pk) AS fall, last(eq ORDER BY b) / 100 - 100 AS ret FROM pv GROUP BY 1),
sums AS (SELECT symbol, any_value(n) AS n, any_value(CASE WHEN fall = 0 THEN 0 ELSE ret / fall END) AS score FROM tv JOIN (SELECT symbol, count(*) AS n FROM net GROUP BY 1) USING (symbol) GROUP BY 1)"""


@query("x4_walk_forward_sharpe_anchored", f"{_walk(_rated('CAST(exit_ts AS DATE)', 'stddev_pop(x)'), '0')} {_WALKED}")
def walk_forward_sharpe(spark, sf_dir):
    return rounded(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, "sharpe", 30, anchored=True))


@query("x4_walk_forward_sortino", f"{_walk(_rated('xb // 20', 'stddev_pop(x) FILTER (x < 0)'))} {_WALKED}")
def walk_forward_sortino(spark, sf_dir):
    return rounded(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, "sortino", 30, bucket_bars=20))


@query("x4_walk_forward_calmar", f"{_walk(_CALMAR, net=_CHOSEN)} {_WALKED}")
def walk_forward_calmar(spark, sf_dir):
    return rounded(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, "calmar", 30, costs=COSTS))


@query("x4_walk_forward_own_score", f"{_walk("sums AS (SELECT symbol, count(*) AS n, sum(pnl_net) / sqrt(count(*)) AS score FROM net GROUP BY 1)")} {_WALKED}")
def walk_forward_own_score(spark, sf_dir):
    return rounded(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, F.col("pnl") / F.sqrt("n"), 30))


@query("x4_walk_forward", f"{_WALK} SELECT symbol, window_idx, combo_id, k, rr, {r('is_score')} AS is_score, {r('oos_score')} AS oos_score, oos_n FROM walked")
def walk_forward(spark, sf_dir):
    return rounded(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, warmup=30))


@query("a14_stability", f"{_WALK} SELECT symbol, {r('avg(CASE WHEN abs(is_score) > 1e-9 THEN oos_score / is_score END)')} AS stability, string_agg(combo_id, ',' ORDER BY window_idx) AS chosen FROM walked GROUP BY 1")
def stability(spark, sf_dir):
    s = studies.stability(studies.walk_forward(base(spark, sf_dir), _grid(spark), 300, 100, warmup=30))
    return rounded(s.withColumn("chosen", F.array_join(F.col("chosen").cast("array<string>"), ",")))


@query("x5_stitch", f"""{_EQ}, c AS (SELECT run, year(ts) AS window_idx, bar_idx, equity - 1000000 + 10000 * (year(ts) - 1990) AS equity FROM equity),
e AS (SELECT run, window_idx, first(equity ORDER BY bar_idx) AS s, last(equity ORDER BY bar_idx) - first(equity ORDER BY bar_idx) AS g FROM c GROUP BY 1, 2),
h AS (SELECT *, first(s) OVER (PARTITION BY run ORDER BY window_idx) + coalesce(sum(g) OVER (PARTITION BY run ORDER BY window_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - s AS shift FROM e)
SELECT run, c.window_idx, bar_idx, {r('equity + shift', 2)} AS equity FROM c JOIN h USING (run, window_idx)""")
def stitch(spark, sf_dir):
    e = adapters.equity(spark, sf_dir)
    year = F.year("ts").cast("long")
    c = e.select("run", year.alias("window_idx"), "bar_idx", (F.col("equity") - 1_000_000 + 10_000 * (year - 1990)).alias("equity"))
    return studies.stitch(c).select("run", "window_idx", "bar_idx", r(F.col("equity"), 2).alias("equity"))


@query("k1_best_parameters", f"{_TRADES}, s AS (SELECT run, year(exit_ts) AS y, month(exit_ts) AS m, sum(CAST(pnl_net AS DECIMAL(18, 2))) AS p FROM trades GROUP BY 1, 2, 3) SELECT run, y, m FROM s QUALIFY row_number() OVER (PARTITION BY run, y ORDER BY p DESC, m) = 1")
def best(spark, sf_dir):
    s = adapters.trades(spark, sf_dir).groupBy("run", F.year("exit_ts").cast("long").alias("y"), F.month("exit_ts").cast("long").alias("m")).agg(F.sum(F.col("pnl_net").cast("decimal(18,2)")).alias("p"))
    return s.groupBy("run", "y").agg(F.max_by("m", F.struct("p", -F.col("m"))).alias("m"))


# --- bootstrap -----------------------------------------------------------------------------------

_SIMS = 20
_BOOT = f"""{_EQ}, pnl AS (SELECT run, bar_idx AS i, CAST(pnl AS DOUBLE) AS x, count(*) OVER (PARTITION BY run) AS n FROM equity JOIN daily USING (run, ts)),
draws AS (SELECT run, sim, step, n, ('0x' || substr(md5('42|' || sim || '|' || step), 1, 15))::BIGINT % n AS i FROM (SELECT run, n, unnest(generate_series(1, n)) AS step FROM (SELECT DISTINCT run, n FROM pnl)), (SELECT unnest(generate_series(0, {_SIMS - 1})) AS sim)),
paths AS (SELECT d.run, sim, step, x, 10000000.0 + sum(x) OVER (PARTITION BY d.run, sim ORDER BY step) AS equity FROM draws d JOIN pnl p ON d.run = p.run AND d.i = p.i),
peaks AS (SELECT *, greatest(max(equity) OVER (PARTITION BY run, sim ORDER BY step), 10000000.0) AS peak FROM paths),
stats AS (SELECT run, sim, last(equity ORDER BY step) AS final, greatest(max(100 * (peak - equity) / peak), 0) AS max_dd, avg(x) / nullif(stddev_pop(x), 0) * sqrt(252) AS sharpe, least(min(equity), 10000000.0) AS lowest FROM peaks GROUP BY 1, 2)"""


def _paths(spark, sf_dir):
    t = adapters.trades(spark, sf_dir).groupBy("run", "exit_ts").agg(F.sum(F.col("pnl_net").cast("decimal(18,2)")).cast("double").alias("pnl_net"))
    i = (F.row_number().over(Window.partitionBy("run").orderBy("exit_ts")) - 1).cast("long")
    return studies.bootstrap(spark, t.select("run", i.alias("i"), "pnl_net"), _SIMS, 42, 10_000_000.0)


@query("x6_monte_carlo", f"{_BOOT} SELECT run, sim, {r('final', 2)} AS final, {r('max_dd')} AS max_dd, {r('sharpe')} AS sharpe, {r('lowest', 2)} AS lowest FROM stats")
def monte_carlo(spark, sf_dir):
    s = studies.bootstrap_stats(_paths(spark, sf_dir), 10_000_000.0)
    return s.select("run", "sim", r(F.col("final"), 2).alias("final"), r(F.col("max_dd")).alias("max_dd"), r(F.col("sharpe")).alias("sharpe"), r(F.col("lowest"), 2).alias("lowest"))


@query("x7_equity_bands", f"{_BOOT} SELECT run, step, {', '.join(f'{r(f'quantile_cont(equity, {p / 100})', 4)} AS p{p}' for p in (5, 50, 95))} FROM paths GROUP BY 1, 2")
def bands(spark, sf_dir):
    b = studies.equity_bands(_paths(spark, sf_dir), (5, 50, 95))
    return b.select("run", "step", *(r(F.col(f"p{p}"), 4).alias(f"p{p}") for p in (5, 50, 95)))


@query("x7_prob_ruin", f"{_BOOT} SELECT run, {r('avg(CASE WHEN lowest <= 9500000.0 THEN 1.0 ELSE 0.0 END)')} AS prob_ruin FROM stats GROUP BY 1")
def prob_ruin(spark, sf_dir):
    return rounded(studies.ruin(studies.bootstrap_stats(_paths(spark, sf_dir), 10_000_000.0), 9_500_000.0))


# --- account rules -------------------------------------------------------------------------------

_PRESETS = ", ".join(f"('{n}', {a}::DOUBLE, {t}::DOUBLE, {f}::DOUBLE, {d}::DOUBLE, {str(tr).lower()}, {k})" for n, a, t, f, d, tr, k in studies.PRESETS)


@query("x13_presets", f"""{_EQ}, rules(rule, account, target, fl, daily_pct, moves, least_days) AS (VALUES {_PRESETS}), s AS (SELECT run, first(equity ORDER BY bar_idx) AS f FROM equity GROUP BY 1)
SELECT run, rule, moves AS trailing, least_days, {r('f * (1 - fl / 100)', 2)} AS lowest, {r('f * daily_pct / 100', 2)} AS daily_loss, {r('f * (1 + target / 100)', 2)} AS goal FROM s, rules""")
def presets(spark, sf_dir):
    # what each programme asks of each run, in the run's own money
    first = adapters.equity(spark, sf_dir).groupBy("run").agg(F.min_by("equity", "bar_idx").alias("f"))
    each = first.crossJoin(F.broadcast(studies.presets(spark)))  # a few literal rules
    f = F.col("f")
    return rounded(each.select("run", "rule", "trailing", F.col("least_days").cast("int").alias("least_days"), (f * (1 - F.col("floor") / 100)).alias("lowest"), (f * F.col("daily") / 100).alias("daily_loss"), (f * (1 + F.col("target") / 100)).alias("goal")), 2)


@query("x10_account_rules", f"""{_EQ}, rules(rule, account, target, fl, daily_pct, moves, least_days) AS (VALUES {_PRESETS}), f AS (SELECT run, first(equity ORDER BY bar_idx) AS f FROM equity GROUP BY 1),
e AS (SELECT e.run, rule, bar_idx, equity * account / f AS eq, account, target, fl, daily_pct, moves, least_days FROM equity e JOIN f USING (run), rules),
p AS (SELECT *, greatest(max(eq) OVER w, account) AS pk, coalesce(lag(eq) OVER w, account) AS b, row_number() OVER w AS traded FROM e WINDOW w AS (PARTITION BY run, rule ORDER BY bar_idx)),
v AS (SELECT *, CASE WHEN eq <= CASE WHEN moves THEN pk ELSE account END * (1 - fl / 100) THEN 'max drawdown' WHEN daily_pct > 0 AND b - eq >= b * daily_pct / 100 THEN 'daily loss' WHEN target > 0 AND eq >= account * (1 + target / 100) AND traded >= least_days THEN 'target' END AS event FROM p),
h AS (SELECT run, rule, min(bar_idx) AS hb FROM v WHERE event IS NOT NULL GROUP BY 1, 2)
SELECT v.run, v.rule, CASE WHEN coalesce(max(event) FILTER (bar_idx = hb), 'target') = 'target' THEN 'passed' ELSE 'failed' END AS status, max(event) FILTER (bar_idx = hb) AS event, any_value(hb) AS event_bar, {r('last(eq ORDER BY bar_idx)', 2)} AS final, {r('max(100 * (pk - eq) / pk)')} AS max_fall
FROM v LEFT JOIN h ON v.run = h.run AND v.rule = h.rule WHERE hb IS NULL OR bar_idx <= hb GROUP BY 1, 2""")
def account_rules(spark, sf_dir):
    e = adapters.equity(spark, sf_dir)
    out = studies.account_rules(e, e.select("run", "ts"), studies.presets(spark))
    return out.select("run", "rule", "status", "event", "event_bar", r(F.col("final"), 2).alias("final"), r(F.col("max_fall")).alias("max_fall"))


_INTRADAY = f"""{_CROSS}, {_CHOSEN}, cash AS (SELECT symbol, b, sum(c) AS c FROM (SELECT symbol, fb AS b, -0.401 / 2 AS c FROM net UNION ALL SELECT symbol, xb, pnl_net FROM net) GROUP BY 1, 2),
rules(rule, account, target, fl, daily_pct, moves, least_days) AS (VALUES {_PRESETS}), q AS (SELECT b.symbol, b.bar_idx, CAST(b.ts AS DATE) AS day, 2000 + sum(coalesce(c, 0)) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS equity FROM bars b LEFT JOIN cash ON b.symbol = cash.symbol AND b.bar_idx = cash.b),
f AS (SELECT symbol, first(equity ORDER BY bar_idx) AS f FROM q GROUP BY 1), dd AS (SELECT DISTINCT symbol, CAST(exit_ts AS DATE) AS day FROM net),
a AS (SELECT q.symbol, rule, q.day, bar_idx, equity * account / f AS eq, account, target, fl, daily_pct, moves, least_days, (SELECT count(*) FROM dd WHERE dd.symbol = q.symbol AND dd.day <= q.day) AS traded FROM q JOIN f USING (symbol), rules),
p AS (SELECT *, greatest(max(eq) OVER (PARTITION BY symbol, rule ORDER BY bar_idx), account) AS pk, coalesce((SELECT arg_max(y.eq, y.bar_idx) FROM a y WHERE y.symbol = a.symbol AND y.rule = a.rule AND y.day < a.day), account) AS b FROM a),
v AS (SELECT *, CASE WHEN eq <= CASE WHEN moves THEN pk ELSE account END * (1 - fl / 100) THEN 'max drawdown' WHEN daily_pct > 0 AND b > 0 AND b - eq >= b * daily_pct / 100 THEN 'daily loss' WHEN target > 0 AND eq >= account * (1 + target / 100) AND traded >= least_days THEN 'target' END AS event FROM p),
h AS (SELECT symbol, rule, min(bar_idx) AS hb, arg_min(event, bar_idx) AS ev, arg_min(eq, bar_idx) AS held FROM v WHERE event IS NOT NULL GROUP BY 1, 2)"""


def _intraday(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    return metrics.equity_curve(f, t, 2_000.0), t.select("symbol", F.col("exit_ts").alias("ts"))


@query("x10_intraday_rules", f"""{_INTRADAY} SELECT v.symbol, v.rule, CASE WHEN coalesce(any_value(ev), 'target') = 'target' THEN 'passed' ELSE 'failed' END AS status, any_value(ev) AS event, any_value(hb) AS event_bar, {r('last(eq ORDER BY bar_idx)', 2)} AS final
FROM v LEFT JOIN h ON v.symbol = h.symbol AND v.rule = h.rule WHERE hb IS NULL OR bar_idx <= hb GROUP BY 1, 2""")
def intraday_rules(spark, sf_dir):
    out = studies.account_rules(*_intraday(spark, sf_dir), studies.presets(spark), ("symbol",))
    return out.select("symbol", "rule", "status", "event", "event_bar", r(F.col("final"), 2).alias("final"))


@query("x10_account_curves", f"{_INTRADAY} SELECT v.symbol, v.rule, bar_idx, {r("CASE WHEN ev <> 'target' AND bar_idx > hb THEN held ELSE eq END", 2)} AS equity FROM v LEFT JOIN h ON v.symbol = h.symbol AND v.rule = h.rule")
def account_curves(spark, sf_dir):
    out = studies.account_curves(*_intraday(spark, sf_dir), studies.presets(spark), ("symbol",))
    return out.select("symbol", "rule", "bar_idx", r(F.col("equity"), 2).alias("equity"))


@query("x11_circuit_breaker", f"""{_CROSS}, {_CHOSEN}, cash AS (SELECT symbol, b, sum(c) AS c FROM (SELECT symbol, fb AS b, -0.401 / 2 AS c FROM net UNION ALL SELECT symbol, xb, pnl_net FROM net) GROUP BY 1, 2),
eq AS (SELECT b.symbol, b.bar_idx, b.ts, b.close, 10000 + sum(coalesce(c, 0)) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS equity FROM bars b LEFT JOIN cash ON b.symbol = cash.symbol AND b.bar_idx = cash.b),
fl AS (SELECT e.symbol, e.bar_idx, coalesce(sum(CASE WHEN side = 'LONG' THEN e.close - fill_price ELSE fill_price - e.close END), 0) AS floating FROM eq e LEFT JOIN net n ON n.symbol = e.symbol AND e.bar_idx >= n.fb AND e.bar_idx < n.xb GROUP BY 1, 2),
since AS (SELECT symbol, bar_idx, CAST(ts AS DATE) AS day, equity - first(equity) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY bar_idx) + floating AS x FROM eq JOIN fl USING (symbol, bar_idx))
SELECT symbol, day, min(bar_idx) AS bar_idx FROM since WHERE x <= -0.002 * 10000 GROUP BY 1, 2""")
def circuit_breaker(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    e = metrics.equity_curve(f, t, 10_000.0).join(metrics.floating(f, t).select("symbol", "bar_idx", "floating"), ["symbol", "bar_idx"])
    return studies.circuit_breaker(e, 0.2, 10_000.0, ("symbol",))


@query("x12_payouts", f"""{_EQ}, days AS (SELECT run, ts AS day, equity, lag(equity) OVER w AS prev, lag(ts) OVER w AS pday FROM equity WINDOW w AS (PARTITION BY run ORDER BY ts)),
p AS (SELECT run, min(day) + 30 AS due, arg_min(equity, day) AS cycle, NULL::DATE AS day, false AS paid, 0.0::DOUBLE AS profit FROM days GROUP BY 1
  UNION ALL SELECT p.run, d.day + 14, CASE WHEN d.prev > p.cycle THEN d.equity ELSE p.cycle END, d.day, d.prev > p.cycle, d.prev - p.cycle FROM p JOIN days d ON d.run = p.run AND d.day >= p.due AND d.pday < p.due)
SELECT run, day, {r('profit', 2)} AS profit, {r('profit * 0.8', 2)} AS payout FROM p WHERE paid""")
def payouts(spark, sf_dir):
    return rounded(studies.payouts(adapters.equity(spark, sf_dir)), 2)


@query("x12_payouts_reset", f"""{_EQ}, days AS (SELECT run, ts AS day, equity, lag(equity) OVER w AS prev, lag(ts) OVER w AS pday FROM equity WINDOW w AS (PARTITION BY run ORDER BY ts)),
p AS (SELECT run, min(day) + 30 AS due, 1000000.0::DOUBLE AS cycle, 0.0::DOUBLE AS taken, NULL::DATE AS day, false AS paid, false AS once, 0.0::DOUBLE AS profit FROM days GROUP BY 1
  UNION ALL SELECT p.run, d.day + 14, CASE WHEN once OR d.prev - taken > cycle THEN 1000000.0 ELSE cycle END, CASE WHEN once OR d.prev - taken > cycle THEN d.equity - 1000000 ELSE taken END, d.day, d.prev - taken > cycle, once OR d.prev - taken > cycle, d.prev - taken - cycle
  FROM p JOIN days d ON d.run = p.run AND d.day >= p.due AND d.pday < p.due)
SELECT run, day, {r('profit', 2)} AS profit, {r('profit * 0.8', 2)} AS payout FROM p WHERE paid""")
def payouts_reset(spark, sf_dir):
    return rounded(studies.payouts(adapters.equity(spark, sf_dir), reset=1_000_000.0), 2)


# --- pairs, timeframes, zones --------------------------------------------------------------------


def _pair_rows(spark, sf_dir, adx: bool = False):
    """The pairs of a list, here each two event types once, at the times both have, with z-score and correlation, and
    ADX of the spread; written once."""
    b = tables.kept(adapters.bars(spark, sf_dir), "bars")
    names = b.select("symbol").distinct()
    p = studies.pair_bars(b, names.select(F.col("symbol").alias("a")).join(names.select(F.col("symbol").alias("b")), F.col("a") < F.col("b")))
    p = adapters.numbered(p, ("pair",)).withColumn("spread", F.col("a_close") - F.col("b_close"))
    p = roll.in_chunks(p, 30, lambda cut, by: cut.withColumns({"z": roll.zscore(F.col("spread"), by, 30), "corr": roll.rolling_corr(F.col("a_close"), F.col("b_close"), by, 30)}), ("pair",), chunk=256)
    return tables.kept(rec.spread_adx(p, "spread", 14, chunk=128) if adx else p, "pairs")


_PAIRS = f"""{WITH}, pr AS (SELECT a.symbol || '/' || b.symbol AS symbol, a.ts, a.open AS ao, a.close AS ac, b.open AS bo, b.close AS bc, a.close - b.close AS d, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts) - 1 AS bar_idx FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
mv AS (SELECT *, abs(d - lag(d) OVER w) AS t, CASE WHEN d - lag(d) OVER w > 0 THEN d - lag(d) OVER w WHEN d - lag(d) OVER w <= 0 THEN 0 END AS mp, CASE WHEN d - lag(d) OVER w < 0 THEN lag(d) OVER w - d WHEN d - lag(d) OVER w >= 0 THEN 0 END AS mm FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
{scan_sql('sa', 'mv', 't', '1.0/14')}, {scan_sql('sp', 'sa_t', 'mp', '1.0/14')}, {scan_sql('sm', 'sp_t', 'mm', '1.0/14')},
dx AS (SELECT *, 100 * abs(100 * sp / nullif(sa, 0) - 100 * sm / nullif(sa, 0)) / nullif(100 * sp / nullif(sa, 0) + 100 * sm / nullif(sa, 0), 0) AS dx FROM sm_t), {scan_sql('adx', 'dx', 'dx', '1.0/14')},
zs AS (SELECT *, CASE WHEN count(d) OVER w = 30 THEN (d - avg(d) OVER w) / nullif(stddev_samp(d) OVER w, 0) END AS z, CASE WHEN count(d) OVER w = 30 THEN corr(ac, bc) OVER w END AS c FROM adx_t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""


def _walked(may: str) -> str:
    return f"""{_PAIRS}, u AS (SELECT symbol AS pair, bar_idx AS i, z, coalesce({may}, false) AS may, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS k FROM zs WHERE z IS NOT NULL),
walk AS (SELECT pair, 0::BIGINT AS k, 0 AS held, 0::BIGINT AS since, 0 AS was, 0::BIGINT AS opened, 0::BIGINT AS i, false AS shut FROM (SELECT DISTINCT pair FROM u)
  UNION ALL SELECT u.pair, u.k, CASE WHEN held <> 0 THEN CASE WHEN out THEN 0 ELSE held END WHEN may AND abs(z) > 1.5 AND abs(z) <= 5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END,
    CASE WHEN held <> 0 THEN since ELSE u.i END, held, since, u.i, held <> 0 AND out
  FROM walk JOIN (SELECT u.*, abs(z) > 5 OR abs(z) < 0.3 AS far FROM u) u ON u.pair = walk.pair AND u.k = walk.k + 1, LATERAL (SELECT far OR u.i - since >= 40 AS out)),
legs AS (SELECT w.pair, w.i AS xb, was * (c.ac - o.ao) AS pa, -was * (c.bc - o.bo) AS pb FROM walk w JOIN pr o ON o.symbol = w.pair AND o.bar_idx = w.opened + 1 JOIN pr c ON c.symbol = w.pair AND c.bar_idx = w.i WHERE shut),
cash AS (SELECT pair, xb, sum(pa) AS pa, sum(pb) AS pb FROM legs GROUP BY 1, 2),
eq AS (SELECT symbol AS pair, bar_idx, 10000 + sum(coalesce(pa, 0)) OVER w + sum(coalesce(pb, 0)) OVER w AS equity FROM pr LEFT JOIN cash ON pair = symbol AND xb = bar_idx WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
fall AS (SELECT pair, min(100 * (equity - peak) / peak) AS dd, 100 * (last(equity ORDER BY bar_idx) - first(equity ORDER BY bar_idx)) / first(equity ORDER BY bar_idx) AS ret FROM (SELECT *, max(equity) OVER (PARTITION BY pair ORDER BY bar_idx) AS peak FROM eq) GROUP BY 1)"""


_PAIR_FIGURES = f"""SELECT pair, count(*) AS n, {r('100.0 * avg(CASE WHEN pa + pb > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS win_rate, {r('sum(pa)', 4)} AS pnl_a, {r('sum(pb)', 4)} AS pnl_b, {r('sum(pa + pb)', 4)} AS pnl, {r('any_value(ret)', 4)} AS total_return, {r('any_value(dd)', 4)} AS max_dd_pct FROM legs JOIN fall USING (pair) GROUP BY 1"""


def _pair_run(spark, sf_dir, may=None):
    rows = _pair_rows(spark, sf_dir, may is not None)
    t = studies.pair_trades(studies.pair_positions(rows, 1.5, 0.3, 5.0, 40, may_enter=may), rows)
    return t, studies.pair_equity(t, rows)


@query("x9_g4_pairs", f"{_walked('true')} {_PAIR_FIGURES}")
def pairs(spark, sf_dir):
    return rounded(studies.pair_summary(*_pair_run(spark, sf_dir)), 4)


@query("x9_g4_filtered_pairs", f"{_walked('c > -0.2 AND adx < 20')} {_PAIR_FIGURES}")
def filtered_pairs(spark, sf_dir):
    return rounded(studies.pair_summary(*_pair_run(spark, sf_dir, (F.col("corr") > -0.2) & (F.col("adx") < 20))), 4)


@query("w22_pairs_equity", f"{_walked('true')} SELECT pair, bar_idx, {r('equity', 4)} AS equity FROM eq")
def pairs_equity(spark, sf_dir):
    return _pair_run(spark, sf_dir)[1].select("pair", "bar_idx", r(F.col("equity"), 4).alias("equity"))


# The run with a breaker, bar by bar: position, entry, fill prices, profit closed today, whether the breaker is out; then what was closed.
_BREAKER = f"""{_PAIRS}, u AS (SELECT symbol AS pair, bar_idx AS i, CAST(ts AS DATE) AS day, z, ao, bo, ac, bc, abs(z) > 5 OR abs(z) < 0.3 AS far, bar_idx = max(bar_idx) OVER (PARTITION BY symbol) AS ends FROM zs),
run AS (SELECT pair, -1::BIGINT AS i, NULL::DATE AS day, 0 AS held, 0::BIGINT AS since, 0.0::DOUBLE AS fa, 0.0::DOUBLE AS fb, 0.0::DOUBLE AS won, false AS outed, 0 AS was, 0::BIGINT AS opened, ''::VARCHAR AS why, 0.0::DOUBLE AS gain FROM (SELECT DISTINCT pair FROM u)
  UNION ALL SELECT pair, i, day, CASE WHEN shut THEN 0 WHEN held <> 0 THEN held WHEN out OR ends THEN 0 WHEN i >= 60 AND abs(z) > 1.5 AND abs(z) <= 5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END,
    CASE WHEN held <> 0 THEN since ELSE i END, CASE WHEN held <> 0 AND since = i - 1 THEN ao ELSE fa END, CASE WHEN held <> 0 AND since = i - 1 THEN bo ELSE fb END,
    won + CASE WHEN shut THEN CASE WHEN ends AND NOT trips AND NOT ripe THEN closing ELSE floating END ELSE 0 END, out,
    CASE WHEN shut THEN held WHEN ends AND NOT out AND i >= 60 AND abs(z) > 1.5 AND abs(z) <= 5 THEN CASE WHEN z > 0 THEN -1 ELSE 1 END ELSE 0 END, CASE WHEN held <> 0 THEN since ELSE i END,
    CASE WHEN trips THEN 'daily_circuit_breaker' WHEN ripe THEN CASE WHEN abs(z) > 5 THEN 'stop' WHEN abs(z) < 0.3 THEN 'revert' ELSE 'time' END ELSE 'end_of_data' END,
    CASE WHEN NOT shut THEN 0 WHEN trips OR ripe THEN floating ELSE closing END
  FROM (SELECT *, trips OR outed AS out, held <> 0 AND (trips OR ripe OR ends) AS shut FROM (SELECT *, NOT outed AND i >= 60 AND won + floating <= -25 AS trips,
      held <> 0 AND NOT (NOT outed AND i >= 60 AND won + floating <= -25) AND z IS NOT NULL AND (far OR i - since >= 40) AS ripe
    FROM (SELECT u.*, held, since, fa, fb, CASE WHEN run.day = u.day THEN won ELSE 0 END AS won, run.day = u.day AND outed AS outed,
        CASE WHEN held <> 0 AND since < u.i - 1 THEN held * ((ac - fa) - 0.8 * (bc - fb)) ELSE 0 END AS floating, CASE WHEN held = 0 THEN 0 WHEN since < u.i - 1 THEN held * ((ac - fa) - 0.8 * (bc - fb)) ELSE held * ((ac - ao) - 0.8 * (bc - bo)) END AS closing
      FROM run JOIN u ON u.pair = run.pair AND u.i = run.i + 1))))
SELECT pair, CASE WHEN was > 0 THEN 'LONG' ELSE 'SHORT' END AS side, opened AS entry_bar, i AS exit_bar, why, CASE WHEN i > opened + CASE why WHEN 'end_of_data' THEN 0 ELSE 1 END THEN 'filled' ELSE 'cancelled' END AS status, {r('gain')} AS pnl FROM run WHERE was <> 0"""


@query("x11_breaker_feedback", _BREAKER)
def breaker_feedback(spark, sf_dir):
    found = studies.breaker_positions(_pair_rows(spark, sf_dir), 0.25, 10_000.0, 1.5, 0.3, 5.0, 40, ratio=0.8, warmup=60)
    return rounded(found.select("pair", "side", "entry_bar", "exit_bar", "why", "status", "pnl"))


# Each possible entry with its own ratio held against the bars after it; then the first that each is free for.
_HEDGED = f"""{_PAIRS}, hc AS (SELECT *, CASE WHEN k = 30 THEN slope END AS ratio FROM (SELECT symbol AS pair, bar_idx AS i, ao, bo, ac, bc, count(*) OVER w AS k, regr_slope(ac, bc) OVER w AS slope, avg(ac) OVER w AS ma, avg(bc) OVER w AS mb, var_samp(ac) OVER w AS va, var_samp(bc) OVER w AS vb, covar_samp(ac, bc) OVER w AS ab
  FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))),
begins AS (SELECT pair, i AS e, ratio, CASE WHEN ez > 0 THEN -1 ELSE 1 END AS sgn FROM (SELECT *, CASE WHEN va + ratio * ratio * vb - 2 * ratio * ab > 0 THEN (ac - ratio * bc - (ma - ratio * mb)) / sqrt(va + ratio * ratio * vb - 2 * ratio * ab) END AS ez FROM hc WHERE k = 30) WHERE abs(ez) > 1.5 AND abs(ez) <= 5),
looks AS (SELECT b.*, h.i, CASE WHEN va + b.ratio * b.ratio * vb - 2 * b.ratio * ab > 0 THEN abs((ac - b.ratio * bc - (ma - b.ratio * mb)) / sqrt(va + b.ratio * b.ratio * vb - 2 * b.ratio * ab)) END AS hz FROM begins b JOIN hc h ON h.pair = b.pair AND h.i BETWEEN e + 1 AND e + 40),
hx AS (SELECT pair, e, any_value(ratio) AS ratio, any_value(sgn) AS sgn, min(i) FILTER (hz > 5 OR hz < 0.3 OR i = e + 40) AS x, arg_min(CASE WHEN hz > 5 THEN 'stop' WHEN hz < 0.3 THEN 'revert' ELSE 'time' END, i) FILTER (hz > 5 OR hz < 0.3 OR i = e + 40) AS why FROM looks GROUP BY 1, 2),
hn AS (SELECT o.*, (SELECT min(q.e) FROM hx q WHERE q.pair = o.pair AND q.e > o.x) AS n FROM hx o),
hp AS (SELECT pair, min(e) AS e FROM hn GROUP BY 1 UNION ALL SELECT hn.pair, hn.n FROM hp JOIN hn ON hn.pair = hp.pair AND hn.e = hp.e WHERE hn.n IS NOT NULL)
SELECT hx.pair, CASE WHEN sgn > 0 THEN 'LONG' ELSE 'SHORT' END AS side, hx.e AS entry_bar, x AS exit_bar, why, {r('hx.ratio')} AS ratio, {r('sgn * (c.ac - o.ao)')} AS pnl_a, {r('-sgn * hx.ratio * (c.bc - o.bo)')} AS pnl_b
FROM hx JOIN hp USING (pair, e) JOIN pr o ON o.symbol = hx.pair AND o.bar_idx = hx.e + 1 JOIN pr c ON c.symbol = hx.pair AND c.bar_idx = x WHERE x IS NOT NULL"""


@query("g4_i14_dynamic_hedge", _HEDGED)
def dynamic_hedge(spark, sf_dir):
    rows = tables.kept(studies.hedge_columns(_pair_rows(spark, sf_dir)), "hedge")
    taken = studies.hedged_positions(rows, 1.5, 0.3, 5.0, 40)
    t = studies.pair_trades(taken, rows).join(taken.select("pair", "entry_bar", "ratio"), ["pair", "entry_bar"])
    return rounded(t.select("pair", "side", "entry_bar", "exit_bar", "why", "ratio", "pnl_a", "pnl_b"))


@query("x9_t6_cancelled_legs", f"""{_walked('true')},
pf AS (SELECT a.symbol || '/' || b.symbol AS pair, a.ts, a.high AS ah, a.low AS al, b.high AS bh, b.low AS bl FROM bars a JOIN bars b ON a.ts = b.ts AND a.symbol < b.symbol),
pp AS (SELECT pr.symbol AS pair, bar_idx, ao, bo, ac, bc, ah, al, bh, bl FROM pr JOIN pf ON pf.pair = pr.symbol AND pf.ts = pr.ts),
pos AS (SELECT pair, opened AS e, i AS x, was FROM walk WHERE shut),
lg AS (SELECT p.*, l.leg, CASE WHEN (was > 0) = (l.leg = 'a') THEN 1 ELSE -1 END AS sgn FROM pos p, (VALUES ('a'), ('b')) l(leg)),
pt AS (SELECT pair, 'a' AS leg, bar_idx, ao AS o, ah AS h, al AS l, ac AS c FROM pp UNION ALL SELECT pair, 'b', bar_idx, bo, bh, bl, bc FROM pp),
lp AS (SELECT lg.*, pt.c * (1 - sgn * 0.2) AS lim FROM lg JOIN pt ON pt.pair = lg.pair AND pt.leg = lg.leg AND pt.bar_idx = e),
fl AS (SELECT lp.pair, lp.leg, e, min(bar_idx) AS f, arg_min(CASE WHEN sgn > 0 THEN least(o, lim) ELSE greatest(o, lim) END, bar_idx) AS price FROM lp JOIN pt ON pt.pair = lp.pair AND pt.leg = lp.leg AND bar_idx > e AND bar_idx < x AND CASE WHEN sgn > 0 THEN l <= lim ELSE h >= lim END GROUP BY 1, 2, 3)
SELECT lp.pair, lp.leg, lp.e AS entry_bar, x AS exit_bar, CASE WHEN sgn > 0 THEN 'LONG' ELSE 'SHORT' END AS side, CASE WHEN f IS NULL THEN 'cancelled' ELSE 'filled' END AS status, f AS fill_bar, {r('price')} AS fill_price, {r("sgn * CASE lp.leg WHEN 'a' THEN 1.0 ELSE 0.5 END * (c - price)")} AS pnl
FROM lp LEFT JOIN fl USING (pair, leg, e) JOIN pt ON pt.pair = lp.pair AND pt.leg = lp.leg AND pt.bar_idx = x""")
def cancelled_legs(spark, sf_dir):
    rows = _pair_rows(spark, sf_dir)
    found = studies.pair_orders(studies.pair_positions(rows, 1.5, 0.3, 5.0, 40), rows, 0.2, 0.5)
    return rounded(found.select("pair", "leg", "entry_bar", "exit_bar", "side", "status", "fill_bar", "fill_price", "pnl"))


@query("e8_spread_adx", f"{_PAIRS} SELECT symbol AS pair, bar_idx, {r('adx')} AS adx FROM adx_t")
def spread_adx(spark, sf_dir):
    return rounded(_pair_rows(spark, sf_dir, True).select("pair", "bar_idx", "adx"))


@query("g3_trend_signals", f"{WITH}, {_TRX}, {scan_sql('atr', 'x', 'tr', '1.0/14')}, q AS (SELECT *, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS m FROM atr_t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, bar_idx, {r('close - 2.0 * atr')} AS sl, {r('close + 3.0 * atr')} AS tp FROM q WHERE close > m AND atr IS NOT NULL AND bar_idx >= 50")
def trend(spark, sf_dir):
    by = Window.partitionBy("symbol").orderBy("bar_idx")
    f = rec.atr(base(spark, sf_dir), chunk=128).withColumn("sma", roll.sma(F.col("close"), by, 20))
    return rounded(studies.trend_signals(f).select("symbol", "bar_idx", "sl", "tp"))


# Zones as they are traded, written from their rules: gaps near a sweep, the close that turns them, then each bar's choices.
_ZONES = f"""{WITH}, {_TRX}, {scan_sql('atr', 'x', 'tr', '1.0/14')},
m AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, CASE WHEN count(high) OVER p = 8 THEN max(high) OVER p END AS sh, CASE WHEN count(low) OVER p = 8 THEN min(low) OVER p END AS sl FROM atr_t WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx), p AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, coalesce(atr <> 0 AND high > sh AND close < sh AND high - sh >= 0.02 * atr, false)::INT AS swept_bear, coalesce(atr <> 0 AND low < sl AND close > sl AND sl - low >= 0.02 * atr, false)::INT AS swept_bull FROM m),
z AS (SELECT symbol, bar_idx AS zone, CASE WHEN high < l2 AND max(swept_bear) OVER n = 1 THEN 'LONG' WHEN low > h2 AND max(swept_bull) OVER n = 1 THEN 'SHORT' END AS side, CASE WHEN high < l2 THEN l2 ELSE low END AS top, CASE WHEN high < l2 THEN high ELSE h2 END AS bottom FROM e WINDOW n AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
t AS (SELECT z.*, (SELECT min(b.bar_idx) FROM bars b WHERE b.symbol = z.symbol AND b.bar_idx > zone AND b.bar_idx <= zone + 8 AND CASE side WHEN 'LONG' THEN b.close > top ELSE b.close < bottom END) AS turned FROM z WHERE side IS NOT NULL AND top > bottom),
cd AS (SELECT t.symbol, b.bar_idx AS p, zone, side, turned, CASE side WHEN 'LONG' THEN top - 0.9 * (top - bottom) ELSE bottom + 0.9 * (top - bottom) END AS lp, CASE side WHEN 'LONG' THEN bottom - 0.8 * b.atr ELSE top + 0.8 * b.atr END AS sl, b.atr
  FROM t JOIN atr_t b ON b.symbol = t.symbol AND b.bar_idx > turned AND b.bar_idx - turned <= 8 WHERE b.atr > 0 AND b.bar_idx >= 50 AND (hour(b.ts) BETWEEN 7 AND 11 OR hour(b.ts) BETWEEN 13 AND 16) AND CASE side WHEN 'LONG' THEN b.close >= bottom ELSE b.close <= top END),
cand AS (SELECT *, row_number() OVER (PARTITION BY symbol, p ORDER BY side DESC, turned DESC, zone DESC) AS rk FROM (SELECT *, lp + CASE side WHEN 'LONG' THEN 0.4 ELSE -0.4 END * atr AS tp FROM cd) WHERE abs(lp - sl) > 0 AND abs(tp - lp) / abs(lp - sl) <= 5)"""


def _zone_signals(spark, sf_dir):
    h, lo, c = F.col("high"), F.col("low"), F.col("close")
    f = rec.atr(base(spark, sf_dir), chunk=128)
    f = tables.kept(roll.in_chunks(f, 8, lambda cut, by: cut.withColumns(roll.fair_value_gaps(h, lo, by) | roll.liquidity_sweeps(h, lo, c, F.col("atr"), by, 8, 0.02)), chunk=256), "zones")
    return studies.gap_zone_signals(f, 20, 8, 0.9, 0.8, 0.4, 5.0, "both", 50), f


@query("g2_j7_j8_j9_gap_zones", f"{_ZONES} SELECT symbol, p AS bar_idx, zone, side, {r('lp')} AS limit_price, {r('sl')} AS sl, {r('tp')} AS tp, 8 AS expiry FROM cand")
def gap_zones(spark, sf_dir):
    return rounded(_zone_signals(spark, sf_dir)[0].select("symbol", "bar_idx", "zone", "side", "limit_price", "sl", "tp", "expiry"))


@query("g2_x1_zone_orders", f"""{_ZONES.replace("cand AS", "asked AS")},
lk AS (SELECT g.*, b.bar_idx AS j, b.ts AS jt, CASE WHEN side = 'LONG' THEN least(b.open, lp) ELSE greatest(b.open, lp) END AS fill, CASE WHEN side = 'LONG' THEN b.low <= lp ELSE b.high >= lp END AS hit FROM asked g LEFT JOIN bars b ON g.symbol = b.symbol AND b.bar_idx BETWEEN p + 1 AND p + 8),
fills AS (SELECT symbol, p * 1000 + rk AS p, p AS placed, zone, side, any_value(sl) AS sl, any_value(tp) AS tp, min(j) FILTER (hit) AS fb, arg_min(fill, j) FILTER (hit) AS raw_fill, arg_min(jt, j) FILTER (hit) AS fill_ts, CASE WHEN count(*) FILTER (hit) > 0 THEN 'filled' WHEN max(j) >= p + 8 THEN 'expired' ELSE 'pending' END AS status FROM lk GROUP BY 1, lk.p, rk, zone, side),
sig AS (SELECT * FROM fills WHERE status = 'filled'), {_EXITS},
held AS (SELECT f.*, o.xb, o.reason, CASE f.status WHEN 'filled' THEN o.xb WHEN 'expired' THEN f.placed + 8 ELSE 1000000000 END AS free, f.side || f.zone AS unit FROM fills f LEFT JOIN out o ON o.symbol = f.symbol AND o.p = f.p),
pick AS (SELECT symbol, min(p) AS p, arg_min(free, p) AS free, [arg_min(unit, p)] AS used FROM held GROUP BY 1
  UNION ALL SELECT k.symbol, min(q.p), arg_min(q.free, q.p), list_append(k.used, arg_min(q.unit, q.p)) FROM pick k JOIN held q ON q.symbol = k.symbol AND q.placed > k.free AND NOT list_contains(k.used, q.unit) GROUP BY k.symbol, k.used)
SELECT h.symbol, placed AS placed_bar, zone, side, status, fb AS fill_bar, xb AS exit_bar, reason AS exit_reason, {r('raw_fill')} AS raw_fill FROM held h JOIN pick k ON k.symbol = h.symbol AND k.p = h.p""")
def zone_orders(spark, sf_dir):
    s, f = _zone_signals(spark, sf_dir)
    return rounded(studies.orders(f, tables.kept(s, "signals"), unit=studies.zone_unit()).select("symbol", "placed_bar", "zone", "side", "status", "fill_bar", "exit_bar", "exit_reason", "raw_fill"))


@query("x14_g5_multi_timeframe", f"""{_FEATS}, {_signals(name="all_sig")},
day AS (SELECT symbol, date_trunc('day', ts) AS ts, last(close ORDER BY ts) AS close, row_number() OVER (PARTITION BY symbol ORDER BY date_trunc('day', ts)) - 1 AS bar_idx FROM bars GROUP BY symbol, date_trunc('day', ts)), {scan_sql('trend', 'day', 'close', '2.0/6')},
shut AS (SELECT symbol, trend, coalesce(lead(ts) OVER w, ts + coalesce(ts - lag(ts) OVER w, INTERVAL 60 SECOND)) AS close_ts FROM trend_t WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
sig AS (SELECT g.* FROM all_sig g ASOF JOIN shut c ON g.symbol = c.symbol AND g.placed_ts >= c.close_ts WHERE CASE WHEN side = 'LONG' THEN placed_close > trend ELSE placed_close < trend END),
{_EXITS}, {_PLAIN} SELECT {_stats("symbol")} FROM net GROUP BY symbol""")
def multi_timeframe(spark, sf_dir):
    from ..sources import bars

    f = _feats(spark, sf_dir)
    daily = adapters.numbered(bars.resample(adapters.bars(spark, sf_dir), 86_400))
    trend = rec.ewm(daily, {"trend": ("close", rec.span(5))}, chunk=128).select("symbol", "ts", "trend")
    seen = align.attach_higher_timeframe(f, trend, {"trend": "daily_trend"})
    s = studies.cross_signals(seen)
    biased = s.join(seen.select("symbol", "bar_idx", "close", "daily_trend"), ["symbol", "bar_idx"])
    s = biased.where(F.when(F.col("side") == "LONG", F.col("close") > F.col("daily_trend")).otherwise(F.col("close") < F.col("daily_trend"))).select(*s.columns)
    return rounded(metrics.trade_stats(studies.backtest(seen, s), ("symbol",)))


@query("x8_a13_portfolio", f"""{_CROSS}, {_CHOSEN}, ranks AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS symbol_rank FROM (SELECT DISTINCT symbol FROM bars))
SELECT exit_ts AS ts, symbol_rank, {r('10000 + sum(pnl_net) OVER (ORDER BY exit_ts, symbol_rank)', 4)} AS equity FROM net JOIN ranks USING (symbol) WHERE reason <> 'end_of_data'""")
def portfolio(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    cash = t.where("exit_reason <> 'end_of_data'").select("symbol", F.col("exit_ts").alias("ts"), F.col("pnl_net").alias("cash"))
    e = metrics.global_equity(align.merge_symbols(cash, align.symbol_ranks(f)), 10_000.0)
    return e.select("ts", "symbol_rank", r(F.col("equity"), 4).alias("equity"))


@query("a13_portfolio_summary", f"""{_CROSS}, {_CHOSEN}, ranks AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM bars)), c AS (SELECT symbol, k, exit_ts, pnl_net FROM net JOIN ranks USING (symbol) WHERE reason <> 'end_of_data'),
e AS (SELECT *, 10000 + sum(pnl_net) OVER w AS eq FROM c WINDOW w AS (ORDER BY exit_ts, k)), d AS (SELECT *, greatest(10000, max(eq) OVER (ORDER BY exit_ts, k)) AS pk FROM e)
SELECT symbol, count(*) AS n, {r('100.0 * avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS win_rate, {r('sum(pnl_net)', 4)} AS pnl, {r('sum(pnl_net) / 100', 4)} AS total_return, NULL::DOUBLE AS max_dd FROM c GROUP BY 1
UNION ALL SELECT 'ALL', count(*), {r('100.0 * avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0.0 END)', 4)}, {r('sum(pnl_net)', 4)}, {r('sum(pnl_net) / 100', 4)}, {r('max(100 * (pk - eq) / pk)', 4)} FROM d""")
def portfolio_summary(spark, sf_dir):
    t, f = _traded(spark, sf_dir)
    return rounded(studies.portfolio_summary(t.where("exit_reason <> 'end_of_data'"), align.symbol_ranks(f), 10_000.0), 4)


@query("k2_trades_in_order", f"""{_CROSS}, {_CHOSEN} SELECT row_number() OVER (ORDER BY exit_ts, symbol, p) - 1 AS n, symbol, p AS placed_bar, exit_ts, {r('pnl_net')} AS pnl_net FROM net""")
def trades_in_order(spark, sf_dir):
    t, _ = _traded(spark, sf_dir)
    return rounded(studies.in_order(t, ("exit_ts", "symbol", "placed_bar"), "exit_ts").select("n", "symbol", "placed_bar", "exit_ts", "pnl_net"))


@query("t9_open_risk", f"""{_CROSS}, {_CHOSEN}, g AS (SELECT ts, sum(c) AS c, sum(k) AS k FROM (SELECT fill_ts AS ts, abs(fill_price - sl) AS c, 1 AS k FROM net UNION ALL SELECT exit_ts, -abs(fill_price - sl), -1 FROM net) GROUP BY 1)
SELECT ts, CAST(k AS BIGINT) AS opened, {r('sum(c) OVER (ORDER BY ts)', 4)} AS open_risk FROM g""")
def open_risk(spark, sf_dir):
    t, _ = _traded(spark, sf_dir)
    risk = F.abs(F.col("fill_price") - F.col("sl")) * F.col("size")
    up = t.select(F.col("fill_ts").alias("ts"), risk.alias("cash"), F.lit(1).alias("k"))
    down = t.select(F.col("exit_ts").alias("ts"), (-risk).alias("cash"), F.lit(-1).alias("k"))
    e = up.unionByName(down).groupBy("ts").agg(F.sum("cash").alias("cash"), F.sum("k").alias("k")).withColumn("symbol_rank", F.lit(0))
    return metrics.global_equity(e, 0.0).select("ts", F.col("k").alias("opened"), r(F.col("equity"), 4).alias("open_risk"))
