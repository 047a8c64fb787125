"""Fills and exits as first-touch joins, and the money that follows from them."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept
from . import chains

#: Bars in a block of the first-touch index.
BLOCK = 256


@dataclass(frozen=True)
class Costs:
    slippage: float = 0.0
    slippage_pct: float = 0.0
    spread: float = 0.0
    schedule: dict = field(default_factory=dict, hash=False)
    commission: float = 0.0
    commission_pct: float = 0.0
    lot: float = 1.0
    inverse_price: bool = False
    gap_fill: bool = True
    intrabar_path: bool = False
    #: Share of the best price that a trailing stop keeps away, 0: none; profit (share of the fill) it starts at.
    trail_pct: float = 0.0
    trail_activation: float = 0.0
    #: Profit (share of the fill) whose first bar moves the stop to the fill's price from the next bar on, 0: never.
    break_even: float = 0.0
    #: Slippage of market fills in multiples of the signal's `atr`.
    slippage_atr: float = 0.0


def resolve_fills(signals: DataFrame, bars: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """`signals` (symbol, bar_idx, side, order_type, limit_price, sl, tp, expiry) with fill_bar,
    fill_ts, raw_fill and status: filled, expired or pending (no bar left).

    Market orders fill at the next open, limits at the first of the next `expiry` bars (at least one)
    that reaches the price, at its open if it opens beyond. The look is bounded, so it is an equi-join.
    """
    s = signals.withColumnRenamed("bar_idx", "placed_bar").withColumn("_reach", F.when(F.col("order_type") == "limit", F.greatest("expiry", F.lit(1))).otherwise(1))
    looks = s.select("symbol", "placed_bar", "side", "order_type", "limit_price", "signal_id", F.explode(F.sequence(F.col("placed_bar") + 1, F.col("placed_bar") + F.col("_reach"))).alias("bar_idx"))
    at = looks.join(bars.select("symbol", "bar_idx", "ts", "open", "high", "low"), ["symbol", "bar_idx"])
    long = F.col("side") == "LONG"
    touched = (F.col("order_type") == "market") | F.when(long, F.col("low") <= F.col("limit_price")).otherwise(F.col("high") >= F.col("limit_price"))
    price = F.when(F.col("order_type") == "market", F.col("open")).when(long, F.least("open", "limit_price")).otherwise(F.greatest("open", "limit_price"))
    first = at.groupBy("symbol", "signal_id").agg(F.min_by(F.struct(F.col("bar_idx").alias("fill_bar"), F.col("ts").alias("fill_ts"), price.alias("raw_fill")), F.when(touched, F.col("bar_idx"))).alias("_f"), F.max("bar_idx").alias("_looked"))
    out = s.join(first, ["symbol", "signal_id"], "left")
    status = F.when(F.col("_f").isNotNull(), "filled").when(F.col("_looked") >= F.col("placed_bar") + F.col("_reach"), "expired").otherwise("pending")
    return out.select(*s.columns, F.col("_f.fill_bar"), F.col("_f.fill_ts"), F.col("_f.raw_fill"), status.alias("status")).drop("_reach")


def _extremes(below: DataFrame | None, bars: DataFrame, block: int, level: int) -> DataFrame:
    """(symbol, node, lo, hi) over groups of block^level bars, written once."""
    if below is None:
        rows = bars.select("symbol", F.floor(F.col("bar_idx") / block).alias("node"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    else:
        rows = below.withColumn("node", F.floor(F.col("node") / block))
    return kept(rows.groupBy("symbol", "node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"extremes-{level}")


def resolve_exits(filled: DataFrame, bars: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """Orders with exit_bar, exit_ts, raw_exit, exit_reason: the first bar after the fill that touches
    stop or target, else the last bar's close (`end_of_data`). Orders that aren't filled keep nulls there.

    The touch is looked up level by level, as in a tree of extremes: the rest of the fill's block of
    bars, the rest of that block's group of blocks, and so on outwards to the first group that reaches;
    then inwards to the first block in it that does, and to its bars. On each level a trade meets at
    most `block` rows of one group, by equality; there are as many levels as the longest series needs.
    """
    trades = filled.where("status = 'filled'")
    long = F.col("side") == "LONG"
    reach = F.when(long, (F.col("lo") <= F.col("sl")) | (F.col("hi") >= F.col("tp"))).otherwise((F.col("hi") >= F.col("sl")) | (F.col("lo") <= F.col("tp")))
    small = trades.select("symbol", "signal_id", "side", "sl", "tp", "fill_bar")
    levels, last = [], bars.agg(F.max("bar_idx")).first()[0] or 0
    while not levels or last >= block ** (len(levels) + 1):
        levels.append(_extremes(levels[-1] if levels else None, bars, block, len(levels) + 1))

    def first_in(spots: DataFrame, level: int) -> DataFrame:
        """symbol, signal_id and the first node of `level` after `after` in the group `up` that reaches."""
        nodes = levels[level - 1].select("symbol", F.col("node").alias("hit"), F.floor(F.col("node") / block).alias("up"), "lo", "hi")
        met = spots.join(nodes, ["symbol", "up"]).where((F.col("hit") > F.col("after")) & reach)
        return met.groupBy("symbol", "signal_id").agg(F.min("hit").alias("hit"))

    # outwards: on each level, the nodes after the fill's own within its group; the lowest level that hits wins
    found = None
    for level in range(1, len(levels) + 1):
        own = F.floor(F.col("fill_bar") / F.lit(block**level))
        hits = first_in(small.withColumns({"after": own, "up": F.floor(own / block)}), level).withColumn("level", F.lit(level))
        found = hits if found is None else found.unionByName(hits)
    hit = small.join(found.groupBy("symbol", "signal_id").agg(F.min_by("hit", "level").alias("hit"), F.min("level").alias("level")), ["symbol", "signal_id"], "left")
    # inwards: to the first child that reaches
    for level in range(len(levels) - 1, 0, -1):
        down = first_in(hit.where(F.col("level") > level).select(*small.columns, F.lit(-1).alias("after"), F.col("hit").alias("up")), level)
        hit = hit.join(down.withColumnRenamed("hit", "_down"), ["symbol", "signal_id"], "left").withColumn("hit", F.coalesce("_down", "hit")).withColumn("level", F.least("level", F.lit(level))).drop("_down")
    spots = hit.select(*small.columns, F.explode(F.array_compact(F.array(F.floor(F.col("fill_bar") / block), "hit"))).alias("block"))
    inside = bars.select("symbol", "bar_idx", "ts", "open", "high", "low", "close", F.floor(F.col("bar_idx") / block).alias("block"))
    at = spots.join(inside, ["symbol", "block"]).where(F.col("bar_idx") > F.col("fill_bar"))
    hit_sl = F.when(long, F.col("low") <= F.col("sl")).otherwise(F.col("high") >= F.col("sl"))
    hit_tp = F.when(long, F.col("high") >= F.col("tp")).otherwise(F.col("low") <= F.col("tp"))
    gap_sl = F.lit(costs.gap_fill) & F.when(long, F.col("open") <= F.col("sl")).otherwise(F.col("open") >= F.col("sl"))
    gap_tp = F.lit(costs.gap_fill) & F.when(long, F.col("open") >= F.col("tp")).otherwise(F.col("open") <= F.col("tp"))
    # with both inside one bar the stop counts, unless the bar's path says that the target came first
    tp_first = F.lit(costs.intrabar_path) & F.when(long, F.col("close") < F.col("open")).otherwise(F.col("close") >= F.col("open"))
    reason = F.when(gap_sl, "sl").when(gap_tp, "tp").when(hit_sl & hit_tp, F.when(tp_first, "tp").otherwise("sl")).when(hit_sl, "sl").otherwise("tp")
    price = F.when(gap_sl | gap_tp, F.col("open")).when(reason == "sl", F.col("sl")).otherwise(F.col("tp"))
    found = at.where(hit_sl | hit_tp).groupBy("symbol", "signal_id").agg(F.min_by(F.struct(F.col("bar_idx").alias("exit_bar"), F.col("ts").alias("exit_ts"), price.alias("raw_exit"), reason.alias("exit_reason")), "bar_idx").alias("_x"))
    ends = bars.groupBy("symbol").agg(F.max_by(F.struct(F.col("bar_idx").alias("exit_bar"), F.col("ts").alias("exit_ts"), F.col("close").alias("raw_exit"), F.lit("end_of_data").alias("exit_reason")), "bar_idx").alias("_e"))
    out = filled.join(found, ["symbol", "signal_id"], "left").join(ends, "symbol").withColumn("_x", F.when(F.col("status") == "filled", F.coalesce("_x", "_e")))
    return out.select(*filled.columns, "_x.*")


def _fill_price(costs: Costs, columns: list[str]) -> Column:
    """The price paid: slippage raises it on either side for market orders, long ones pay the spread."""
    slip = F.col("raw_fill") * costs.slippage_pct + costs.slippage
    if costs.slippage_atr:
        if "atr" not in columns:
            raise ValueError("slippage by atr needs signals with atr")
        slip = slip + F.col("atr") * costs.slippage_atr
    return F.col("raw_fill") + F.when(F.col("order_type") == "market", slip).otherwise(0.0) + F.when(F.col("side") == "LONG", spread_at(F.col("fill_ts"), costs)).otherwise(0.0)


#: Nodes in a group of the tree that moving stops are looked up in.
GROUP = 64


def _stop_tree(bars: DataFrame, trail_pct: float, group: int) -> list[DataFrame]:
    """Levels of (symbol, node, lo, hi, falls, rises), the bars first, then groups of `group` nodes each, written once.

    `falls`: some bar's low is `trail_pct` or more below the highest high from the node's start up to that bar; `rises`
    is the same for highs above the lowest low. Both are put together from a group's nodes: one falls by itself, or
    its low is that far below the highest high of those before it.
    """
    down, up = 1.0 - trail_pct, 1.0 + trail_pct
    levels = [bars.select("symbol", F.col("bar_idx").alias("node"), F.col("low").alias("lo"), F.col("high").alias("hi"), (F.col("low") <= F.col("high") * down).alias("falls"), (F.col("high") >= F.col("low") * up).alias("rises"))]
    before = Window.partitionBy("symbol", "_up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    last = bars.agg(F.max("bar_idx")).first()[0] or 0
    while last >= group ** len(levels):
        at = levels[-1].withColumn("_up", F.floor(F.col("node") / group))
        at = at.withColumns({"falls": F.col("falls") | F.coalesce(F.col("lo") <= F.max("hi").over(before) * down, F.lit(False)), "rises": F.col("rises") | F.coalesce(F.col("hi") >= F.min("lo").over(before) * up, F.lit(False))})
        levels.append(kept(at.groupBy("symbol", F.col("_up").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("falls").alias("falls"), F.bool_or("rises").alias("rises")), f"stops-{len(levels)}"))
    return levels


def _first_bar(levels: list[DataFrame], asks: DataFrame, keys: list[str], hit: Column, group: int) -> DataFrame:
    """`asks` (`keys`, symbol, side, after, more) with `bar`, the first bar behind `after` for which `hit`, and `best`, the
    best price of the bars between both (null: none). `hit` sees a node's lo, hi, falls, rises and its own such `best`;
    it must hold for a node if it does for one of its bars.

    Outwards, each level looks at the nodes behind the one it came from, in the same group; inwards, at the nodes of the
    group found. So an ask meets at most `group` nodes a level, by equality.
    """
    long, own = F.col("side") == "LONG", asks.columns
    before = Window.partitionBy(*keys).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    better = lambda hi, lo: F.when(long, F.greatest(hi, "best")).otherwise(F.least(lo, "best"))

    def met(state: DataFrame, level: int, up: Column, behind: Column) -> DataFrame:
        nodes = levels[level].select(F.col("symbol").alias("_symbol"), F.floor(F.col("node") / group).alias("_of"), "node", "lo", "hi", "falls", "rises")
        spots = state.withColumns({"_up": up, "_behind": behind})
        at = spots.join(nodes, (F.col("symbol") == F.col("_symbol")) & (F.col("_up") == F.col("_of")) & (F.col("node") > F.col("_behind")), "left")
        at = at.withColumns({"_end": better(F.col("hi"), F.col("lo")), "best": better(F.max("hi").over(before), F.min("lo").over(before))})
        ends = F.when(long, F.max("_end")).otherwise(F.min("_end"))
        rows = at.groupBy(*own, "bar", "level").agg(F.min_by(F.struct("node", "best"), F.when(hit, F.col("node"))).alias("_x"), ends.alias("_end"), F.first("best", ignorenulls=False).alias("_kept"))
        return rows.select(*own, F.coalesce("_x.node", "bar").alias("bar"), F.when(F.col("_x").isNotNull(), F.lit(level)).otherwise(F.col("level")).alias("level"), F.when(F.col("_x").isNotNull(), F.col("_x.best")).otherwise(F.coalesce("_end", "_kept")).alias("best"))

    state = asks.withColumns({"bar": F.lit(None).cast("long"), "level": F.lit(None).cast("int"), "best": F.lit(None).cast("double")})
    for level in range(len(levels)):
        at = F.floor(F.col("after") / F.lit(group**level))
        state = met(state, level, F.when(F.col("bar").isNull(), F.floor(at / group)), at)
    for level in range(len(levels) - 2, -1, -1):
        state = met(state, level, F.when(F.col("level") == level + 1, F.col("bar")), F.lit(-1))
    return state.drop("level")


def resolve_trailing_exits(filled: DataFrame, bars: DataFrame, costs: Costs, group: int = GROUP) -> DataFrame:
    """`resolve_exits` with a stop that moves and never widens. At each bar it is the best of the order's stop, the best
    price since the fill less `trail_pct` once that price is `trail_activation` above the fill, and the fill's price
    on bars behind the first whose profit is `break_even` or more. Bars must have low <= open, close <= high.

    A gap at the open is held against the stop of the bar before, the rest of the bar against its own.

    A trade trails from the bar that reaches the activation, which is then its best price; what follows depends on that
    bar alone, so trades (of a sweep, say) that start to trail together are looked up once. All looks go through a tree
    of groups (`_stop_tree`), logarithmic in how long the trade lasts.
    """
    long = F.col("side") == "LONG"
    levels = _stop_tree(bars, costs.trail_pct, group)
    trades = kept(filled.where("status = 'filled'").select("symbol", "signal_id", "side", "sl", "tp", "fill_bar", _fill_price(costs, filled.columns).alias("_paid")), "open")
    reached = F.when(long, (F.col("hi") - F.col("_paid")) / F.col("_paid")).otherwise((F.col("_paid") - F.col("lo")) / F.col("_paid"))
    asked = {"fixed": F.when(long, (F.col("lo") <= F.col("sl")) | (F.col("hi") >= F.col("tp"))).otherwise((F.col("hi") >= F.col("sl")) | (F.col("lo") <= F.col("tp")))}
    if costs.trail_pct:
        asked["trails"] = reached >= costs.trail_activation
    if costs.break_even:
        asked["even"] = reached >= costs.break_even
    hit = F.lit(False)
    for kind, when in asked.items():
        hit = F.when(F.col("kind") == kind, when).otherwise(hit)
    asks = trades.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in asked)))).withColumn("after", F.col("fill_bar"))
    seen = _first_bar(levels, asks, ["symbol", "signal_id", "kind"], hit, group)
    bar_of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("bar"))).alias(f"_{kind}")
    seen = kept(seen.groupBy(*trades.columns).agg(*(bar_of(kind) for kind in ("fixed", "trails", "even"))), "starts")
    if costs.trail_pct:
        trail = F.when(long, F.col("falls") | F.coalesce(F.col("lo") <= F.col("best") * (1.0 - costs.trail_pct), F.lit(False))).otherwise(F.col("rises") | F.coalesce(F.col("hi") >= F.col("best") * (1.0 + costs.trail_pct), F.lit(False)))
        starts = seen.where("_trails is not null").select("symbol", "side", (F.col("_trails") - 1).alias("after")).distinct()
        trailed = _first_bar(levels, starts, ["symbol", "side", "after"], trail, group).select("symbol", "side", (F.col("after") + 1).alias("_trails"), F.col("bar").alias("_trail_bar"), F.col("best").alias("_was"))
        seen = seen.join(trailed, ["symbol", "side", "_trails"], "left")
    else:
        seen = seen.withColumns({"_trail_bar": F.lit(None).cast("long"), "_was": F.lit(None).cast("double")})
    if costs.break_even:
        back = F.when(long, F.col("lo") <= F.col("_paid")).otherwise(F.col("hi") >= F.col("_paid"))
        backs = _first_bar(levels, seen.where("_even is not null").select("symbol", "signal_id", "side", "_paid", F.col("_even").alias("after")), ["symbol", "signal_id"], back, group)
        seen = seen.join(backs.select("symbol", "signal_id", F.col("bar").alias("_back")), ["symbol", "signal_id"], "left")
    else:
        seen = seen.withColumn("_back", F.lit(None).cast("long"))
    at = seen.withColumn("bar_idx", F.least("_fixed", "_trail_bar", "_back")).join(bars.select("symbol", "bar_idx", "ts", "open", "high", "low", "close"), ["symbol", "bar_idx"])
    # the trailing stop only matters at the bar that touches it, `_was` being the best price before that bar
    trails, even = F.col("bar_idx") == F.col("_trail_bar"), F.when(F.col("bar_idx") > F.col("_even"), F.col("_paid"))
    best = F.when(long, F.greatest("high", "_was")).otherwise(F.least("low", "_was"))
    tightest = lambda b: F.when(long, F.greatest("sl", even, F.when(trails, b * (1.0 - costs.trail_pct)))).otherwise(F.least("sl", even, F.when(trails, b * (1.0 + costs.trail_pct))))
    at = at.withColumns({"_stop": tightest(best), "_held": tightest(F.col("_was"))})
    gap_sl = F.lit(costs.gap_fill) & F.when(long, F.col("open") <= F.col("_held")).otherwise(F.col("open") >= F.col("_held"))
    gap_tp = F.lit(costs.gap_fill) & F.when(long, F.col("open") >= F.col("tp")).otherwise(F.col("open") <= F.col("tp"))
    hit_sl = F.when(long, F.col("low") <= F.col("_stop")).otherwise(F.col("high") >= F.col("_stop"))
    hit_tp = F.when(long, F.col("high") >= F.col("tp")).otherwise(F.col("low") <= F.col("tp"))
    tp_first = F.lit(costs.intrabar_path) & F.when(long, F.col("close") < F.col("open")).otherwise(F.col("close") >= F.col("open"))
    reason = F.when(gap_sl, "sl").when(gap_tp, "tp").when(hit_sl & hit_tp, F.when(tp_first, "tp").otherwise("sl")).when(hit_sl, "sl").otherwise("tp")
    price = F.when(gap_sl | gap_tp, F.col("open")).when(reason == "sl", F.col("_stop")).otherwise(F.col("tp"))
    found = at.select("symbol", "signal_id", F.struct(F.col("bar_idx").alias("exit_bar"), F.col("ts").alias("exit_ts"), price.alias("raw_exit"), reason.alias("exit_reason")).alias("_x"))
    ends = bars.groupBy("symbol").agg(F.max_by(F.struct(F.col("bar_idx").alias("exit_bar"), F.col("ts").alias("exit_ts"), F.col("close").alias("raw_exit"), F.lit("end_of_data").alias("exit_reason")), "bar_idx").alias("_e"))
    out = filled.join(found, ["symbol", "signal_id"], "left").join(ends, "symbol").withColumn("_x", F.when(F.col("status") == "filled", F.coalesce("_x", "_e")))
    return out.select(*filled.columns, "_x.*")


def spread_at(ts: Column, costs: Costs) -> Column:
    if not costs.spread or not costs.schedule:
        return F.lit(float(costs.spread))
    hours = sorted(costs.schedule)
    factor = [costs.schedule[max((h for h in hours if h <= hour), default=hours[-1])] for hour in range(24)]
    return F.element_at(F.array(*(F.lit(float(f)) for f in factor)), F.hour(ts) + 1) * costs.spread


def priced(trades: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """fill_price, exit_price, pnl_gross, commission (both halves), pnl_net (exit half) and pnl_all_in.

    Slippage raises the price of market fills on either side; long entries and short exits pay the
    spread of their hour. The percentage commission is per unit, half at each end.
    """
    long = F.col("side") == "LONG"
    fill = _fill_price(costs, trades.columns)
    out = F.col("raw_exit") + F.when(long, 0.0).otherwise(spread_at(F.col("exit_ts"), costs))
    rows = trades.withColumns({"fill_price": fill, "exit_price": out})
    to_usd = F.when(F.col("exit_price") > 0, 1 / F.col("exit_price")).otherwise(1.0) if costs.inverse_price else F.lit(1.0)
    gross = F.when(long, F.col("exit_price") - F.col("fill_price")).otherwise(F.col("fill_price") - F.col("exit_price")) * F.col("size") * to_usd
    half = (F.col("size") / costs.lot * costs.commission + F.col("size") * costs.commission_pct) / 2
    rows = rows.withColumns({"pnl_gross": gross, "commission": 2 * half})
    return rows.withColumns({"pnl_net": F.col("pnl_gross") - F.col("commission") / 2, "pnl_all_in": F.col("pnl_gross") - F.col("commission")})


@dataclass(frozen=True)
class Sizing:
    """How many units an order is for: `fixed_size` (value units), `fixed_risk` (value in money to the
    stop) or `pct_equity` (that share of equity to the stop). Steps round half to even; the notional is at
    most `leverage` times equity (0: no bound). Without a distance to the stop: `least`."""

    mode: str = "fixed_size"
    value: float = 1.0
    step: float = 1.0
    least: float = 0.0
    leverage: float = 0.0
    equity: float = 10_000.0


def position_size(price: Column, sl: Column, sizing: Sizing = Sizing(), equity: Column | None = None, to_usd: Column | float = 1.0) -> Column:
    """Units of an order at `price` with its stop at `sl`."""
    dist, least = F.abs(price - sl), F.lit(float(sizing.least))
    if sizing.mode == "fixed_size":
        return F.when(dist > 0, F.lit(float(sizing.value))).otherwise(least)
    equity = F.lit(sizing.equity) if equity is None else equity
    risk = equity * sizing.value if sizing.mode == "pct_equity" else F.lit(float(sizing.value))
    size = F.greatest(F.bround(risk / (dist * to_usd) / sizing.step) * sizing.step, least)
    if sizing.leverage:
        cap, unit = equity * sizing.leverage, price * to_usd
        size = F.when((equity > 0) & (unit > 0) & (size * unit > cap), F.greatest(F.floor(cap / unit / sizing.step) * sizing.step, least)).otherwise(size)
    return F.when(dist > 0, size).otherwise(least)


def _units(price: float, sl: float, sizing: Sizing, equity: float, to_usd: float) -> float:
    """`position_size` for one order."""
    dist, unit = abs(price - sl), price * to_usd
    if dist <= 0:
        return sizing.least
    if sizing.mode == "fixed_size":
        return sizing.value
    risk = equity * sizing.value if sizing.mode == "pct_equity" else sizing.value
    size = max(sizing.least, round(risk / (dist * to_usd) / sizing.step) * sizing.step)
    if sizing.leverage and equity > 0 and unit > 0 and size * unit > sizing.leverage * equity:
        size = max(sizing.least, math.floor(sizing.leverage * equity / unit / sizing.step) * sizing.step)
    return size


def select_trades(candidates: DataFrame, most_open: int = 1, keys=("symbol",), once_a_direction: bool = False, chunk: int = chains.CHUNK, unit: Column | None = None) -> DataFrame:
    """The candidates that a trader with `most_open` places takes, in order of placed_bar; of one `unit`, if there
    are units (zones), only one order is ever placed.

    Nothing is placed while an order is pending; an exit frees its place from the next bar on. Each
    outcome is known beforehand, so with one place a candidate says which bar the next one must lie beyond, and
    the choice is a chain (`chains.chained`), cut at `chunk` bars. With more places it is one group a series,
    over candidates, not bars.
    """
    if most_open == 1:
        if unit is not None and once_a_direction:
            raise ValueError("units and once_a_direction don't go together")
        free = F.when(F.col("status") == "filled", F.col("exit_bar")).when(F.col("status") == "expired", F.col("placed_bar") + F.col("expiry"))
        if unit is not None:
            return chains.matched(candidates, F.col("placed_bar"), free, unit, keys, chunk=chunk)
        return chains.chained(candidates, F.col("placed_bar"), free, keys, F.col("side") if once_a_direction else None, chunk=chunk)
    import pandas as pd

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["placed_bar", "signal_id"])
        trader, keep, used = _Trader(most_open, once_a_direction), [], set()
        for row in part.itertuples():
            if not (row.unit_ and row.unit_ in used) and trader.takes(row):
                keep.append(row.Index)
                used.add(row.unit_)
        return part.loc[keep].drop(columns="unit_")

    return candidates.withColumn("unit_", F.lit(None).cast("string") if unit is None else unit.cast("string")).groupBy(*keys).applyInPandas(choose, candidates.schema)


class _Trader:
    """Which candidates of one series are taken, asked in their order."""

    def __init__(self, most_open: int, once_a_direction: bool):
        self.most_open, self.once = most_open, once_a_direction
        self.busy: list[int] = []
        self.pending: float = -1
        self.last = None

    def admits(self, row) -> bool:
        while self.busy and self.busy[0] < row.placed_bar:
            heapq.heappop(self.busy)
        return not (row.placed_bar <= self.pending or len(self.busy) >= self.most_open or self.once and row.side == self.last)

    def place(self, row) -> None:
        self.last = row.side
        if row.status == "filled":
            self.pending = row.fill_bar
            heapq.heappush(self.busy, row.exit_bar)
        else:
            self.pending = row.placed_bar + row.expiry if row.status == "expired" else math.inf

    def takes(self, row) -> bool:
        if not self.admits(row):
            return False
        self.place(row)
        return True


def select_sized_trades(units: DataFrame, sizing: Sizing, most_open: int = 1, keys=("symbol",), once_a_direction: bool = False, inverse_price: bool = False, most_positions: int | None = None, most_risk: float | None = None) -> DataFrame:
    """`select_trades` with sizes by the equity at hand. `units`: candidates priced for one unit each, with
    placed_ts; size, pnl_gross, commission, pnl_net and pnl_all_in become those of the order's size.

    `keys` name what shares one equity: a series, or a portfolio of several `symbol`s, each with its own
    `most_open`. An order's equity has the fills and exits before it, in the order of (time, rank): `symbol_rank`
    if `units` have one (the portfolio's own order), else the symbols' names; its own bar's come after it.

    Two caps hold over all symbols of a key, if given: an order is refused while `most_positions` positions are open,
    or if its risk (distance of its price to the stop, times size) and that of the open positions (from their fill
    prices) come to more than `most_risk`. One group a key, over candidates, not bars.
    """
    import pandas as pd

    money = ["size", "pnl_gross", "commission", "pnl_net", "pnl_all_in"]
    rank = F.col("symbol_rank") if "symbol_rank" in units.columns else F.col("symbol")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["placed_ts", "rank_", "placed_bar", "signal_id"]).reset_index(drop=True)
        traders: dict = {}
        equity, open_, risk, waiting, keep, sizes = sizing.equity, 0, 0.0, [], [], []
        for row in part.itertuples():
            now = (row.placed_ts, row.rank_)
            while waiting and waiting[0][:2] < now:
                *_, cash, count, at_risk = heapq.heappop(waiting)
                equity, open_, risk = equity + cash, open_ + count, risk + at_risk
            trader = traders.setdefault(row.symbol, _Trader(most_open, once_a_direction))
            if not trader.admits(row):
                continue
            size = _units(row.limit_price, row.sl, sizing, equity, 1 / row.limit_price if inverse_price and row.limit_price > 0 else 1.0)
            if most_positions is not None and open_ >= most_positions or most_risk is not None and risk + abs(row.limit_price - row.sl) * size > most_risk:
                continue
            trader.place(row)
            keep.append(row.Index)
            sizes.append(size)
            if row.status == "filled":
                own = abs(row.fill_price - row.sl) * size
                heapq.heappush(waiting, (row.fill_ts, row.rank_, 0, row.Index, -row.commission / 2 * size, 1, own))
                heapq.heappush(waiting, (row.exit_ts, row.rank_, 1, row.Index, row.pnl_net * size, -1, -own))
        out = part.loc[keep].drop(columns="rank_")
        for name in money:
            out[name] = out[name] * sizes
        return out

    units = units.withColumn("size", F.lit(1.0))
    return units.withColumn("rank_", rank).groupBy(*keys).applyInPandas(choose, units.schema)
