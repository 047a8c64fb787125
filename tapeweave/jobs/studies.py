"""Studies: backtests, splits, sweeps, walk-forward, bootstrap, account rules, pairs."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import recursive as rec
from ..functions import rolling
from ..operators import chains, exits, metrics, slices
from ..operators.exits import Costs, Sizing
from ..sources.tables import kept

# --- signals -------------------------------------------------------------------------------------


def cross_signals(rows: DataFrame, fast: str = "ema_fast", slow: str = "ema_slow", k: float = 2.0, rr: float = 1.5, warmup: int = 50, session: str = "all", keys=("symbol",)) -> DataFrame:
    """Market orders where the fast average crosses the slow one; stops by `atr`. Rows of one bar a signal."""
    f, s, c = F.col(fast), F.col(slow), F.col("close")

    def crossed(cut: DataFrame, by: WindowSpec) -> DataFrame:
        f1, s1 = F.lag(f).over(by), F.lag(s).over(by)
        return cut.withColumn("side", F.when((f1 <= s1) & (f > s), "LONG").when((f1 >= s1) & (f < s), "SHORT"))

    out = rolling.in_chunks(rows, 1, crossed, keys).where(F.col("side").isNotNull() & F.col("atr").isNotNull() & (F.col("bar_idx") >= warmup)).where(slices.in_session(F.col("ts"), session))
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    return out.select(*keys, "bar_idx", "side", F.lit("market").alias("order_type"), c.alias("limit_price"), (c - sign * k * F.col("atr")).alias("sl"), (c + sign * k * rr * F.col("atr")).alias("tp"), F.lit(1).alias("expiry"), F.col("bar_idx").alias("signal_id"), F.lit(1.0).alias("size"))


def trend_signals(rows: DataFrame, sma: str = "sma", k: float = 2.0, rr: float = 1.5, warmup: int = 50, keys=("symbol",)) -> DataFrame:
    """Long market orders while the close is above its average."""
    c = F.col("close")
    out = rows.where((c > F.col(sma)) & F.col("atr").isNotNull() & (F.col("bar_idx") >= warmup))
    return out.select(*keys, "bar_idx", F.lit("LONG").alias("side"), F.lit("market").alias("order_type"), c.alias("limit_price"), (c - k * F.col("atr")).alias("sl"), (c + k * rr * F.col("atr")).alias("tp"), F.lit(1).alias("expiry"), F.col("bar_idx").alias("signal_id"), F.lit(1.0).alias("size"))


def gap_zones(rows: DataFrame, near: int = 20, most_age: int = 45, keys=("symbol",), chunk: int = chains.CHUNK) -> DataFrame:
    """Gap zones that have turned (zone: the gap's bar, side they are traded to, top, bottom, turned).

    A gap counts if a sweep of its side stands in the `near` bars before it; it turns at the first
    close beyond it within `most_age` bars: gaps up to short zones, gaps down to long ones. `rows`: bars with gap
    and sweep flags. All looks are bounded, so they are equi-joins on the bar.
    """
    seen = lambda cut, by: cut.withColumns({f"_{s}": F.max(F.col(f"sweep_{s}").cast("int")).over(by.rowsBetween(-near, -1)) for s in ("bear", "bull")})
    side = F.when(F.col("fvg_bear") & (F.col("_bear") == 1), "LONG").when(F.col("fvg_bull") & (F.col("_bull") == 1), "SHORT")
    zones = rolling.in_chunks(rows, near, seen, keys, chunk=chunk).withColumn("side", side).where("side is not null and fvg_top > fvg_bottom").select(*keys, F.col("bar_idx").alias("zone"), "side", F.col("fvg_top").alias("top"), F.col("fvg_bottom").alias("bottom"))
    ahead = zones.withColumn("bar_idx", F.explode(F.expr(f"sequence(zone + 1, zone + {most_age})")))
    beyond = F.when(F.col("side") == "LONG", F.col("close") > F.col("top")).otherwise(F.col("close") < F.col("bottom"))
    return ahead.join(rows.select(*keys, "bar_idx", "close"), [*keys, "bar_idx"]).where(beyond).groupBy(*keys, "zone", "side", "top", "bottom").agg(F.min("bar_idx").alias("turned"))


def gap_zone_signals(rows: DataFrame, near: int = 20, most_age: int = 45, entry_pct: float = 1.0, atr_sl: float = 1.5, tp_atr: float = 2.0, max_rr: float = 5.0, session: str = "all", warmup: int = 0, keys=("symbol",)) -> DataFrame:
    """Limit orders into turned gap zones: a candidate for each bar of the session and each zone that turned in the
    `most_age` bars before it and that the close isn't beyond.

    The price lies `entry_pct` into the zone (0: the near edge, 1: the far one), the stop `atr_sl` times atr outside of
    the zone, the target `tp_atr` times atr from the price; candidates whose target is more than `max_rr` times as far as
    their stop are left out. Of a bar's candidates, short ones come first, then the latest turned, the latest gap;
    signal_id has that order. Which are placed, one a bar and each zone once, depends on the trader:
    `exits.select_trades` with `zone_unit()`.
    """
    active = gap_zones(rows, near, most_age, keys).withColumn("bar_idx", F.explode(F.expr(f"sequence(turned + 1, turned + {most_age})")))
    at = active.join(rows.select(*keys, "bar_idx", "ts", "close", "atr"), [*keys, "bar_idx"]).where((F.col("atr") > 0) & (F.col("bar_idx") >= warmup) & slices.in_session(F.col("ts"), session))
    long, c, depth = F.col("side") == "LONG", F.col("close"), entry_pct * (F.col("top") - F.col("bottom"))
    at = at.where(F.when(long, c >= F.col("bottom")).otherwise(c <= F.col("top")))
    price = F.when(long, F.col("top") - depth).otherwise(F.col("bottom") + depth)
    sl = F.when(long, F.col("bottom") - atr_sl * F.col("atr")).otherwise(F.col("top") + atr_sl * F.col("atr"))
    at = at.withColumns({"limit_price": price, "sl": sl}).withColumn("tp", F.col("limit_price") + F.when(long, tp_atr).otherwise(-tp_atr) * F.col("atr"))
    dist = F.abs(F.col("limit_price") - F.col("sl"))
    at = at.where((dist > 0) & (F.abs(F.col("tp") - F.col("limit_price")) / dist <= max_rr))
    # a bar has at most 2 * most_age zones of a side
    rank = F.row_number().over(Window.partitionBy(*keys, "bar_idx").orderBy(F.col("side").desc(), F.col("turned").desc(), F.col("zone").desc()))
    return at.select(*keys, "bar_idx", "zone", "side", F.lit("limit").alias("order_type"), "limit_price", "sl", "tp", F.lit(most_age).alias("expiry"), (F.col("bar_idx") * (4 * most_age + 1) + rank).alias("signal_id"), F.lit(1.0).alias("size"))


def zone_unit() -> Column:
    """What is traded once: a zone and its side."""
    return F.concat_ws(":", "side", "zone")


# --- backtests -----------------------------------------------------------------------------------


def features(rows: DataFrame, fast: int = 10, slow: int = 30, n: int = 14, keys=("symbol",), chunk: int = rec.CHUNK) -> DataFrame:
    """`rows` with ema_fast, ema_slow and atr, written once: a backtest reads them many times."""
    ranged = rolling.in_chunks(rows, 1, lambda cut, by: cut.withColumn("_tr", rolling.true_range(F.col("high"), F.col("low"), F.col("close"), by)), keys, chunk=chunk)
    all_ = {"ema_fast": ("close", rec.span(fast)), "ema_slow": ("close", rec.span(slow)), "atr": ("_tr", 1.0 / n)}
    return kept(rec.ewm(ranged, all_, keys, chunk=chunk).drop("_tr"), "features")


def orders(rows: DataFrame, signals: DataFrame, costs: Costs = Costs(), most_open: int = 1, keys=("symbol",), once_a_direction: bool = False, sizing: Sizing | None = None, capital=None, unit: Column | None = None, ranks: DataFrame | None = None, most_positions: int | None = None, most_risk: float | None = None) -> DataFrame:
    """The orders that a trader places of `signals` on `rows`: filled ones with their exits and prices,
    expired and pending ones with nulls there. `unit`: what only one order is placed of.

    With `sizing`, sizes follow from the equity at hand; `capital`: keys that share one equity (those of
    the run if none), with `ranks` (symbol, symbol_rank) as the order of their symbols at equal times and caps on open
    positions and risk over all of them. Exits trail or break even where the costs say so.
    """
    filled = kept(exits.resolve_fills(signals, rows, costs), "fills")
    resolve = exits.resolve_trailing_exits if costs.trail_pct or costs.break_even else exits.resolve_exits
    resolved = resolve(filled, rows, costs)
    if sizing is None:
        return exits.priced(exits.select_trades(resolved, most_open, keys, once_a_direction, unit=unit), costs)
    placed = rows.select("symbol", F.col("bar_idx").alias("placed_bar"), F.col("ts").alias("placed_ts"))
    units = exits.priced(resolved.join(placed, ["symbol", "placed_bar"]).withColumn("size", F.lit(1.0)), costs)
    if ranks is not None:
        units = units.join(ranks.select("symbol", "symbol_rank"), "symbol")
    return exits.select_sized_trades(units, sizing, most_open, capital or keys, once_a_direction, costs.inverse_price, most_positions, most_risk)


def backtest(rows: DataFrame, signals: DataFrame, costs: Costs = Costs(), most_open: int = 1, keys=("symbol",)) -> DataFrame:
    """Closed trades of `signals` on `rows`: fills, exits, the trader's choice, prices and profit."""
    return kept(orders(rows, signals, costs, most_open, keys).where("status = 'filled'"), "trades")


def run_splits(rows: DataFrame, splits: DataFrame, warmup: int = 50, costs: Costs = Costs()) -> DataFrame:
    """The cross backtest on every date split at once: `symbol` names split and symbol, and numbers,
    averages and equity start anew in each."""
    from ..sources.adapters import numbered

    cut = slices.split_by_dates(rows.drop("bar_idx"), splits, warmup)
    named = numbered(cut.withColumn("symbol", F.concat_ws("|", "split", "symbol")).drop("split"))
    feats = features(named)
    return backtest(feats, cross_signals(feats, warmup=warmup), costs)


def param_grid(spark: SparkSession, grid: dict[str, list], most: int = 500) -> DataFrame:
    """All combinations in order of the keys, with combo_id; empty or too many are errors."""
    combos = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())] if grid else []
    if not combos or len(combos) > most:
        raise ValueError(f"{len(combos)} combinations; between 1 and {most} are allowed")
    return spark.createDataFrame([(i, *c.values()) for i, c in enumerate(combos)], ["combo_id", *grid])


@dataclass(frozen=True)
class Param:
    """A parameter of a strategy: `options` to choose from, or a number that moves in steps of `step` (whole ones by 1, others
    by 0.1 if not given) between `least` and `most`. Other values are fixed."""

    default: object = None
    step: float | None = None
    least: float | None = None
    most: float | None = None
    options: tuple = ()

    def around(self, value, reach: int = 2) -> list:
        """What a sweep tries: all options, or `value` and those `reach` steps away, as far as the bounds let them."""
        if self.options:
            return list(self.options)
        if isinstance(value, bool) or not isinstance(value, int | float):
            return [value]
        whole = isinstance(value, int)
        away = reach * (self.step or (1 if whole else 0.1))
        least = self.least if self.least is not None else 1 if whole else value - away
        low, high = max(value - away, least), min(value + away, value + away if self.most is None else self.most)
        return sorted({int(x) if whole else round(float(x), 6) for x in (low, value, high)})


def default_grid(params: dict, current: dict | None = None) -> dict[str, list]:
    """The grid for `param_grid` that follows from parameters (a `Param`, or a fixed value) and the values in use."""
    described = {name: p if isinstance(p, Param) else Param(p, options=(p,)) for name, p in params.items()}
    return {name: p.around((current or {}).get(name, p.default)) for name, p in described.items()}


def sweep_signals(feats: DataFrame, grid: DataFrame, warmup: int = 50) -> DataFrame:
    """Cross signals for every (k, rr) of `grid`: the few crossings are multiplied, never the bars."""
    base = cross_signals(feats, k=1.0, rr=1.0, warmup=warmup)
    each = base.crossJoin(F.broadcast(grid))  # at most the grid's 500 rows
    dist = F.col("tp") - F.col("limit_price")
    return each.withColumns({"sl": F.col("limit_price") - dist * F.col("k"), "tp": F.col("limit_price") + dist * F.col("k") * F.col("rr"), "signal_id": F.concat_ws("|", F.lpad("bar_idx", 12, "0"), "combo_id")})


def parameter_sweep(feats: DataFrame, grid: DataFrame, warmup: int = 50, costs: Costs = Costs()) -> DataFrame:
    """Closed trades of every combination (combo_id, k, rr)."""
    return backtest(feats, sweep_signals(feats, grid, warmup), costs, keys=("symbol", "combo_id"))


def feature_sweep(rows: DataFrame, grid: DataFrame, warmup: int = 50, costs: Costs = Costs(), chunk: int = rec.CHUNK) -> DataFrame:
    """`parameter_sweep` over a grid that may also name the parameters of features (fast, slow, n): those
    are made once for each of their few distinct sets."""
    names = [c for c in ("fast", "slow", "n") if c in grid.columns]
    sets = [r.asDict() for r in grid.select(*names).distinct().collect()] if names else [{}]  # at most the grid's 500 rows
    out = None
    for own in sets:
        part = grid
        for name, value in own.items():
            part = part.where(F.col(name) == value)
        trades = parameter_sweep(features(rows, **own, chunk=chunk), part.select("combo_id", "k", "rr"), warmup, costs)
        out = trades if out is None else out.unionByName(trades)
    return out


SCORES = {"pnl": "pnl", "pf": "profit_factor", "win_rate": "win_rate", "expectancy": "expectancy", "sharpe": "sharpe", "sortino": "sortino", "calmar": "calmar"}


def scores(trades: DataFrame, rows: DataFrame, keys=("symbol", "combo_id"), start: float = 10_000.0, buckets: Column | None = None) -> DataFrame:
    """trade_stats with sharpe and sortino of buckets (`buckets`: by default the days of exits) and calmar of the
    realised curve: its return over its deepest fall. The curve moves only where trades fill or end."""
    stats = metrics.trade_stats(trades, keys).join(metrics.sharpe_sortino(trades, F.to_date("exit_ts") if buckets is None else buckets, keys), [*keys])
    events = trades.select(*keys, F.col("fill_bar").alias("bar_idx"), (-F.col("commission") / 2).alias("cash")).unionByName(trades.select(*keys, F.col("exit_bar").alias("bar_idx"), F.col("pnl_net").alias("cash")))
    curve = chains.running(events.groupBy(*keys, "bar_idx").agg(F.sum("cash").alias("cash")), {"_won": (F.col("cash"), "sum")}, keys).withColumn("_eq", F.lit(start) + F.col("_won"))
    curve = chains.running(curve, {"_peak": (F.col("_eq"), "max")}, keys).withColumn("_peak", F.greatest("_peak", F.lit(start)))
    falls = curve.groupBy(*keys).agg(F.max(100 * (F.col("_peak") - F.col("_eq")) / F.col("_peak")).alias("_fall"), F.max_by("_won", "bar_idx").alias("_all"))
    rate = F.when(F.col("_fall") == 0, 0.0).otherwise(100 * F.col("_all") / start / F.col("_fall"))
    return stats.join(falls, [*keys]).withColumn("calmar", rate).drop("_fall", "_all")


def walk_forward(rows: DataFrame, grid: DataFrame, window: int, step: int, score: str | Column = "pnl", warmup: int = 50, anchored: bool = False, costs: Costs = Costs(), chunk: int = rec.CHUNK, bucket_bars: int | None = None) -> DataFrame:
    """Best combination of each in-sample window and its out-of-sample trades' figures.

    Columns: symbol, window_idx, combo_id, k, rr, is_score, oos_score, oos_n. Every slice restarts its
    averages; features are made once a slice, signals multiplied by the grid. No trades score -999;
    of equal scores the first combination wins. Sharpe and sortino are of days, or with `bucket_bars` of so many bars
    of the slice each.
    """
    by = score if isinstance(score, Column) else F.col(SCORES[score])
    cut = slices.window_slices(rows, window, step, anchored)
    starts = cut.groupBy("symbol", "window_idx", "phase").agg(F.min("bar_idx").alias("_first"))
    cut = cut.join(starts, ["symbol", "window_idx", "phase"])
    slice_ = cut.withColumns({"of": F.col("symbol"), "symbol": F.concat_ws("|", "symbol", "window_idx", "phase"), "bar_idx": F.col("bar_idx") - F.col("_first")}).drop("_first")
    trades = feature_sweep(slice_.drop("of", "window_idx", "phase"), grid, warmup, costs, chunk)
    buckets = None if bucket_bars is None else F.floor(F.col("exit_bar") / bucket_bars)
    stats = scores(trades, slice_, buckets=buckets).withColumn("_score", F.coalesce(by, F.lit(-999.0)))
    names = slice_.select("symbol", "of", "window_idx", "phase").distinct().crossJoin(F.broadcast(grid))
    scored = names.join(stats, ["symbol", "combo_id"], "left").withColumns({"_score": F.coalesce("_score", F.lit(-999.0)), "n": F.coalesce("n", F.lit(0))})
    best = scored.where("phase = 'IS'").groupBy(F.col("of"), "window_idx").agg(F.max_by(F.struct("combo_id", "k", "rr", F.col("_score").alias("is_score")), F.struct(F.round("_score", 9), -F.col("combo_id"))).alias("b")).select("of", "window_idx", "b.*")
    oos = scored.where("phase = 'OOS'").select("of", "window_idx", "combo_id", F.col("_score").alias("oos_score"), F.col("n").alias("oos_n"))
    return best.join(oos, ["of", "window_idx", "combo_id"], "left").withColumnRenamed("of", "symbol")


def stability(windows: DataFrame) -> DataFrame:
    """Mean out-of-sample over in-sample score, and the combinations chosen, in order of windows."""
    ratio = F.when(F.abs("is_score") > 1e-9, F.col("oos_score") / F.col("is_score"))
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("window_idx", "combo_id"))), lambda x: x["combo_id"])
    return windows.groupBy("symbol").agg(F.avg(ratio).alias("stability"), chosen.alias("chosen"))


def stitch(curves: DataFrame, keys=("run",)) -> DataFrame:
    """Curves (window_idx, bar_idx, equity) joined end to start: each is shifted to where the last ended."""
    ends = curves.groupBy(*keys, "window_idx").agg((F.max_by("equity", "bar_idx") - F.min_by("equity", "bar_idx")).alias("_gain"), F.min_by("equity", "bar_idx").alias("_start"))
    before = Window.partitionBy(*keys).orderBy("window_idx").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("_start").over(Window.partitionBy(*keys).orderBy("window_idx"))
    shift = ends.withColumn("_shift", first + F.coalesce(F.sum("_gain").over(before), F.lit(0.0)) - F.col("_start"))
    return curves.join(shift.drop("_gain", "_start"), [*keys, "window_idx"]).withColumn("equity", F.col("equity") + F.col("_shift")).drop("_shift")


def portfolio_summary(trades: DataFrame, ranks: DataFrame, start: float) -> DataFrame:
    """n, win_rate, pnl and total_return (% of `start`) of each symbol's trades and of ALL, which has the
    deepest fall of the common equity too, trade by trade in the order of (exit_ts, symbol_rank). Without trades
    ALL stands alone, with n 0 and nulls."""
    from ..operators import align

    cash = trades.select("symbol", F.col("exit_ts").alias("ts"), F.col("pnl_net").alias("cash"))
    curve = kept(metrics.global_equity(align.merge_symbols(cash, ranks), start), "portfolio")
    out = [F.count("*").alias("n"), (100.0 * F.avg((F.col("cash") > 0).cast("double"))).alias("win_rate"), F.sum("cash").alias("pnl"), (100.0 * F.sum("cash") / start).alias("total_return")]
    each = curve.groupBy("symbol").agg(*out).withColumn("max_dd", F.lit(None).cast("double"))
    # peaks so far by day first, then within days
    day, peak = F.to_date("ts"), F.max("equity")
    days = curve.groupBy(day.alias("_day")).agg(peak.alias("_top"))
    before = days.select("_day", F.max("_top").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inner = Window.partitionBy("_day").orderBy("ts", "symbol_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = curve.withColumn("_day", day).join(before, "_day").withColumn("_peak", F.greatest(peak.over(inner), "_before", F.lit(start)))
    whole = rows.agg(*out, F.max(100 * (F.col("_peak") - F.col("equity")) / F.col("_peak")).alias("max_dd"))
    return each.unionByName(whole.withColumn("symbol", F.lit("ALL")))


def in_order(trades: DataFrame, order: tuple[str, ...], ts: str) -> DataFrame:
    """`trades` numbered n = 0, 1, ... by `order`, which begins with the time `ts`, days first, so that no
    task numbers all of them."""
    from ..sources.adapters import numbered

    rows = trades.withColumn("_one", F.lit(0)).withColumn("_ts", F.col(ts))
    return numbered(rows.withColumn("ts", F.struct(F.col(ts), *order[1:])), ("_one",), "n", F.to_date(ts)).drop("ts", "_one", "_ts")


# --- bootstrap -----------------------------------------------------------------------------------


def draw(seed: int, sim: Column, step: Column, n: Column) -> Column:
    """A number below n from a hash of seed, simulation and step: the same on any engine and split."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), sim, step).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), n)


def bootstrap(spark: SparkSession, pnl: DataFrame, sims: int, seed: int = 42, start: float = 10_000.0, keys=("run",)) -> DataFrame:
    """Equity paths (keys, sim, step, x, equity) of trades drawn with replacement.

    `pnl`: keys, i (dense from 0), pnl_net. Each simulation's steps are made where it is computed; the
    draws meet the trades in one join, and a path is a running sum within its simulation.
    """
    sizes = pnl.groupBy(*keys).agg(F.count("*").alias("_n"))
    paths = sizes.crossJoin(spark.range(sims).withColumnRenamed("id", "sim"))
    steps = paths.withColumn("step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    drawn = steps.withColumn("i", draw(seed, F.col("sim"), F.col("step"), F.col("_n"))).drop("_n")
    rows = drawn.join(pnl.select(*keys, "i", F.col("pnl_net").alias("x")), [*keys, "i"])
    w = Window.partitionBy(*keys, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "sim", "step", "x", (F.lit(start) + F.sum("x").over(w)).alias("equity"))


def bootstrap_stats(paths: DataFrame, start: float = 10_000.0, keys=("run",)) -> DataFrame:
    """Per simulation: final equity, deepest fall in % of the peak (the start counts), Sharpe, lowest equity."""
    w = Window.partitionBy(*keys, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.max("equity").over(w), F.lit(start))
    rows = paths.withColumn("_dd", 100 * F.try_divide(peak - F.col("equity"), peak))
    sd = F.stddev_pop("x")
    return rows.groupBy(*keys, "sim").agg(F.max_by("equity", "step").alias("final"), F.greatest(F.max("_dd"), F.lit(0.0)).alias("max_dd"), F.when(sd > 0, F.avg("x") / sd * metrics.YEAR).alias("sharpe"), F.least(F.min("equity"), F.lit(start)).alias("lowest"))


def ruin(stats: DataFrame, floor: float, keys=("run",)) -> DataFrame:
    return stats.groupBy(*keys).agg(F.avg((F.col("lowest") <= floor).cast("double")).alias("prob_ruin"))


def equity_bands(paths: DataFrame, percents=(5, 25, 50, 75, 95), keys=("run",), exact: bool = True) -> DataFrame:
    pick = F.percentile if exact else F.percentile_approx
    return paths.groupBy(*keys, "step").agg(*(pick("equity", F.lit(p / 100)).alias(f"p{p}") for p in percents))


# --- account rules -------------------------------------------------------------------------------

#: (rule, start, target %, floor %, daily %, trailing, least days): common account programmes.
PRESETS = (
    ("two step", 100_000.0, 8.0, 10.0, 5.0, False, 4),
    ("one step", 100_000.0, 10.0, 6.0, 3.0, True, 3),
    ("verification", 100_000.0, 5.0, 10.0, 5.0, False, 4),
    ("instant", 50_000.0, 0.0, 5.0, 3.0, True, 0),
    ("swing", 200_000.0, 10.0, 12.0, 0.0, False, 10),
    ("strict", 25_000.0, 6.0, 4.0, 2.0, True, 5),
)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "rule string, account double, target double, floor double, daily double, trailing boolean, least_days int")


def _account_rows(equity: DataFrame, days: DataFrame, rules: DataFrame, keys) -> DataFrame:
    """Each bar under each rule: eq, what it has seen before (peak, equity before its day, days with trades) scaled to
    the account, and its event. Days are summed up first, so a run is cut at its days."""
    traded = days.select(*keys, F.to_date("ts").alias("_day")).distinct().withColumn("_traded", F.lit(1))
    rows = equity.select(*keys, "bar_idx", "ts", "equity", F.to_date("ts").alias("_day"))
    daily = rows.groupBy(*keys, "_day").agg(F.max("equity").alias("_most"), F.max_by("equity", "bar_idx").alias("_close"), F.min_by("equity", "bar_idx").alias("_open")).join(traded, [*keys, "_day"], "left")
    w = Window.partitionBy(*keys).orderBy("_day")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(*keys, "_day", F.max("_most").over(past).alias("_most"), F.lag("_close").over(w).alias("_before"), F.sum(F.coalesce("_traded", F.lit(0))).over(upto).alias("traded"), F.first("_open").over(upto).alias("_first"))
    inner = Window.partitionBy(*keys, "_day").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_peak", F.max("equity").over(inner)).join(daily, [*keys, "_day"]).crossJoin(F.broadcast(rules))  # a few literal rules
    scaled = lambda c: F.col(c) * F.col("account") / F.col("_first")
    rows = rows.withColumns({"eq": scaled("equity"), "before": F.coalesce(scaled("_before"), F.col("account"))}).withColumn("peak", F.greatest(scaled("_peak"), scaled("_most"), F.col("account")))
    limit = F.when(F.col("trailing"), F.col("peak")).otherwise(F.col("account")) * (1 - F.col("floor") / 100)
    event = (
        F.when(F.col("eq") <= limit, "max drawdown")
        .when((F.col("daily") > 0) & (F.col("before") > 0) & (F.col("before") - F.col("eq") >= F.col("before") * F.col("daily") / 100), "daily loss")
        .when((F.col("target") > 0) & (F.col("eq") >= F.col("account") * (1 + F.col("target") / 100)) & (F.col("traded") >= F.col("least_days")), "target")
    )
    return rows.withColumns({"event": event, "fall": 100 * (F.col("peak") - F.col("eq")) / F.col("peak")})


def _first_events(rows: DataFrame, keys) -> DataFrame:
    return rows.where("event is not null").groupBy(*keys, "rule").agg(F.min_by(F.struct("event", "bar_idx", F.col("eq").alias("at")), "bar_idx").alias("e"))


def account_rules(equity: DataFrame, days: DataFrame, rules: DataFrame, keys=("run",)) -> DataFrame:
    """The outcome of each run under each rule: status, the bar of the event, deepest fall till then.

    Equity is scaled to the account. On the first bar with any event, a fall to the floor comes before
    a daily loss (against the equity at the last bar before the day) and that before the target (with enough
    trading days so far). No event: passed. `days`: keys, ts of days with trades; a day may have many bars.
    """
    rows = _account_rows(equity, days, rules, keys)
    till = rows.join(_first_events(rows, keys), [*keys, "rule"], "left").where("e is null or bar_idx <= e.bar_idx")
    out = till.groupBy(*keys, "rule").agg(F.max("fall").alias("max_fall"), F.any_value("e").alias("e"), F.max_by("eq", "bar_idx").alias("final"))
    status = F.when(F.col("e.event").isNull() | (F.col("e.event") == "target"), "passed").otherwise("failed")
    return out.select(*keys, "rule", status.alias("status"), F.col("e.event").alias("event"), F.col("e.bar_idx").alias("event_bar"), "final", "max_fall")


def account_curves(equity: DataFrame, days: DataFrame, rules: DataFrame, keys=("run",)) -> DataFrame:
    """The account's equity at each bar under each rule (rule, bar_idx, ts, equity): after a failure it stays what
    it was then."""
    rows = _account_rows(equity, days, rules, keys)
    both = rows.join(_first_events(rows, keys), [*keys, "rule"], "left")
    over = (F.col("e.event") != "target") & (F.col("bar_idx") > F.col("e.bar_idx"))
    return both.select(*keys, "rule", "bar_idx", "ts", F.when(over, F.col("e.at")).otherwise(F.col("eq")).alias("equity"))


def circuit_breaker(daily: DataFrame, percent: float, initial: float, keys=("run",)) -> DataFrame:
    """The first bar of each day at which profit since the day's start, floating included, is at or
    below -percent of `initial`. `daily`: keys, ts, bar_idx, equity, floating."""
    day = F.to_date("ts")
    start = Window.partitionBy(*keys, "day").orderBy("bar_idx")
    rows = daily.withColumn("day", day).withColumn("_since", F.col("equity") - F.first("equity").over(start) + F.col("floating"))
    tripped = rows.where(F.col("_since") <= -percent / 100 * initial)
    return tripped.groupBy(*keys, "day").agg(F.min("bar_idx").alias("bar_idx"))


def payouts(equity: DataFrame, first_after: int = 30, every: int = 14, split: float = 0.8, keys=("run",), reset: float | None = None) -> DataFrame:
    """Payouts at the first bar of each due day: the split of profit since the cycle's start, if any.

    A due day follows the last one's bar by `every` days, so dates depend on each other: days of one
    run are walked in order, one small group a run. With `reset`, the equity that an account starts with
    and goes back to: from the first payout on, each due day takes the curve down to it.
    """
    import pandas as pd

    daily = equity.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.min_by("equity", "bar_idx").alias("equity"), F.max_by("equity", "bar_idx").alias("last"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("day")
        due = cycle = before = None
        taken, paid, out = 0.0, False, []
        for row in part.itertuples():
            now = row.equity - taken
            if due is None:
                due, cycle = row.day + pd.Timedelta(days=first_after), now if reset is None else reset
            elif row.day >= due:
                if before > cycle:
                    out.append((*(getattr(row, k) for k in keys), row.day, before - cycle, (before - cycle) * split))
                    paid = True
                    cycle = now
                if paid and reset is not None:
                    taken += now - reset
                    cycle = reset
                due = row.day + pd.Timedelta(days=every)
            before = row.last - taken
        return pd.DataFrame(out, columns=[*keys, "day", "profit", "payout"])

    kinds = ", ".join(f"{k} {dict(equity.dtypes)[k]}" for k in keys)
    return daily.groupBy(*keys).applyInPandas(walk, f"{kinds}, day date, profit double, payout double")


# --- pairs ---------------------------------------------------------------------------------------


def pair_bars(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """The bars of the pairs of a list (a, b) at the times both have: pair, ts, and each leg's prices as a_open, b_open, ..."""
    prices = "open", "high", "low", "close"
    leg = lambda x: bars.select(F.col("symbol").alias(x), "ts", *(F.col(c).alias(f"{x}_{c}") for c in prices))
    return pairs.select("a", "b").distinct().join(leg("a"), "a").join(leg("b"), ["b", "ts"]).withColumn("pair", F.concat_ws("/", "a", "b"))


def _pair_entries(rows: DataFrame, entry: float, leave: float, stop: float, most_hold: int, keys, may_enter: Column | None, chunk: int) -> DataFrame:
    """Every bar at which a position may begin (side, entry_bar), with exit_bar: the first bar after it within
    `leave` or beyond `stop`, or else the first with a z-score from `most_hold` bars on. Null: no such bar."""
    z, some = F.abs("z"), F.col("z").isNotNull()
    looked = kept(chains.ahead(rows.select(*keys, "bar_idx", "z", (F.lit(True) if may_enter is None else F.coalesce(may_enter, F.lit(False))).alias("_may")), {"_far": some & ((z < leave) | (z > stop)), "_some": some}, keys, chunk), "looked")
    begins = looked.where(F.col("_may") & (z > entry) & (z <= stop)).select(*keys, F.when(F.col("z") > 0, "SHORT").otherwise("LONG").alias("side"), F.col("bar_idx").alias("entry_bar"))
    far = looked.select(*keys, (F.col("bar_idx") - 1).alias("entry_bar"), "_far")
    due = looked.select(*keys, (F.col("bar_idx") - most_hold).alias("entry_bar"), "_some")
    return begins.join(far, [*keys, "entry_bar"], "left").join(due, [*keys, "entry_bar"], "left").select(*keys, "side", "entry_bar", F.least("_far", "_some").alias("exit_bar"))


def pair_positions(rows: DataFrame, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, most_hold: int = 60, keys=("pair",), may_enter: Column | None = None, chunk: int = chains.CHUNK) -> DataFrame:
    """Trades (side of the spread, entry_bar, exit_bar, why) from z-scores: in beyond `entry` where
    `may_enter` holds (filters by correlation, ADX, ...), out within `leave`, beyond `stop` or after `most_hold` bars.

    `rows`: all bars of a pair, bar_idx dense. Where a position would end follows from its entry, by looks ahead
    that are cut in chunks; which entries are taken is a chain. One that is open at the last bar is left out.
    """
    taken = chains.chained(_pair_entries(rows, entry, leave, stop, most_hold, keys, may_enter, chunk), F.col("entry_bar"), F.col("exit_bar"), keys, order=("entry_bar",), chunk=chunk)
    z = F.abs("z")
    why = F.when(z > stop, "stop").when(z < leave, "revert").otherwise("time")
    return taken.join(rows.select(*keys, F.col("bar_idx").alias("exit_bar"), "z"), [*keys, "exit_bar"]).select(*keys, "side", "entry_bar", "exit_bar", why.alias("why"))


def hedge_columns(rows: DataFrame, n: int = 30, keys=("pair",), chunk: int = chains.CHUNK) -> DataFrame:
    """`rows` with what a spread of any ratio needs over the last n bars: ratio (slope of a on b by least squares, as
    known at the bar), the means, variances and the covariance of both closes."""
    a, b = F.col("a_close"), F.col("b_close")
    sums = {"mean_a": F.avg(a), "mean_b": F.avg(b), "var_a": F.var_samp(a), "var_b": F.var_samp(b), "cov_ab": F.covar_samp(a, b)}

    def made(cut: DataFrame, by) -> DataFrame:
        back = rolling.back(by, n)
        return cut.withColumns({"_slope": rolling.rolling_hedge_ratio(a, b, by, n), **{c: F.when(F.count(a + b).over(back) == n, f.over(back)) for c, f in sums.items()}})

    rows = rolling.in_chunks(rows, n, made, keys, chunk=chunk)
    return chains.running(rows, {"ratio": (F.col("_slope"), "last")}, keys, chunk=chunk).drop("_slope")


def hedged_z(ratio: Column | str) -> Column:
    """The z-score of the spread a - ratio * b at a bar of `hedge_columns`."""
    k = F.col(ratio) if isinstance(ratio, str) else ratio
    gap = F.col("a_close") - k * F.col("b_close") - (F.col("mean_a") - k * F.col("mean_b"))
    var = F.col("var_a") + k * k * F.col("var_b") - 2 * k * F.col("cov_ab")
    return F.when(var > 0, gap / F.sqrt(var))


def hedged_positions(rows: DataFrame, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, most_hold: int = 60, keys=("pair",), may_enter: Column | None = None, chunk: int = chains.CHUNK) -> DataFrame:
    """`pair_positions` with a hedge ratio that rolls while there is no position and is frozen at the entry: the spread
    that decides on the exit, and leg b's size (`ratio`), have the entry's. `rows`: those of `hedge_columns`.

    As the exit depends on the entry's ratio, each possible entry is held against the `most_hold` bars after it, by
    equality; on the last of them it ends in any case.
    """
    z = F.abs("_z")
    may = F.lit(True) if may_enter is None else F.coalesce(may_enter, F.lit(False))
    begins = rows.withColumn("_z", hedged_z("ratio")).where(may & (z > entry) & (z <= stop)).select(*keys, F.when(F.col("_z") > 0, "SHORT").otherwise("LONG").alias("side"), F.col("bar_idx").alias("entry_bar"), "ratio")
    looks = begins.withColumn("bar_idx", F.explode(F.expr(f"sequence(entry_bar + 1, entry_bar + {most_hold})")))
    at = looks.join(rows.drop("ratio"), [*keys, "bar_idx"]).withColumn("_z", hedged_z("ratio"))
    why = F.when(z > stop, "stop").when(z < leave, "revert").when(F.col("bar_idx") == F.col("entry_bar") + most_hold, "time")
    ends = at.groupBy(*keys, "entry_bar").agg(F.min_by(F.struct(F.col("bar_idx").alias("exit_bar"), why.alias("why")), F.when(why.isNotNull(), F.col("bar_idx"))).alias("_x"))
    found = begins.join(ends, [*keys, "entry_bar"], "left").select(*keys, "side", "entry_bar", "_x.exit_bar", "_x.why", "ratio")
    return chains.chained(found, F.col("entry_bar"), F.col("exit_bar"), keys, order=("entry_bar",), chunk=chunk).where("exit_bar is not null")


def pair_trades(positions: DataFrame, rows: DataFrame, ratio: float = 1.0, keys=("pair",)) -> DataFrame:
    """Both legs of each position, opened at the next bar's opens and closed at the exit bar's closes; leg b is
    `ratio` units, or the position's own `ratio` if it has one."""
    at = rows.select(*keys, "bar_idx", "a_open", "b_open", "a_close", "b_close")
    opens = at.select(*keys, (F.col("bar_idx") - 1).alias("entry_bar"), "a_open", "b_open")
    closes = at.select(*keys, F.col("bar_idx").alias("exit_bar"), "a_close", "b_close")
    both = positions.join(opens, [*keys, "entry_bar"]).join(closes, [*keys, "exit_bar"])
    sign = F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    size = F.col("ratio") if "ratio" in positions.columns else F.lit(ratio)
    return both.select(*keys, "side", "entry_bar", "exit_bar", "why", (sign * (F.col("a_close") - F.col("a_open"))).alias("pnl_a"), (-sign * size * (F.col("b_close") - F.col("b_open"))).alias("pnl_b"))


def pair_orders(positions: DataFrame, rows: DataFrame, offset: float | None = None, ratio: float = 1.0, keys=("pair",)) -> DataFrame:
    """The orders of both legs (leg a or b, side, status, fill_bar, fill_price, pnl): market orders for the bar after the
    entry, or with `offset` limits at so much (a share) better than the entry bar's close.

    A leg fills at the first bar that reaches its limit, at the open if that is beyond it. The position's exit comes
    first in its bar and cancels what isn't filled by the bar before; a leg may so be left alone. What is filled
    closes at the exit bar's close. A position lasts a bounded number of bars, so it is an equi-join.
    """
    legs = [F.struct(F.lit(leg).alias("leg"), F.when((F.col("side") == "LONG") == (leg == "a"), "LONG").otherwise("SHORT").alias("_side"), *(F.col(f"{leg}_{c}").alias(c) for c in ("open", "high", "low", "close"))) for leg in "ab"]
    at = kept(positions.select(*keys, "entry_bar", "exit_bar", "side").withColumn("bar_idx", F.explode(F.sequence("entry_bar", "exit_bar"))).join(rows.select(*keys, "bar_idx", *(f"{leg}_{c}" for leg in "ab" for c in ("open", "high", "low", "close"))), [*keys, "bar_idx"]).withColumn("_leg", F.explode(F.array(*legs))).select(*keys, "entry_bar", "exit_bar", "bar_idx", "_leg.*"), "legs")
    each = [*keys, "entry_bar", "leg"]
    long = F.col("_side") == "LONG"
    price = F.col("close") * F.when(long, 1 - (offset or 0.0)).otherwise(1 + (offset or 0.0))
    asked = at.where("bar_idx = entry_bar").select(*each, price.alias("limit_price"))
    looks = at.where("bar_idx > entry_bar and bar_idx < exit_bar").join(asked, each)
    touched = F.lit(True) if offset is None else F.when(long, F.col("low") <= F.col("limit_price")).otherwise(F.col("high") >= F.col("limit_price"))
    paid = F.col("open") if offset is None else F.when(long, F.least("open", "limit_price")).otherwise(F.greatest("open", "limit_price"))
    fills = looks.where(touched).groupBy(*each).agg(F.min_by(F.struct(F.col("bar_idx").alias("fill_bar"), paid.alias("fill_price")), "bar_idx").alias("_f"))
    out = at.where("bar_idx = exit_bar").join(fills, each, "left")
    size = F.when(F.col("leg") == "a", 1.0).otherwise(ratio) * F.when(long, 1.0).otherwise(-1.0)
    return out.select(*each, "exit_bar", F.col("_side").alias("side"), F.when(F.col("_f").isNull(), "cancelled").otherwise("filled").alias("status"), "_f.fill_bar", "_f.fill_price", (size * (F.col("close") - F.col("_f.fill_price"))).alias("pnl"))


def breaker_positions(rows: DataFrame, percent: float, initial: float = 10_000.0, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0, most_hold: int = 60, ratio: float = 1.0, warmup: int = 0, keys=("pair",), may_enter: Column | None = None, chunk: int = chains.CHUNK, days: int = 4096) -> DataFrame:
    """The run of `pair_positions` with a daily circuit breaker that acts on it (side, entry_bar, exit_bar, why, status,
    pnl). `rows`: all bars of a pair with ts, z and both legs' opens and closes.

    At each bar from `warmup` on, before anything else: profit closed since the day's first bar, and the open position's
    whole floating profit at the close, at or below -percent of `initial` closes the position at that close
    (`daily_circuit_breaker`) and blocks entries till midnight. Market orders fill at the next bar's open; an exit on
    that bar cancels them. What is open at the last bar ends there (`end_of_data`).

    What a day comes to depends only on the position it starts with: none, or one of those that can live till its first
    bar. So each day is worked out for each of them, in a task of its own, and the days' outcomes form a chain.
    """
    limit = percent / 100 * initial
    bars = kept(rows.select(*keys, "bar_idx", F.to_date("ts").alias("_day"), "z", "a_open", "b_open", "a_close", "b_close", (F.lit(True) if may_enter is None else F.coalesce(may_enter, F.lit(False))).alias("_may")), "pair-bars")
    entries = _pair_entries(bars.withColumn("_on", F.col("_may") & (F.col("bar_idx") >= warmup)), entry, leave, stop, most_hold, keys, F.col("_on"), chunk)
    number = Window.partitionBy(*keys).orderBy("_day")
    dated = bars.groupBy(*keys, "_day").agg(F.min("bar_idx").alias("_first"), F.max("bar_idx").alias("_last")).withColumns({"_k": F.row_number().over(number) - 1, "_end": F.lead("_day").over(number).isNull()})
    dated = kept(dated, "days")
    numbered = bars.join(dated.select(*keys, "_day", "_k"), [*keys, "_day"]).drop("_day")
    of = lambda name, at: numbered.select(*keys, F.col("bar_idx").alias(at), F.col("_k").alias(name))
    opens = bars.select(*keys, (F.col("bar_idx") - 1).alias("entry_bar"), F.col("a_open").alias("fa_"), F.col("b_open").alias("fb_"))
    sign = F.when(F.col("side") == "LONG", 1).otherwise(-1).alias("sign_")
    last = dated.groupBy(*keys).agg(F.max("_k").alias("_ends"))
    whole = entries.join(of("_k", "entry_bar"), [*keys, "entry_bar"]).join(of("_out", "exit_bar"), [*keys, "exit_bar"], "left").join(opens, [*keys, "entry_bar"], "left").join(last, [*keys])
    whole = kept(whole.select(*keys, "_k", "entry_bar", "exit_bar", sign, "fa_", "fb_", F.coalesce("_out", "_ends").alias("_out")), "entries")
    # a position is a way to start each day after its own, up to that of its exit
    alive = whole.where("_out > _k").withColumn("_k", F.explode(F.sequence(F.col("_k") + 1, F.col("_out")))).withColumn("_own", F.lit(False))
    known = whole.withColumn("_own", F.lit(True)).unionByName(alive)
    path = numbered.join(dated.select(*keys, "_k", "_end"), [*keys, "_k"]).select(*keys, "_k", "_end", "bar_idx", "a_close", "b_close")

    def play(bars, known):
        import numpy as np
        import pandas as pd

        bars = bars.sort_values("bar_idx")
        head = tuple(bars[k].iloc[0] for k in (*keys, "_k"))
        first, final, ends = int(bars["bar_idx"].iloc[0]), int(bars["bar_idx"].iloc[-1]), bool(bars["_end"].iloc[0])
        a, b, on = bars["a_close"].to_numpy(float), bars["b_close"].to_numpy(float), bars["bar_idx"].to_numpy() >= warmup
        known = known.sort_values("entry_bar")
        held = {r.entry_bar: r for r in known.itertuples()}
        own = known["entry_bar"][known["_own"]].to_numpy()

        def day(start):
            """The position after the day (-1: none) and its trades, if it starts with `start`."""
            closed, i, now, trades = 0.0, first, start, []
            while i <= final:
                if now < 0:
                    reach = max(i, warmup)
                    if closed <= -limit and reach <= final:
                        return -1, trades
                    at = np.searchsorted(own, i)
                    if at == len(own):
                        return -1, trades
                    now = int(own[at])
                    i = now + 1
                    continue
                p = held[now]
                out = final if np.isnan(p.exit_bar) else min(int(p.exit_bar), final)
                span = slice(i - first, out - first + 1)
                worth = p.sign_ * ((a[span] - p.fa_) - ratio * (b[span] - p.fb_))
                worth = np.where(np.arange(i, out + 1) > now + 1, worth, 0.0)  # the order is pending till its bar is over
                bad = np.flatnonzero((closed + worth <= -limit) & on[span])
                if len(bad):
                    cut, why = i + int(bad[0]), "daily_circuit_breaker"
                elif not np.isnan(p.exit_bar) and p.exit_bar <= final:
                    cut, why = out, "exit"
                else:
                    return (now, trades) if not ends else (-1, [*trades, (p.sign_, now, final, "end_of_data", final > now, float(p.sign_ * ((a[-1] - p.fa_) - ratio * (b[-1] - p.fb_))) if final > now else 0.0)])
                filled, gain = cut > now + 1, float(worth[cut - i])
                trades.append((p.sign_, now, cut, why, filled, gain))
                if why != "exit":
                    return -1, trades
                closed, i, now = closed + gain, cut + 1, -1
            if now >= 0 and ends:  # placed on the last bar of all
                return -1, [*trades, (held[now].sign_, now, final, "end_of_data", False, 0.0)]
            return now, trades

        rows = []
        for start in [-1, *known["entry_bar"][~known["_own"]].tolist()]:
            to, trades = day(int(start))
            rows.append((*head, int(start), to, [dict(zip(("sign", "entry_bar", "exit_bar", "why", "filled", "pnl"), t, strict=True)) for t in trades]))
        return pd.DataFrame(rows, columns=[*keys, "_k", "_start", "_to", "_trades"])

    kinds = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    outcome = path.groupBy(*keys, "_k").cogroup(known.groupBy(*keys, "_k")).applyInPandas(play, f"{kinds}, _k int, _start long, _to long, _trades array<struct<sign:int,entry_bar:long,exit_bar:long,why:string,filled:boolean,pnl:double>>")
    # a day's place in the chain: its number, then what it starts with
    place = lambda k, state: F.shiftleft(k.cast("long"), 32) + F.col(state) + 1
    taken = chains.chained(kept(outcome, "outcomes"), place(F.col("_k"), "_start"), place(F.col("_k") + 1, "_to") - 1, keys, order=("_start",), chunk=days << 32)
    out = taken.select(*keys, F.explode("_trades").alias("t")).select(*keys, F.when(F.col("t.sign") > 0, "LONG").otherwise("SHORT").alias("side"), "t.entry_bar", "t.exit_bar", F.col("t.why").alias("_why"), F.when(F.col("t.filled"), "filled").otherwise("cancelled").alias("status"), "t.pnl")
    z = F.abs("z")
    why = F.when(F.col("_why") != "exit", F.col("_why")).when(z > stop, "stop").when(z < leave, "revert").otherwise("time")
    return out.join(bars.select(*keys, F.col("bar_idx").alias("exit_bar"), "z"), [*keys, "exit_bar"]).select(*keys, "side", "entry_bar", "exit_bar", why.alias("why"), "status", "pnl")


def pair_equity(trades: DataFrame, rows: DataFrame, start: float = 10_000.0, keys=("pair",)) -> DataFrame:
    """Equity of both legs, which start with half each, at every bar of `rows`: profits count from their exit on."""
    cash = trades.groupBy(*keys, F.col("exit_bar").alias("bar_idx")).agg(F.sum("pnl_a").alias("a"), F.sum("pnl_b").alias("b"))
    both = rows.select(*keys, "bar_idx").join(cash, [*keys, "bar_idx"], "left")
    both = chains.running(both, {f"_{c}": (F.coalesce(c, F.lit(0.0)), "sum") for c in "ab"}, keys)
    legs = both.select(*keys, "bar_idx", *((F.lit(start / 2) + F.col(f"_{c}")).alias(f"equity_{c}") for c in "ab"))
    return legs.withColumn("equity", F.col("equity_a") + F.col("equity_b"))


def pair_summary(trades: DataFrame, equity: DataFrame, keys=("pair",)) -> DataFrame:
    """Figures of the pairs' trades, and return and deepest fall (%) of their `equity`."""
    both = F.col("pnl_a") + F.col("pnl_b")
    sums = trades.groupBy(*keys).agg(F.count("*").alias("n"), (100.0 * F.avg((both > 0).cast("double"))).alias("win_rate"), F.sum("pnl_a").alias("pnl_a"), F.sum("pnl_b").alias("pnl_b"), F.sum(both).alias("pnl"))
    curve = metrics.equity_stats(equity, keys).select(*keys, "total_return", "max_dd_pct")
    return sums.join(curve, [*keys])
