import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeweave.functions import recursive as rec
from tapeweave.functions import rolling as roll
from tapeweave.jobs import studies
from tapeweave.operators import align, exits, metrics, quality, slices
from tapeweave.operators.exits import Costs
from tapeweave.sources import adapters, bars

T0 = dt.datetime(2024, 1, 1)


def make(spark, rows, symbol="a"):
    """Bars from (open, high, low, close) tuples, one a minute."""
    data = [(symbol, i, T0 + dt.timedelta(minutes=i), *map(float, r), 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "symbol string, bar_idx long, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def walk(spark, n=300, symbol="a", seed=42):
    rng = np.random.default_rng(seed)
    c = 100 + np.cumsum(rng.normal(0, 1, n))
    o = np.concatenate([[100], c[:-1]])
    return make(spark, [(a, max(a, b) + 0.3, min(a, b) - 0.3, b) for a, b in zip(o, c, strict=True)], symbol)


def signal(spark, side="LONG", kind="market", price=0.0, sl=0.0, tp=0.0, expiry=1, at=0):
    return spark.createDataFrame([("a", at, side, kind, price, sl, tp, expiry, at, 1.0)], "symbol string, bar_idx long, side string, order_type string, limit_price double, sl double, tp double, expiry int, signal_id long, size double")


def test_csv_reader_sorts_out_names_and_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time,Open,HIGH,low,Close\n2024-01-01 00:00:00,1,2,0.5,1.5\n2024-01-01 00:01:00,1,2,0.5,\n")
    got = bars.read_bars_csv(spark, str(tmp_path / "a.csv"), "x").collect()
    assert [(r.symbol, r.high, r.volume) for r in got] == [("x", 2.0, 0.0)]
    (tmp_path / "b.csv").write_text("Time,Open,High,Low\n2024-01-01,1,2,0\n")
    with pytest.raises(ValueError, match="close"):
        bars.read_bars_csv(spark, str(tmp_path / "b.csv"))


def test_store_round_trip_reads_only_what_is_asked(spark, tmp_path):
    b = walk(spark, 50).drop("bar_idx").unionByName(walk(spark, 50, "b").drop("bar_idx"))
    bars.write_store(b, str(tmp_path / "s"))
    back = bars.read_store(spark, str(tmp_path / "s"), ["b"], ["2024-01"])
    assert back.count() == 50 and back.select("symbol").distinct().collect()[0][0] == "b"


@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_chunked_scan_equals_pandas(spark, chunk):
    b = walk(spark, 300).withColumn("close", F.when(F.col("bar_idx") >= 5, F.col("close")))
    got = rec.ewm(b, {"e": ("close", 0.2)}, chunk=chunk).orderBy("bar_idx").toPandas()
    want = got["close"].ewm(alpha=0.2, adjust=False).mean()
    np.testing.assert_allclose(got["e"].to_numpy(float), want.to_numpy(float), rtol=1e-10, equal_nan=True)


@pytest.mark.parametrize("chunk", [3, 40, 10_000])
@pytest.mark.parametrize("alpha", [0.05, 0.5, 1.0])
def test_later_nulls_weigh_by_position(spark, chunk, alpha):
    rng = np.random.default_rng(3)
    gone = [int(i) for i in rng.choice(300, 120, replace=False)] + list(range(100, 130))
    b = walk(spark, 300).withColumn("close", F.when(~F.col("bar_idx").isin(gone), F.col("close")))
    got = rec.ewm(b, {"e": ("close", alpha)}, chunk=chunk).orderBy("bar_idx").toPandas()
    want = got["close"].ewm(alpha=alpha, adjust=False, ignore_na=False).mean()
    np.testing.assert_allclose(got["e"].to_numpy(float), want.to_numpy(float), rtol=1e-9, equal_nan=True)


def test_a_backtest_reads_and_computes_its_features_once(spark):
    b = adapters.numbered(adapters.bars(spark, "/root/testdata/sf0.001"))
    f = studies.features(b)
    nodes = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert nodes(f).count("Pandas") == 0 and nodes(f).count("Scan parquet") == 1
    assert nodes(studies.backtest(f, studies.cross_signals(f))).count("Pandas") == 0
    walked = nodes(studies.walk_forward(b, studies.param_grid(spark, {"k": [1.0], "rr": [1.0, 2.0]}), 60, 20, warmup=10))
    assert walked.count("FlatMapGroupsInPandas") == 0


@pytest.mark.parametrize(("trail", "activation", "even", "group"), [(0.02, 0.01, 0.0, 5), (0.02, 0.01, 0.0, 64), (0.0, 0.0, 0.015, 16), (0.03, 0.02, 0.01, 7)])
def test_moving_stop_equals_a_walk_along_the_bars(spark, trail, activation, even, group):
    b = walk(spark, 240)
    rows = b.orderBy("bar_idx").collect()
    side = F.when(F.col("bar_idx") % 2 == 0, "LONG").otherwise("SHORT")
    far = lambda sign: F.col("close") + F.when(F.col("bar_idx") % 2 == 0, sign).otherwise(-sign)
    s = b.where("bar_idx % 5 = 0").select("symbol", "bar_idx", side.alias("side"), F.lit("market").alias("order_type"), F.col("close").alias("limit_price"), far(-6.0).alias("sl"), far(9.0).alias("tp"), F.lit(1).alias("expiry"), F.col("bar_idx").alias("signal_id"), F.lit(1.0).alias("size"))
    costs = Costs(spread=0.05, trail_pct=trail, trail_activation=activation, break_even=even)
    got = {r.placed_bar: (r.exit_bar, r.exit_reason, round(r.raw_exit, 9)) for r in exits.resolve_trailing_exits(exits.resolve_fills(s, b), b, costs, group).where("status = 'filled'").collect()}
    for g in s.collect():
        p, long = g.bar_idx, g.side == "LONG"
        if p + 1 >= len(rows):
            assert p not in got
            continue
        paid, stop, end = rows[p + 1].open + (0.05 if long else 0), g.sl, None
        for r in rows[p + 2 :]:
            if (r.open <= stop) if long else (r.open >= stop):
                end = (r.bar_idx, "sl", r.open)
            elif (r.open >= g.tp) if long else (r.open <= g.tp):
                end = (r.bar_idx, "tp", r.open)
            else:
                if trail and long and (r.high - paid) / paid >= activation:
                    stop = max(stop, r.high * (1 - trail))
                if trail and not long and (paid - r.low) / paid >= activation:
                    stop = min(stop, r.low * (1 + trail))
                if (r.low <= stop) if long else (r.high >= stop):
                    end = (r.bar_idx, "sl", stop)
                elif (r.high >= g.tp) if long else (r.low <= g.tp):
                    end = (r.bar_idx, "tp", g.tp)
            if end:
                break
            if even and ((r.high - paid) / paid if long else (paid - r.low) / paid) >= even:
                stop = max(stop, paid) if long else min(stop, paid)
        end = end or (rows[-1].bar_idx, "end_of_data", rows[-1].close)
        assert got[p] == (end[0], end[1], round(end[2], 9)), p


def test_one_equity_sizes_the_orders_of_a_portfolio(spark):
    b = walk(spark, 150).unionByName(walk(spark, 150, "b", 7))
    s = b.where("bar_idx % 4 = 1").select("symbol", "bar_idx", F.lit("LONG").alias("side"), F.lit("market").alias("order_type"), F.col("close").alias("limit_price"), (F.col("close") - 2).alias("sl"), (F.col("close") + 3).alias("tp"), F.lit(1).alias("expiry"), F.col("bar_idx").alias("signal_id"), F.lit(1.0).alias("size"), F.lit("p").alias("portfolio"))
    sizing, costs = exits.Sizing("pct_equity", 0.05, 0.01, 0.01, 2.0, 1000.0), Costs(commission=0.2)
    got = {(r.symbol, r.placed_bar): r.size for r in studies.orders(b, s, costs, sizing=sizing, capital=("portfolio",)).where("status = 'filled'").collect()}
    units = {(r.symbol, r.placed_bar): r for r in exits.priced(exits.resolve_exits(exits.resolve_fills(s, b), b, costs), costs).collect()}
    equity, open_until, want, cash = 1000.0, {}, {}, []
    for bar in range(150):
        for symbol in "ab":  # the order is placed before this symbol's fills and exits of the bar
            u = units.get((symbol, bar))
            if u and u.status == "filled" and open_until.get(symbol, -1) < bar:
                raw = max(0.01, round(equity * 0.05 / 2 / 0.01) * 0.01)
                if raw * u.limit_price > 2 * equity:
                    raw = max(0.01, int(2 * equity / u.limit_price / 0.01) * 0.01)
                want[symbol, bar] = raw
                open_until[symbol] = u.exit_bar
                cash += [(u.fill_bar, symbol, -u.commission / 2 * raw), (u.exit_bar, symbol, u.pnl_net * raw)]
            equity += sum(c for t, x, c in cash if (t, x) == (bar, symbol))
    assert got.keys() == want.keys() and len(want) > 20 and got == pytest.approx(want)


def test_symbols_without_a_rank_are_an_error(spark):
    b = walk(spark, 3).unionByName(walk(spark, 3, "b"))
    assert [r.symbol_rank for r in align.merge_symbols(b, align.symbol_ranks(b)).orderBy("ts", "symbol_rank").collect()] == [0, 1] * 3
    with pytest.raises(Exception, match="no rank for symbol b"):
        align.merge_symbols(b, align.symbol_ranks(b).where("symbol = 'a'")).collect()


def test_numbering_is_dense_across_days(spark):
    b = make(spark, [(1, 1, 1, 1)] * 10).withColumn("ts", F.expr("timestampadd(HOUR, bar_idx * 7, timestamp_ntz'2024-01-01')")).drop("bar_idx")
    assert [r.bar_idx for r in adapters.numbered(b).orderBy("ts").collect()] == list(range(10))


def test_market_order_fills_at_next_open_and_stop_wins_inside_one_bar(spark):
    b = make(spark, [(10, 10, 10, 10), (10, 11, 9, 10), (10, 13, 7, 10), (10, 10, 10, 10)])
    s = signal(spark, sl=8.0, tp=12.0)
    out = exits.priced(exits.resolve_exits(exits.resolve_fills(s, b), b), Costs(commission=2.0)).collect()[0]
    assert (out.fill_bar, out.raw_fill, out.exit_bar, out.exit_reason, out.raw_exit) == (1, 10.0, 2, "sl", 8.0)
    assert out.pnl_gross == -2.0 and out.pnl_net == -3.0 and out.pnl_all_in == -4.0


def test_gap_through_target_exits_at_open(spark):
    b = make(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (15, 16, 14, 15)])
    out = exits.resolve_exits(exits.resolve_fills(signal(spark, sl=5.0, tp=12.0), b), b).collect()[0]
    assert (out.exit_reason, out.raw_exit) == ("tp", 15.0)


def test_limit_order_expires_and_pending_is_kept_apart(spark):
    b = make(spark, [(10, 10, 10, 10)] * 6)
    assert exits.resolve_fills(signal(spark, kind="limit", price=5.0, expiry=3), b).collect()[0].status == "expired"
    assert exits.resolve_fills(signal(spark, kind="limit", price=5.0, expiry=3, at=4), b).collect()[0].status == "pending"


@pytest.mark.parametrize("block", [4, 16, 1000])
def test_block_first_touch_equals_plain_search(spark, block):
    b = walk(spark, 200)
    rows = b.orderBy("bar_idx").toPandas()
    s = b.where("bar_idx % 9 = 0").select("symbol", "bar_idx", F.lit("LONG").alias("side"), F.lit("market").alias("order_type"), F.col("close").alias("limit_price"), (F.col("close") - 3).alias("sl"), (F.col("close") + 4).alias("tp"), F.lit(1).alias("expiry"), F.col("bar_idx").alias("signal_id"), F.lit(1.0).alias("size"))
    got = {r.placed_bar: (r.exit_bar, r.exit_reason) for r in exits.resolve_exits(exits.resolve_fills(s, b), b, block=block).collect()}
    for p in range(0, 199, 9):
        after = rows[(rows.bar_idx > p + 1) & ((rows.low <= rows.close[p] - 3) | (rows.high >= rows.close[p] + 4))]
        assert got[p][0] == (after.bar_idx.iloc[0] if len(after) else 199)


def test_trader_takes_no_second_trade_while_one_is_open(spark):
    data = [("a", 0, 1, 5, "filled", "LONG", 1, 0), ("a", 3, 4, 9, "filled", "LONG", 1, 3), ("a", 5, 6, 7, "filled", "SHORT", 1, 5), ("a", 6, 7, 8, "filled", "SHORT", 1, 6)]
    c = spark.createDataFrame(data, "symbol string, placed_bar long, fill_bar long, exit_bar long, status string, side string, expiry int, signal_id long")
    assert sorted(r.placed_bar for r in exits.select_trades(c).collect()) == [0, 6]
    assert sorted(r.placed_bar for r in exits.select_trades(c, 2).collect()) == [0, 3, 6]


def test_higher_timeframe_is_never_seen_early(spark):
    p = make(spark, [(1, 1, 1, 1)] * 120)
    s = make(spark, [(i, i, i, i) for i in range(3)]).withColumn("ts", F.expr("timestampadd(HOUR, bar_idx, timestamp_ntz'2024-01-01')"))
    seen = {r.bar_idx: r.x for r in align.attach_higher_timeframe(p, s.select("symbol", "ts", "close"), {"close": "x"}).collect()}
    assert seen[0] is None and seen[59] is None and seen[60] == 0.0 and seen[119] == 0.0


def test_audit_catches_features_that_peek(spark):
    b = walk(spark, 200)
    by = Window.partitionBy("symbol").orderBy("bar_idx")
    good = quality.causality_audit(lambda d: d.withColumn("x", roll.sma(F.col("close"), by, 10)), b, ["x"])
    centred = quality.causality_audit(lambda d: d.withColumn("x", F.avg("close").over(by.rowsBetween(-5, 5))), b, ["x"])
    assert good.count() == 0 and centred.count() == 5


def test_session_names(spark):
    with pytest.raises(ValueError):
        slices.in_session(F.col("ts"), "mars")


def test_profit_factor_is_infinite_without_losses_and_runs_without_trades_stay(spark):
    t = spark.createDataFrame([("a", "LONG", 2.0), ("a", "SHORT", 3.0)], "run string, side string, pnl_net double")
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    got = {r.run: r for r in metrics.trade_stats(t, runs=runs).collect()}
    assert got["a"].profit_factor == float("inf") and got["b"].n == 0


def test_drawdown_and_streaks(spark):
    e = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([100, 110, 99, 105, 121, 120])], "run string, bar_idx long, equity double")
    s = metrics.equity_stats(e).collect()[0]
    assert s.max_dd == -11.0 and abs(s.max_dd_pct + 10) < 1e-12 and s.longest_dd == 2 and s.final_equity == 120.0


def test_window_slices_bounds(spark):
    rows = slices.window_slices(make(spark, [(1, 1, 1, 1)] * 25), 10, 5).toPandas()
    got = rows.groupby(["window_idx", "phase"]).bar_idx.agg(["min", "max"]).to_dict("index")
    assert got == {(w, p): {"min": lo, "max": hi} for w, p, lo, hi in [(0, "IS", 0, 9), (0, "OOS", 10, 14), (1, "IS", 5, 14), (1, "OOS", 15, 19), (2, "IS", 10, 19), (2, "OOS", 20, 24)]}
    anchored = slices.window_slices(make(spark, [(1, 1, 1, 1)] * 25), 10, 5, True).toPandas()
    assert sorted(anchored[(anchored.phase == "IS") & (anchored.window_idx == 2)].bar_idx) == list(range(20))


def test_account_rules_order_of_events(spark):
    from tapeweave.jobs import studies

    e = spark.createDataFrame([("r", i, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate([10000, 10500, 9400])], "run string, bar_idx long, ts date, equity double")
    rules = spark.createDataFrame([("floor", 10000.0, 0.0, 5.0, 50.0, False, 0), ("daily", 10000.0, 0.0, 50.0, 5.0, False, 0), ("target", 10000.0, 5.0, 50.0, 0.0, False, 2), ("none", 10000.0, 50.0, 50.0, 0.0, False, 0)], "rule string, account double, target double, floor double, daily double, trailing boolean, least_days int")
    got = {r.rule: (r.status, r.event, r.event_bar) for r in studies.account_rules(e, e.select("run", "ts"), rules).collect()}
    assert got == {"floor": ("failed", "max drawdown", 2), "daily": ("failed", "daily loss", 2), "target": ("passed", "target", 1), "none": ("passed", None, None)}


def test_grid_limits(spark):
    from tapeweave.jobs import studies

    with pytest.raises(ValueError):
        studies.param_grid(spark, {})
    with pytest.raises(ValueError):
        studies.param_grid(spark, {"a": list(range(30)), "b": list(range(30))})
    assert pd.DataFrame(studies.param_grid(spark, {"a": [1, 2], "b": [3, 4]}).collect())[0].tolist() == [0, 1, 2, 3]


def test_session_hours(spark):
    """The hour that ends a session isn't in it."""
    hours = spark.range(24).select(F.col("id").alias("h"), F.expr("timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, id)").alias("ts"))
    within = {name: {r.h for r in hours.where(slices.in_session(F.col("ts"), name)).collect()} for name in ("london", "ny", "asia", "both", "all")}
    assert within == {"london": set(range(7, 12)), "ny": set(range(13, 17)), "asia": set(range(7)), "both": {*range(7, 12), *range(13, 17)}, "all": set(range(24))}


def test_default_grid_follows_from_the_parameters():
    params = {"n": studies.Param(14, step=2, least=12), "fast": studies.Param(2), "k": studies.Param(2.0, step=0.5, most=2.5), "free": studies.Param(0.1), "mode": studies.Param("a", options=("a", "b")), "on": studies.Param(True), "name": "x"}
    want = {"n": [12, 14, 18], "fast": [1, 2, 4], "k": [1.0, 2.0, 2.5], "free": [-0.1, 0.1, 0.3], "mode": ["a", "b"], "on": [True], "name": ["x"]}
    assert studies.default_grid(params) == want
    assert studies.default_grid(params, {"n": 20, "fast": 9})["n"] == [16, 20, 24]
