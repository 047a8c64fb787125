"""Chains cut in chunks against a walk over everything."""

import random

import pytest
from pyspark.sql import functions as F

from tapeweave.operators import chains, exits


def walked(rows, once):
    """Rows (symbol, at, free, side, signal_id) that a trader with one place takes."""
    out = []
    for symbol in {r[0] for r in rows}:
        free, was = None, None
        for r in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1], r[4])):
            if (free is None or r[1] > free) and not (once and r[3] == was):
                out.append((symbol, r[4]))
                free, was = float("inf") if r[2] is None else r[2], r[3]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000, chains.CHUNK])
@pytest.mark.parametrize("once", [False, True])
def test_chain_is_the_walk(spark, chunk, once):
    rng = random.Random(1)
    rows = [(s, at, at + rng.choice([0, 1, 3, 20, 200]), rng.choice(["LONG", "SHORT"]), k) for s, n in (("a", 300), ("b", 40), ("c", 1)) for k, at in enumerate(sorted(rng.choices(range(-50, 900), k=n)))]
    rows += [("d", 5, None, "LONG", 0), ("d", 700, 701, "SHORT", 1)]
    df = spark.createDataFrame(rows, "symbol string, at long, free long, side string, signal_id long").repartition(4)
    got = chains.chained(df, F.col("at"), F.col("free"), side=F.col("side") if once else None, chunk=chunk)
    assert sorted((r.symbol, r.signal_id) for r in got.collect()) == walked(rows, once)
    assert chains.chained(df.limit(0), F.col("at"), F.col("free"), chunk=chunk).collect() == []


@pytest.mark.parametrize("chunk", [1, 10, 500])
def test_ahead(spark, chunk):
    rng = random.Random(2)
    rows = [(s, i, rng.random() < 0.05) for s in "ab" for i in range(200)] + [("c", 0, False)]
    df = spark.createDataFrame(rows, "symbol string, bar_idx long, on boolean")
    got = {(r.symbol, r.bar_idx): r.hit for r in chains.ahead(df, {"hit": F.col("on")}, chunk=chunk).collect()}
    for s, i, _ in rows:
        assert got[s, i] == min((j for t, j, on in rows if t == s and j >= i and on), default=None)


def test_one_place_equals_the_general_trader(spark):
    """The chain and the trader with places choose the same orders."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        p, status = k + rng.randrange(3), rng.choice(["filled", "filled", "expired"])
        fill = p + rng.randrange(1, 4) if status == "filled" else None
        rows.append(("s", p, k, status, fill, fill and fill + rng.randrange(9), 4, rng.choice(["LONG", "SHORT"])))
    df = spark.createDataFrame(rows, "symbol string, placed_bar long, signal_id long, status string, fill_bar long, exit_bar long, expiry int, side string")
    for once in (False, True):
        trader, want = exits._Trader(1, once), []
        for r in sorted(df.collect(), key=lambda r: (r.placed_bar, r.signal_id)):
            if trader.takes(r):
                want.append(r.signal_id)
        for chunk in (16, chains.CHUNK):
            got = exits.select_trades(df, once_a_direction=once, chunk=chunk).collect()
            assert sorted(r.signal_id for r in got) == sorted(want)


def test_pairs_cut_anywhere_are_the_same(spark):
    """Positions and the run with a breaker, for chunks of bars and of days; the breaker acts in some days."""
    from tapeweave.jobs import studies

    rng = random.Random(4)
    rows = []
    for pair, n in (("a/b", 500), ("a/c", 90)):
        a = b = 100.0
        for i in range(n):
            a, b = a + rng.gauss(0, 1), b + rng.gauss(0, 1)
            z = None if i < 10 or rng.random() < 0.03 else rng.gauss(0, 1.5)
            rows.append((pair, i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00" if i < 720 else None, z, a, b, a + rng.gauss(0, 0.5), b + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "pair string, bar_idx long, ts string, z double, a_open double, b_open double, a_close double, b_close double").withColumn("ts", F.col("ts").cast("timestamp"))
    seen = lambda d: sorted(tuple(r) for r in d.collect())
    plain = seen(studies.pair_positions(df, 1.5, 0.3, 3.5, 12))
    run = seen(studies.breaker_positions(df, 0.05, 10_000.0, 1.5, 0.3, 3.5, 12, ratio=0.7, warmup=15))
    whys = [r[4] for r in run]
    assert whys.count("daily_circuit_breaker") > 3 and "revert" in whys and any(r[5] == "cancelled" for r in run)
    for chunk, days in ((40, 1), (97, 3)):
        assert seen(studies.pair_positions(df, 1.5, 0.3, 3.5, 12, chunk=chunk)) == plain
        assert seen(studies.breaker_positions(df, 0.05, 10_000.0, 1.5, 0.3, 3.5, 12, ratio=0.7, warmup=15, chunk=chunk, days=days)) == run
    # a limit that is never reached: the plain run, but for what is cancelled or open at the end
    free = [r[:5] for r in seen(studies.breaker_positions(df, 99.0, 10_000.0, 1.5, 0.3, 3.5, 12)) if r[4] != "end_of_data"]
    assert free == plain


@pytest.mark.parametrize("chunk", [1, 30, 200, chains.CHUNK])
def test_units_are_taken_once(spark, chunk):
    """Zones with lives that overlap, several candidates a bar, against a walk over everything."""
    rng = random.Random(5)
    rows = []
    for symbol, n in (("a", 60), ("b", 5)):
        k = 0
        bars = {}
        for zone in range(n):
            start = rng.randrange(900)
            for bar in range(start, start + rng.randrange(1, 30)):
                bars.setdefault(bar, []).append(zone)
        for bar in sorted(bars):
            rng.shuffle(bars[bar])
            for zone in bars[bar]:
                rows.append((symbol, bar, bar + rng.choice([0, 2, 15, 90]), zone, k))
                k += 1
    rows += [("c", 5, None, 1, 0), ("c", 9, 9, 2, 1)]
    want = []
    for symbol in "abc":
        free, used = -1, set()
        for s, at, until, zone, k in sorted((r for r in rows if r[0] == symbol), key=lambda r: (r[1], r[4])):
            if at > free and zone not in used:
                want.append((s, k))
                used.add(zone)
                free = float("inf") if until is None else until
    df = spark.createDataFrame(rows, "symbol string, at long, free long, zone int, signal_id long").repartition(4)
    got = chains.matched(df, F.col("at"), F.col("free"), F.col("zone"), chunk=chunk)
    assert sorted((r.symbol, r.signal_id) for r in got.collect()) == sorted(want)
    assert chains.matched(df.limit(0), F.col("at"), F.col("free"), F.col("zone"), chunk=chunk).collect() == []


def test_curves_cut_anywhere_are_the_same(spark):
    from tapeweave.operators import metrics

    rng = random.Random(6)
    rows = [(run, i, round(1000 + rng.gauss(0, 30), 2)) for run, n in (("a", 300), ("b", 1), ("c", 90)) for i in range(n)] + [("d", i, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "run string, bar_idx long, equity double")
    seen = lambda d: sorted(tuple(r) for r in d.collect())
    want = seen(metrics.equity_stats(df))
    for chunk in (1, 7, 64):
        assert seen(metrics.equity_stats(df, chunk=chunk)) == want
    longest = {}
    for run, i, equity in rows:
        peak = max(e for r, j, e in rows if r == run and j <= i)
        now = longest.setdefault(run, [0, 0])
        now[0] = now[0] + 1 if equity < peak else 0
        now[1] = max(now)
    assert {r.run: r.longest_dd for r in metrics.equity_stats(df, chunk=16).collect()} == {run: most for run, (_, most) in longest.items()}


def test_windows_cut_anywhere_are_the_same(spark):
    """Look-back columns and the last value known, for chunks shorter and longer than the look."""
    from tapeweave.functions import rolling
    from tapeweave.jobs import studies

    rng = random.Random(7)
    rows = [(s, i, rng.uniform(1, 9) if rng.random() < 0.97 else None, rng.uniform(1, 9)) for s, n in (("a", 200), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair string, bar_idx long, a_close double, b_close double")
    a, b = F.col("a_close"), F.col("b_close")

    def made(cut, by):
        return cut.withColumns({"w": rolling.wma(a, by, 5), "c": rolling.cci(a, b, a, by, 7), "m": rolling.sma(b, by, 6)}).withColumn("mm", rolling.rolling_max(F.col("m"), by, 4))

    def seen(d, *digits):
        return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in d.select(*digits).collect())

    names = "pair", "bar_idx", "w", "c", "m", "mm"
    whole = seen(rolling.in_chunks(df, 16, made, ("pair",)), *names)
    hedged = "pair", "bar_idx", "ratio", "mean_a", "var_b", "cov_ab"
    want = seen(studies.hedge_columns(df, 6), *hedged)
    assert len(whole) == len(rows) == len(want)
    for chunk in (1, 5, 64):
        assert seen(rolling.in_chunks(df, 16, made, ("pair",), chunk=chunk), *names) == whole
        assert seen(studies.hedge_columns(df, 6, chunk=chunk), *hedged) == want
    values = {(s, i): x for s, i, x, _ in rows}
    for r in rolling.in_chunks(df, 16, made, ("pair",), chunk=8).collect():
        own = [values.get((r.pair, r.bar_idx - j)) for j in range(5)]
        want = None if None in own else sum(x * (5 - j) for j, x in enumerate(own)) / 15
        assert r.w == pytest.approx(want) if want is not None else r.w is None
