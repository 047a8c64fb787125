"""Queries over bars made of `events`: sources, predicates, indicators, joins, audits; each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import recursive as rec
from ..functions import rolling as roll
from ..operators import align, quality, slices
from ..sources import adapters, bars, tables


#: Rows before a chunk that an indicator here can depend on, and the chunks that series are cut in.
LOOK, CUT = 64, 256


def by():
    """The window of an indicator: rows of `roll.in_chunks`."""
    return Window.partitionBy("symbol", "_chunk").orderBy("bar_idx")


def hi():
    return F.col("high")


def lo():
    return F.col("low")


def cl():
    return F.col("close")


def op():
    return F.col("open")


def vo():
    return F.col("volume")


QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- the same bars in SQL ------------------------------------------------------------------------

_TICKS = "ticks AS (SELECT event_type AS symbol, ts, value AS price, event_id AS id FROM events)"
_BARS = """raw_bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM raw_bars)"""
WITH = f"WITH RECURSIVE {_TICKS}, {_BARS}"
W = "(PARTITION BY symbol ORDER BY bar_idx)"


def _w(n: int, first: int | None = None, last: int = 0) -> str:
    start = n - 1 if first is None else first
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {start} PRECEDING AND {end})"


def full(x: str, agg: str, n: int, w: str | None = None) -> str:
    w = w or _w(n)
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {agg} OVER {w} END"


def r(x, digits: int = 6):
    """Half up, by the same arithmetic in both engines."""
    s = float(10**digits)
    if isinstance(x, str):
        return f"floor(({x}) * {s} + 0.5) / {s}"
    return F.floor(x * s + 0.5) / s


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.numbered(adapters.bars(spark, sf_dir))


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def indicator(name: str, columns, sql: dict[str, str], steps: str = "", before=None, plain: tuple = ()):
    """Registers a query of rounded indicator columns (made when it runs) on hourly bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = roll.in_chunks(base(spark, sf_dir), LOOK, lambda cut, _: (before(cut) if before else cut).withColumns(columns()), chunk=CUT)
        return rows.select("symbol", "ts", *(n if n in plain else r(F.col(n)).alias(n) for n in columns()))

    shown = ", ".join(f"{s if n in plain else r(s)} AS {n}" for n, s in sql.items())
    query(name, f"{WITH}{steps} SELECT symbol, ts, {shown} FROM {'x' if steps else 'bars'}")(run)


# --- sources -------------------------------------------------------------------------------------


@query("a9_resample_15m", f"""WITH {_TICKS} SELECT symbol, time_bucket(INTERVAL '15 minutes', ts) AS ts, first(price ORDER BY ts, id) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2""")
def resample_15m(spark, sf_dir):
    return adapters.bars(spark, sf_dir, 900)


@query("a9_resample_daily_from_hourly", f"""{WITH} SELECT symbol, date_trunc('day', ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
  last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2""")
def resample_daily(spark, sf_dir):
    return bars.resample(adapters.bars(spark, sf_dir), 86_400)


_DIRTY = """, dirty AS (SELECT symbol, ts, open, CASE WHEN bar_idx % 97 = 5 THEN low - 1 ELSE high END AS high, low, CASE WHEN bar_idx % 89 <> 7 THEN close END AS close, volume FROM bars),
marked AS (SELECT *, coalesce(high >= low AND open BETWEEN low AND high AND close BETWEEN low AND high, false) AS ok FROM dirty)"""


@query("s3_clean_bars", f"{WITH}{_DIRTY} SELECT symbol, ts, open, high, low, close, volume FROM marked WHERE ok")
def clean(spark, sf_dir):
    return bars.clean_bars(adapters.dirty_bars(spark, sf_dir))


@query("k6_rejected_bars", f"""{WITH}{_DIRTY} SELECT symbol, ts, CASE WHEN close IS NULL THEN 'no price' WHEN high < low THEN 'high below low' ELSE 'price outside range' END AS reason
  FROM marked WHERE NOT ok""")
def rejected(spark, sf_dir):
    return bars.rejected_bars(adapters.dirty_bars(spark, sf_dir)).select("symbol", "ts", "reason")


def _trendbars(spark, sf_dir, shift: bool = False):
    b = base(spark, sf_dir)
    cents = lambda c: F.floor(c * 100 + 0.5).cast("long")
    low = cents(lo()) + (F.col("bar_idx") % 7 if shift else F.lit(0))
    rows = b.select("symbol", "bar_idx", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("minutes"), low.alias("low"), *((cents(c) - cents(lo())).alias(f"d_{n}") for n, c in (("open", op()), ("high", hi()), ("close", cl()))), vo().cast("long").alias("volume"))
    return rows


@query("s4_decode_trendbars", f"""{WITH}, q AS (SELECT symbol, ts, CAST(floor(low * 100 + 0.5) AS BIGINT) AS l, CAST(floor(open * 100 + 0.5) AS BIGINT) AS o, CAST(floor(high * 100 + 0.5) AS BIGINT) AS h,
  CAST(floor(close * 100 + 0.5) AS BIGINT) AS c, volume FROM bars) SELECT symbol, ts, o / 100.0::DOUBLE AS open, h / 100.0::DOUBLE AS high, l / 100.0::DOUBLE AS low, c / 100.0::DOUBLE AS close, volume FROM q""")
def trendbars(spark, sf_dir):
    return bars.decode_trendbars(_trendbars(spark, sf_dir), 2)


@query("s5_attach_spread", f"{WITH} SELECT symbol, ts, CASE WHEN bar_idx % 5 = 0 THEN 0.0::DOUBLE ELSE round((bar_idx % 7) / 100.0::DOUBLE, 5) END AS spread FROM bars")
def attach_spread(spark, sf_dir):
    bid = bars.decode_trendbars(_trendbars(spark, sf_dir), 2)
    ask = bars.decode_trendbars(_trendbars(spark, sf_dir, True).where("bar_idx % 5 <> 0"), 2)
    return bars.attach_spread(bid, ask).select("symbol", "ts", "spread")


@query("s6_decode_rates", f"""{WITH} SELECT symbol, ts, open, volume, round((bar_idx % 40) * CASE WHEN symbol = 'click' THEN 0.01 ELSE 0.001 END::DOUBLE, 5) AS spread FROM bars""")
def decode_rates(spark, sf_dir):
    b = base(spark, sf_dir)
    rates = b.select("symbol", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("time"), *bars.OHLC, vo().cast("long").alias("tick_volume"), (F.col("bar_idx") % 40).alias("spread"))
    info = b.select("symbol").distinct().withColumn("point", F.when(F.col("symbol") == "click", 0.01).otherwise(0.001))
    return bars.decode_rates(rates, info).select("symbol", "ts", "open", "volume", "spread")


@query("s2_wall_clock", "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders")
def wall_clock(spark, sf_dir):
    zone = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+05:30").otherwise("")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), bars.wall_clock(text).alias("ts"))


@query("s7_normalise_vendor", f"{WITH}{_DIRTY} SELECT symbol, ts, open, high, low, close, volume FROM dirty WHERE close IS NOT NULL")
def normalise(spark, sf_dir):
    d = adapters.dirty_bars(spark, sf_dir).select("symbol", "ts", *bars.OHLC, "volume")
    return bars.normalise(d.toDF(*(c.upper() for c in d.columns)).withColumn("Dividends", F.lit(0.0)))


# --- predicates and splits -----------------------------------------------------------------------


@query("p1_split_by_dates", f"""{WITH}, s(split, a, b) AS (VALUES ('IS', NULL::TIMESTAMP, TIMESTAMP '2024-01-15'), ('OOS', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-24'), ('FWD', TIMESTAMP '2024-01-25', NULL), ('tiny', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01')),
x AS (SELECT split, symbol, ts FROM bars, s WHERE (a IS NULL OR ts >= a) AND (b IS NULL OR ts < b + INTERVAL 1 DAY)), y AS (SELECT *, count(*) OVER (PARTITION BY split, symbol) AS n FROM x)
SELECT split, symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM y WHERE n >= 50 GROUP BY 1, 2""")
def split_dates(spark, sf_dir):
    s = spark.sql("SELECT * FROM VALUES ('IS', NULL, DATE '2024-01-15'), ('OOS', DATE '2024-01-16', DATE '2024-01-24'), ('FWD', DATE '2024-01-25', NULL), ('tiny', DATE '2024-01-01', DATE '2024-01-01') AS t(split, start, stop)")
    cut = slices.split_by_dates(adapters.bars(spark, sf_dir), s, 40)
    return cut.groupBy("split", "symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("p2_split_by_fraction", f"""{WITH}, x AS (SELECT *, count(*) FILTER (ts < TIMESTAMP '2024-01-25') OVER (PARTITION BY symbol) AS n FROM bars)
SELECT symbol, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'FWD' WHEN bar_idx < floor(n * 0.65) THEN 'IS' ELSE 'OOS' END AS split, count(*) AS n FROM x GROUP BY 1, 2""")
def split_fraction(spark, sf_dir):
    import datetime

    return slices.split_by_fraction(base(spark, sf_dir), 0.65, datetime.datetime(2024, 1, 25)).groupBy("symbol", "split").agg(F.count("*").alias("n"))


@query("p3_session", f"{WITH} SELECT symbol, ts FROM bars WHERE (hour(ts) >= 7 AND hour(ts) < 12) OR (hour(ts) >= 13 AND hour(ts) < 17)")
def session(spark, sf_dir):
    return adapters.bars(spark, sf_dir).where(slices.in_session(F.col("ts"), "both")).select("symbol", "ts")


@query("p4_warmup", f"{WITH} SELECT symbol, ts, bar_idx FROM bars WHERE bar_idx >= 200")
def warmup(spark, sf_dir):
    return slices.after_warmup(base(spark, sf_dir)).select("symbol", "ts", "bar_idx")


@query("p8_last_bars", f"{WITH} SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 10")
def last_bars(spark, sf_dir):
    return slices.last_bars(adapters.bars(spark, sf_dir), 10).select("symbol", "ts", "close")


# --- joins ---------------------------------------------------------------------------------------


@query("j1_align_pair", f"{WITH} SELECT a.ts, a.close AS a_close, b.close AS b_close FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'")
def align_pair(spark, sf_dir):
    b = adapters.bars(spark, sf_dir)
    return align.align_pair(b.where("symbol = 'click'"), b.where("symbol = 'view'"), ("close",))


@query("j2_higher_timeframe", f"""{WITH}, d AS (SELECT symbol, date_trunc('day', ts) AS ts, last(close ORDER BY ts) AS close FROM bars GROUP BY 1, 2),
c AS (SELECT symbol, close, coalesce(lead(ts) OVER w, ts + coalesce(ts - lag(ts) OVER w, INTERVAL 60 SECOND)) AS close_ts FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT b.symbol, b.ts, b.close, c.close AS daily_close FROM bars b ASOF LEFT JOIN c ON b.symbol = c.symbol AND b.ts >= c.close_ts""")
def higher_timeframe(spark, sf_dir):
    b = adapters.bars(spark, sf_dir).select("symbol", "ts", "close")
    daily = bars.resample(adapters.bars(spark, sf_dir), 86_400).select("symbol", "ts", "close")
    return align.attach_higher_timeframe(b, daily, {"close": "daily_close"})


@query("j3_effective_spread", f"{WITH} SELECT symbol, ts, 0.3 * CASE WHEN hour(ts) >= 22 OR hour(ts) < 3 THEN 2.5 WHEN hour(ts) < 12 THEN 1.2 ELSE 1.0 END::DOUBLE AS spread FROM bars")
def effective_spread(spark, sf_dir):
    return align.effective_spread(adapters.bars(spark, sf_dir), 0.3, {3: 1.2, 12: 1.0, 22: 2.5}).select("symbol", "ts", "spread")


@query("j13_window_slices", f"""{WITH}, n AS (SELECT symbol, (count(*) - 240) // 60 AS k FROM bars GROUP BY 1),
w AS (SELECT symbol, unnest(generate_series(0, k - 1)) AS w FROM n),
x AS (SELECT b.symbol, w.w AS window_idx, CASE WHEN bar_idx < 240 + w.w * 60 THEN 'IS' ELSE 'OOS' END AS phase, bar_idx FROM bars b JOIN w ON b.symbol = w.symbol AND bar_idx >= w.w * 60 AND bar_idx < 300 + w.w * 60)
SELECT symbol, window_idx, phase, count(*) AS n, min(bar_idx) AS first_bar, max(bar_idx) AS last_bar FROM x GROUP BY 1, 2, 3""")
def window_slices(spark, sf_dir):
    s = slices.window_slices(base(spark, sf_dir), 240, 60)
    return s.groupBy("symbol", "window_idx", "phase").agg(F.count("*").alias("n"), F.min("bar_idx").alias("first_bar"), F.max("bar_idx").alias("last_bar"))


@query("s1_csv_bars", f"{WITH} SELECT symbol, ts, open, high, low, close FROM bars")
def csv_bars(spark, sf_dir):
    """All bars written as CSV files, one folder a symbol, and read back."""
    b = adapters.bars(spark, sf_dir)
    path = f"{tables.shared_dir(spark)}/tapeweave/csv-{uuid.uuid4().hex}"
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("DateTime")
    b.select(iso, *(F.col(c).alias(c.capitalize()) for c in ("open", "high", "low", "close", "volume")), "symbol").write.option("header", True).partitionBy("symbol").csv(path)
    read = bars.read_bars_csv(spark, path, by_folder="symbol")
    return read.select("symbol", F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"), "open", "high", "low", "close")


@query("s9_bar_store", f"{WITH} SELECT symbol, ts, close FROM bars WHERE symbol >= 'error' AND ts < TIMESTAMP '2024-01-20'")
def bar_store(spark, sf_dir):
    """All bars in a store by symbol and month; symbols and days read from it."""
    path = f"{tables.shared_dir(spark)}/tapeweave/store-{uuid.uuid4().hex}"
    bars.write_store(adapters.bars(spark, sf_dir), path)
    return bars.read_store(spark, path).where((F.col("symbol") >= "error") & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))).select("symbol", "ts", "close")


@query("j11_merge_symbols", f"{WITH} SELECT ts, CAST(dense_rank() OVER (ORDER BY symbol) - 1 AS INTEGER) AS symbol_rank, bar_idx, close FROM bars")
def merge_symbols(spark, sf_dir):
    b = base(spark, sf_dir)
    return align.merge_symbols(b, align.symbol_ranks(b)).select("ts", "symbol_rank", "bar_idx", "close")


# --- rolling indicators --------------------------------------------------------------------------

indicator("i0_shift_rolling", lambda: {"shift3": roll.shift(cl(), by(), 3), "max20": roll.rolling_max(hi(), by(), 20), "min20": roll.rolling_min(lo(), by(), 20)}, {"shift3": f"lag(close, 3) OVER {W}", "max20": full("high", "max(high)", 20), "min20": full("low", "min(low)", 20)})
indicator("i1_sma", lambda: {"sma20": roll.sma(cl(), by(), 20)}, {"sma20": full("close", "avg(close)", 20)})
indicator("i2_wma", lambda: {"wma10": roll.wma(cl(), by(), 10)}, {"wma10": "CASE WHEN len(v) = 10 THEN list_sum([v[i] * i FOR i IN range(1, 11)]) / 55.0 END"}, f", x AS (SELECT *, list(close) OVER {_w(10)} AS v FROM bars)")
indicator("i3_bollinger", lambda: roll.bollinger(cl(), by()), {"bb_mid": full("close", "avg(close)", 20), "bb_upper": f"{full('close', 'avg(close)', 20)} + 2 * {full('close', 'stddev_pop(close)', 20)}", "bb_lower": f"{full('close', 'avg(close)', 20)} - 2 * {full('close', 'stddev_pop(close)', 20)}"})
_K = f"100 * (close - {full('low', 'min(low)', 14)}) / nullif({full('high', 'max(high)', 14)} - {full('low', 'min(low)', 14)}, 0)"
indicator("i4_stochastic", lambda: {"stoch_k": F.col("k"), "stoch_d": roll.sma(F.col("k"), by(), 3)}, {"stoch_k": "k", "stoch_d": full("k", "avg(k)", 3)}, f", x AS (SELECT *, {_K} AS k FROM bars)", lambda df: df.withColumn("k", roll.stochastic_k(hi(), lo(), cl(), by())))
indicator("i5_cci", lambda: {"cci": roll.cci(hi(), lo(), cl(), by())}, {"cci": "CASE WHEN len(v) = 20 THEN (tp - m) / nullif(0.015 * (list_sum([abs(e - m) FOR e IN v]) / 20), 0) END"},
          f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), x AS (SELECT *, list(tp) OVER {_w(20)} AS v, avg(tp) OVER {_w(20)} AS m FROM t)")
indicator("i6_mfi", lambda: {"mfi": roll.mfi(F.col("up"), F.col("down"), by())}, {"mfi": f"CASE WHEN count(*) OVER {_w(14)} = 14 THEN 100 - 100 / (1 + sum(up) OVER {_w(14)} / nullif(sum(down) OVER {_w(14)}, 0)) END"},
          f", t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), u AS (SELECT *, lag(tp) OVER {W} AS b FROM t), x AS (SELECT *, CASE WHEN tp > b THEN tp * volume ELSE 0.0::DOUBLE END AS up, CASE WHEN tp < b THEN tp * volume ELSE 0.0::DOUBLE END AS down FROM u)",
          lambda df: df.withColumn("tp", (hi() + lo() + cl()) / 3).withColumn("tb", F.lag("tp").over(by())).withColumn("up", roll.mfi_flows(F.col("tp"), F.col("tb"), vo())[0]).withColumn("down", roll.mfi_flows(F.col("tp"), F.col("tb"), vo())[1]))
_SH, _SL = full("high", "max(high)", 15, _w(15, 15, 1)), full("low", "min(low)", 15, _w(15, 15, 1))
indicator("i7_swings", lambda: {"swing_high": roll.swing_high(hi(), by(), 15), "swing_low": roll.swing_low(lo(), by(), 15)}, {"swing_high": _SH, "swing_low": _SL})
indicator("i8_highs_lows", lambda: {"hh": roll.higher_highs(hi(), by()), "ll": roll.lower_lows(lo(), by())}, {"hh": f"CASE WHEN high > {full('high', 'max(high)', 5, _w(5, 5, 1))} THEN 1.0::DOUBLE ELSE 0.0 END", "ll": f"CASE WHEN low < {full('low', 'min(low)', 5, _w(5, 5, 1))} THEN 1.0::DOUBLE ELSE 0.0 END"})
_TR = f", x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)"
indicator("i9_true_range", lambda: {"tr": F.col("tr"), "atr14": roll.sma(F.col("tr"), by(), 14)}, {"tr": "tr", "atr14": full("tr", "avg(tr)", 14)}, _TR, lambda df: df.withColumn("tr", roll.true_range(hi(), lo(), cl(), by())))
indicator("i10_fair_value_gaps", lambda: roll.fair_value_gaps(hi(), lo(), by()),
          {"fvg_bear": "coalesce(high < l2, false)", "fvg_bull": "coalesce(low > h2, false)", "fvg_bottom": "CASE WHEN high < l2 THEN high WHEN low > h2 THEN h2 END", "fvg_top": "CASE WHEN high < l2 THEN l2 WHEN low > h2 THEN low END"},
          f", x AS (SELECT *, lag(high, 2) OVER {W} AS h2, lag(low, 2) OVER {W} AS l2 FROM bars)", plain=("fvg_bear", "fvg_bull"))
indicator("i11_liquidity_sweeps", lambda: roll.liquidity_sweeps(hi(), lo(), cl(), F.col("atr"), by()),
          {"sweep_bear": "coalesce(atr <> 0 AND high > sh AND close < sh AND high - sh >= 0.5 * atr, false)", "sweep_bull": "coalesce(atr <> 0 AND low < sl AND close > sl AND sl - low >= 0.5 * atr, false)"},
          f"{_TR.replace('x AS', 't AS')}, x AS (SELECT *, {full('tr', 'avg(tr)', 14)} AS atr, {_SH} AS sh, {_SL} AS sl FROM t)",
          lambda df: df.withColumn("tr", roll.true_range(hi(), lo(), cl(), by())).withColumn("atr", roll.sma(F.col("tr"), by(), 14)), plain=("sweep_bear", "sweep_bull"))

_PAIR = f"""{WITH}, p AS (SELECT a.ts, a.close AS a, b.close AS b, 'p' AS symbol FROM bars a JOIN bars b ON a.ts = b.ts WHERE a.symbol = 'click' AND b.symbol = 'view'),
q AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS bar_idx, a - 1.5 * b AS s FROM p), z AS (SELECT *, ln(a / lag(a) OVER {W}) AS ra, ln(b / lag(b) OVER {W}) AS rb FROM q)"""


def _pair(spark, sf_dir):
    b = adapters.bars(spark, sf_dir)
    p = align.align_pair(b.where("symbol = 'click'"), b.where("symbol = 'view'"), ("close",)).select("ts", F.col("a_close").alias("a"), F.col("b_close").alias("b"), F.lit("p").alias("symbol"))
    p = adapters.numbered(p)
    def made(cut, w):
        cut = cut.withColumns({"s": F.col("a") - 1.5 * F.col("b"), "ra": roll.log_return(F.col("a"), w), "rb": roll.log_return(F.col("b"), w)})
        return cut.withColumns({"z": roll.zscore(F.col("s"), w, 30), "corr": roll.rolling_corr(F.col("ra"), F.col("rb"), w, 40), "hedge": roll.rolling_hedge_ratio(F.col("a"), F.col("b"), w, 40)})

    return roll.in_chunks(p, LOOK, made, chunk=CUT)


@query("i12_pair_zscore", f"{_PAIR} SELECT ts, {r('s')} AS spread, {r(f'CASE WHEN count(s) OVER {_w(30)} = 30 THEN (s - avg(s) OVER {_w(30)}) / nullif(stddev_samp(s) OVER {_w(30)}, 0) END')} AS z FROM z")
def pair_zscore(spark, sf_dir):
    return _pair(spark, sf_dir).select("ts", r(F.col("s")).alias("spread"), r(F.col("z")).alias("z"))


@query("i13_i14_corr_hedge", f"{_PAIR} SELECT ts, {r(full('ra + rb', 'corr(ra, rb)', 40))} AS corr, {r(full('a + b', 'regr_slope(a, b)', 40))} AS hedge FROM z")
def corr_hedge(spark, sf_dir):
    return _pair(spark, sf_dir).select("ts", r(F.col("corr")).alias("corr"), r(F.col("hedge")).alias("hedge"))


# --- recursive indicators ------------------------------------------------------------------------


def scan_sql(name: str, source: str, x: str, alpha: str) -> str:
    """A CTE that adds the recursion of x as `name` to the rows of `source` (leading nulls skipped)."""
    return f"""{name}_f AS (SELECT symbol, min(bar_idx) AS f FROM {source} WHERE {x} IS NOT NULL GROUP BY 1),
{name}_r AS (SELECT s.symbol, s.bar_idx, s.{x} AS y FROM {source} s JOIN {name}_f f ON s.symbol = f.symbol AND s.bar_idx = f.f
  UNION ALL SELECT s.symbol, s.bar_idx, coalesce(({alpha}) * s.{x} + (1 - ({alpha})) * p.y, p.y) FROM {name}_r p JOIN {source} s ON s.symbol = p.symbol AND s.bar_idx = p.bar_idx + 1),
{name}_t AS (SELECT s.*, v.y AS {name} FROM {source} s LEFT JOIN {name}_r v ON s.symbol = v.symbol AND s.bar_idx = v.bar_idx)"""


#: Short chunks, so that the queries cross many chunk borders.
_CHUNK = 128


def recursive(name: str, run, ctes: list[str], last: str, out: list[str]):
    def f(spark, sf_dir):
        rows = run(base(spark, sf_dir))
        return rows.select("symbol", "ts", *(r(F.col(c)).alias(c) for c in out))

    query(name, f"{WITH}, {', '.join(ctes)} SELECT symbol, ts, {', '.join(f'{r(c)} AS {c}' for c in out)} FROM {last}")(f)


recursive("e1_ema", lambda df: rec.ewm(df, {"ema10": ("close", rec.span(10)), "ema30": ("close", rec.span(30))}, chunk=_CHUNK), [scan_sql("ema10", "bars", "close", "2.0/11"), scan_sql("ema30", "ema10_t", "close", "2.0/31")], "ema30_t", ["ema10", "ema30"])
recursive("e1b_ewm", lambda df: rec.ewm(df, {"y": ("close", 0.2)}, chunk=_CHUNK), [scan_sql("y", "bars", "close", "0.2")], "y_t", ["y"])
recursive("e2_dema_tema", lambda df: rec.dema_tema(df, "close", 10, chunk=_CHUNK), [scan_sql("e1", "bars", "close", "2.0/11"), scan_sql("e2", "e1_t", "e1", "2.0/11"), scan_sql("e3", "e2_t", "e2", "2.0/11"), "q AS (SELECT *, 2 * e1 - e2 AS dema, 3 * e1 - 3 * e2 + e3 AS tema FROM e3_t)"], "q", ["dema", "tema"])
_TRX = _TR[2:]
recursive("e3_atr_ewm", lambda df: rec.atr(df, chunk=_CHUNK), [_TRX, scan_sql("atr", "x", "tr", "1.0/14")], "atr_t", ["atr"])


def _bands(df):
    d = rec.ewm(rec.atr(df, chunk=_CHUNK), {"mid": ("close", rec.span(14))}, chunk=_CHUNK)
    return d.withColumns({"upper": F.col("mid") + 2 * F.col("atr"), "lower": F.col("mid") - 2 * F.col("atr")})


recursive("e4_atr_bands", _bands, [_TRX, scan_sql("atr", "x", "tr", "1.0/14"), scan_sql("mid", "atr_t", "close", "2.0/15"), "q AS (SELECT *, mid + 2 * atr AS upper, mid - 2 * atr AS lower FROM mid_t)"], "q", ["mid", "upper", "lower"])
_MOVES = f"m AS (SELECT *, greatest(close - lag(close) OVER {W}, 0) + (close - lag(close) OVER {W}) * 0 AS g, greatest(lag(close) OVER {W} - close, 0) + (close - lag(close) OVER {W}) * 0 AS l FROM bars)"
recursive("e5_rsi", lambda df: rec.rsi(df, chunk=_CHUNK), [_MOVES, scan_sql("u", "m", "g", "1.0/14"), scan_sql("d", "u_t", "l", "1.0/14"), "q AS (SELECT *, 100 - 100 / (1 + u / nullif(d, 0)) AS rsi FROM d_t)"], "q", ["rsi"])
recursive("e6_macd", lambda df: rec.macd(df, chunk=_CHUNK), [scan_sql("f", "bars", "close", "2.0/13"), scan_sql("s", "f_t", "close", "2.0/27"), "n AS (SELECT *, f - s AS macd FROM s_t)", scan_sql("macd_signal", "n", "macd", "2.0/10"), "q AS (SELECT *, macd - macd_signal AS macd_hist FROM macd_signal_t)"], "q", ["macd", "macd_signal", "macd_hist"])
_DM = f"""dm AS (SELECT *, high - lag(high) OVER {W} AS dh, low - lag(low) OVER {W} AS dl FROM x), dd AS (SELECT *, CASE WHEN dh > abs(dl) AND dh > 0 THEN dh ELSE 0.0::DOUBLE END AS p, CASE WHEN abs(dl) > dh AND dl < 0 THEN abs(dl) ELSE 0.0::DOUBLE END AS mm FROM dm)"""
recursive("e7_adx", lambda df: rec.adx(df, chunk=_CHUNK), [_TRX, _DM, scan_sql("sa", "dd", "tr", "1.0/14"), scan_sql("sp", "sa_t", "p", "1.0/14"), scan_sql("sm", "sp_t", "mm", "1.0/14"), "di AS (SELECT *, 100 * sp / nullif(sa, 0) AS plus_di, 100 * sm / nullif(sa, 0) AS minus_di FROM sm_t)",
          "dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dxv FROM di)", scan_sql("adx", "dx", "dxv", "1.0/14")], "adx_t", ["adx", "plus_di", "minus_di"])


# --- audits --------------------------------------------------------------------------------------


@query("q3_bar_gaps", f"""{WITH}, g AS (SELECT symbol, ts, epoch(ts) - epoch(lag(ts) OVER {W}) AS gap FROM bars), m AS (SELECT symbol, min(gap) AS period FROM (SELECT symbol, gap, count(*) AS n, max(count(*)) OVER (PARTITION BY symbol) AS top FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE n = top GROUP BY 1)
SELECT symbol, ts, CAST(gap AS BIGINT) AS gap, CAST(period AS BIGINT) AS period FROM g JOIN m USING (symbol) WHERE gap > period""")
def bar_gaps(spark, sf_dir):
    return quality.bar_gaps(adapters.bars(spark, sf_dir)).select("symbol", "ts", "gap", "period")


@query("q1_causality_audit", f"""{WITH}, n AS (SELECT symbol, count(*) // 2 AS half, max(close) AS top_all FROM bars GROUP BY 1), t AS (SELECT b.symbol, max(close) AS top_half FROM bars b JOIN n USING (symbol) WHERE bar_idx < half GROUP BY 1)
SELECT b.symbol, b.bar_idx, 'peeks' AS feature FROM bars b JOIN n USING (symbol) JOIN t USING (symbol) WHERE bar_idx < half AND bar_idx >= half - 5 AND abs(close / top_half - close / top_all) > 1e-9 * abs(close / top_all)""")
def causality(spark, sf_dir):
    whole = Window.partitionBy("symbol")
    features = lambda df: df.withColumns({"sma20": roll.sma(cl(), whole.orderBy("bar_idx"), 20), "peeks": cl() / F.max("close").over(whole)})
    return quality.causality_audit(features, base(spark, sf_dir), ["sma20", "peeks"]).select("symbol", "bar_idx", "feature")
