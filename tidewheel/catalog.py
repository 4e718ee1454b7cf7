"""All queries of the library over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel import sinks
from tidewheel.config import ExperimentConfig, TargetConfig
from tidewheel.ml import evaluate, local, prepare
from tidewheel.ml import run as experiment
from tidewheel.operators import indicators, mapping, quality, structure
from tidewheel.oracle import sql as S
from tidewheel.plans.features import compute, failures
from tidewheel.sources import rest
from tidewheel.sources.candles import daily, hourly, last_times, parse_klines, table
from tidewheel.streaming import live, ticker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def bar(c="ts"):
    """A time as hours since 1970."""
    return F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / 3600).cast("bigint")


def show(df: DataFrame, doubles: list[str], others: list[str] = (), digits: int = 6) -> DataFrame:
    return df.select("symbol", bar().alias("bar"), *(F.round(F.col(f"`{c}`"), digits).alias(c) for c in doubles), *(F.col(f"`{c}`") for c in others))


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


#: the numbers and other columns of each query of hourly features
SHOWN: dict[str, list[str]] = {}


def feature(name: str, build: Callable[[DataFrame], DataFrame], doubles: list[str], others: list[str], sql: str, source: Callable = hourly, digits: int = 6) -> None:
    add(name, lambda spark, d: show(build(source(spark, d)), doubles, others, digits), sql)
    if source is hourly:
        SHOWN[name] = [*doubles, *others]


# ---- indicators -------------------------------------------------------------------------------------------------

r, lag, safe, ewm, final, simple, W = S.rolling, S.lag, S.safe, S.ewm, S.final, S.simple, S.windows

_x = {f"Return_{n}h": f"{safe('close', lag('close', n))} - 1" for n in (1, 3, 6, 12, 24)}
_x["Log_Return"] = f"ln(CASE WHEN {safe('close', lag('close'))} > 0 THEN {safe('close', lag('close'))} END)"
feature("win01_returns", indicators.returns, list(_x), [], simple(_x))

_x = {f"SMA_{n}": r("avg", "close", n) for n in (10, 20, 50)}
_x |= {f"Close_SMA{n}_Ratio": safe("close", r("avg", "close", n)) for n in (10, 20)}
feature("win03_sma", indicators.trend, list(_x), [], simple(_x, (10, 20, 50)))

_c = ["EMA_20", "EMA_50", "Close_EMA20_Ratio"]
_s = f"{S.CANDLES}, {ewm('a', 'candles', 'close', 2 / 21, 'EMA_20')}, {ewm('b', 'a', 'close', 2 / 51, 'EMA_50')}, f AS (SELECT *, close / nullif(\"EMA_20\", 0) AS \"Close_EMA20_Ratio\" FROM b)"
feature("win04_ema", indicators.trend, _c, [], final(_s, _c))

_s = f"{S.CANDLES}, d AS (SELECT *, greatest(close - {lag('close')}, 0 * {lag('close')}) AS g, greatest({lag('close')} - close, 0 * {lag('close')}) AS s FROM candles {W()})"
for _n in (7, 14):
    _p = "d" if _n == 7 else "l7"
    _s += f", {ewm(f'g{_n}', _p, 'g', 1 / _n, f'u{_n}', _n)}, {ewm(f'l{_n}', f'g{_n}', 's', 1 / _n, f'v{_n}', _n)}"
_s += ", f AS (SELECT *, " + ", ".join(f'CASE WHEN v{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + u{n} / nullif(v{n}, 0)) END AS "RSI_{n}"' for n in (7, 14)) + " FROM l14)"
feature("win05_rsi", lambda c: indicators.rsi(indicators.rsi(c, 7), 14), ["RSI_7", "RSI_14"], [], final(_s, ["RSI_7", "RSI_14"]))

_c = ["MACD", "MACD_Signal", "MACD_Histogram"]
_s = f"{S.CANDLES}, {ewm('a', 'candles', 'close', 2 / 13, 'fast')}, {ewm('b', 'a', 'close', 2 / 27, 'slow')}, m AS (SELECT *, fast - slow AS \"MACD\" FROM b), {ewm('n', 'm', '\"MACD\"', 0.2, 'MACD_Signal')}, f AS (SELECT *, \"MACD\" - \"MACD_Signal\" AS \"MACD_Histogram\" FROM n)"
feature("win06_macd", indicators.macd, _c, [], final(_s, _c))

_lo, _hi = r("min", "low", 14), r("max", "high", 14)
_s = f"{S.CANDLES}, k AS (SELECT *, (100 * (close - ({_lo}))) / nullif(({_hi}) - ({_lo}), 0) AS \"Stoch_%K\" FROM candles {W(14)}), f AS (SELECT *, {r('avg', '\"Stoch_%K\"', 3)} AS \"Stoch_%D\" FROM k {W(3)})"
feature("win07_stochastic", indicators.stochastic, ["Stoch_%K", "Stoch_%D"], [], final(_s, ["Stoch_%K", "Stoch_%D"]))

feature("win08_roc", lambda c: c.withColumn("ROC_12", indicators.change(F.col("close"), 12) * 100), ["ROC_12"], [], simple({"ROC_12": f"({safe('close', lag('close', 12))} - 1) * 100"}))
feature("win09_atr", indicators.atr, ["ATR_14"], [], final(S.ATR.format(src=S.CANDLES), ["ATR_14"], source="r1"))

_m, _d = r("avg", "close", 20), r("stddev_samp", "close", 20)
_x = {"BB_Upper": f"({_m}) + 2 * ({_d})", "BB_Lower": f"({_m}) - 2 * ({_d})", "BB_Width": safe(f"4 * ({_d})", f"({_m})")}
feature("win10_bollinger", indicators.bands, list(_x), [], simple(_x, (20,)))

_s = f"{S.CANDLES}, g AS (SELECT *, ln(CASE WHEN {safe('close', lag('close'))} > 0 THEN {safe('close', lag('close'))} END) AS lr FROM candles {W()}), f AS (SELECT *, {r('stddev_samp', 'close', 24)} AS \"Rolling_Std_24\", ({r('stddev_samp', 'lr', 24)}) * sqrt(24) AS \"Historical_Volatility\" FROM g {W(24)})"
feature("win11_volatility", indicators.volatility, ["Rolling_Std_24", "Historical_Volatility"], [], final(_s, ["Rolling_Std_24", "Historical_Volatility"]))

_c = ["OBV", "Volume_SMA20", "Volume_Ratio", "Volume_Change_Pct"]
_s = f"{S.CANDLES}, g AS (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS sv FROM candles {W()}), f AS (SELECT *, sum(sv) OVER wa AS \"OBV\", {r('avg', 'volume', 20)} AS \"Volume_SMA20\", volume / nullif({r('avg', 'volume', 20)}, 0) AS \"Volume_Ratio\", ({safe('volume', lag('volume'))} - 1) * 100 AS \"Volume_Change_Pct\" FROM g {W(20)})"
feature("win13_volume", indicators.volume, _c, [], final(_s, _c))

_x = {"Rolling_Mean_24": r("avg", "close", 24), "Rolling_Std_24_Close": r("stddev_samp", "close", 24), "Rolling_Max_24": r("max", "close", 24), "Rolling_Min_24": r("min", "close", 24)}
feature("win15_rolling_stats", indicators.rolling_stats, list(_x), [], simple(_x, (24,)))

_x = {k: safe(f"close - {x}", x) for k, x in {"Distance_From_ATH": "max(high) OVER wa", "Distance_From_30D_High": "max(high) OVER w720", "Distance_From_30D_Low": "min(low) OVER w720"}.items()}
feature("win16_relative_strength", indicators.relative_strength, list(_x), [], simple(_x, (720,)))

_h, _l = "(max(high) OVER w100)", "(min(low) OVER w100)"
_x = {"Fib_Swing_High": _h, "Fib_Swing_Low": _l}
for _f in indicators.FIB_RATIOS:
    _v = f"({_l} + ({_h} - {_l}) * {_f})"
    _x |= {f"Fib_Level_{round(_f * 1000)}": _v, f"Fib_Distance_{round(_f * 1000)}": safe(f"close - {_v}", "close")}
# quotients of prices with two decimals end on a 5 in the seventh place now and then
feature("win18_fibonacci", indicators.fibonacci, list(_x), [], simple(_x, (100,), digits=9), digits=9)

_x = {
    "Body_Size": "abs(close - open)",
    "Upper_Wick": "high - greatest(open, close)",
    "Lower_Wick": "least(open, close) - low",
    "Body_Pct": safe("abs(close - open)", "high - low"),
    "Range_Pct": safe("high - low", "open"),
    "High_Low_Pct": safe("high - low", "low") + " * 100",
    "Bullish_Candle": "CAST(close > open AS INT)",
    "Bearish_Candle": "CAST(close < open AS INT)",
}
feature("scl01_candle", indicators.candle, list(_x)[:6], list(_x)[6:], simple(_x, ints=("Bullish_Candle", "Bearish_Candle")))

_x = {"Hour": "CAST(hour(ts) AS INT)", "Day_Of_Week": "CAST(isodow(ts) - 1 AS INT)", "Month": "CAST(month(ts) AS INT)", "Weekend_Flag": "CAST(isodow(ts) >= 6 AS INT)"}
feature("scl02_clock", indicators.clock, [], list(_x), simple(_x, ints=tuple(_x)))

# ---- structure --------------------------------------------------------------------------------------------------

_d = ["Last_Swing_High", "Last_Swing_Low", "Distance_To_Swing_High", "Distance_To_Swing_Low"]
_i = ["Higher_High", "Lower_High", "Higher_Low", "Lower_Low"]
_sw = f"{S.CANDLES}, {S.SWINGS.format(base='candles')}"
feature("win19_swings", structure.swings, _d, _i, final(_sw, _d, _i, source="s3"))
_i = ["Current_Trend", "Break_Of_Structure", "Change_Of_Character"]
feature("seq01_trend", lambda c: structure.trend_state(structure.swings(c)), [], _i, "WITH RECURSIVE " + final(f"{_sw}, {S.TREND}", [], _i).removeprefix("WITH "))
_ob = [f"{p}{s}{q}" for s in ("Bullish", "Bearish") for p, q in (("", "_OB_Exists"), ("Distance_To_", "_OB"), ("", "_OB_Age"), ("", "_OB_Retest_Count"))]
feature("seq02_order_blocks", lambda c: structure.order_blocks(structure.swings(indicators.atr(c))), [c for c in _ob if c.startswith("Dist")], [c for c in _ob if not c.startswith("Dist")], S.order_blocks())
feature("seq03_fair_value_gaps", structure.fair_value_gaps, ["Distance_To_Bullish_FVG", "Distance_To_Bearish_FVG"], ["Bullish_FVG", "Bearish_FVG", "FVG_Filled", "FVG_Age"], S.fair_value_gaps())

_c = [f"Distance_To_Prev_{k}" for k in ("Day_High", "Day_Low", "Week_High", "Week_Low")]
_s = f"""{S.CANDLES}, d AS (SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS dh, min(low) AS dl FROM candles GROUP BY ALL),
  k AS (SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS wk, max(high) AS wh, min(low) AS wl FROM candles GROUP BY ALL),
  f AS (SELECT c.*, (close - dh) / nullif(close, 0) AS "{_c[0]}", (close - dl) / nullif(close, 0) AS "{_c[1]}", (close - wh) / nullif(close, 0) AS "{_c[2]}", (close - wl) / nullif(close, 0) AS "{_c[3]}"
    FROM candles c LEFT JOIN d ON d.symbol = c.symbol AND d.day = CAST(c.ts AS DATE) - 1
    LEFT JOIN k ON k.symbol = c.symbol AND k.wk = CAST(date_trunc('week', c.ts) AS DATE) - CASE WHEN isodow(c.ts) = 7 THEN 7 ELSE 14 END)"""
feature("win22_liquidity", structure.liquidity, _c, [], final(_s, _c))

#: the context's columns, and the query and column that each of them but the close comes from
CONTEXT_FROM = {"Close": ("", ""), "Return_1h": ("win01_returns", "Return_1h"), "RSI_14": ("win05_rsi", "RSI_14"), "ATR_14": ("win09_atr", "ATR_14"), "BB_Width": ("win10_bollinger", "BB_Width"), "Trend": ("seq01_trend", "Current_Trend"), "Volume_Change": ("win13_volume", "Volume_Change_Pct"), "Volatility_24": ("win11_volatility", "Historical_Volatility")}


def context_sql() -> str:
    """The context symbol's columns, from the twins of the queries that show them."""
    parts = ["WITH " + S.CANDLES + f", keys AS (SELECT symbol, {S.BAR}, close FROM candles), b0 AS (SELECT bar, round(close, 6) AS \"BTC_Close\" FROM keys WHERE symbol = 'purchase')"]
    cols, joins = ['"BTC_Close"'], ["LEFT JOIN b0 ON b0.bar = k.bar AND k.symbol <> 'purchase'"]
    for i, (name, (query, column)) in enumerate(list(CONTEXT_FROM.items())[1:], 1):
        parts.append(f"b{i} AS (SELECT bar, \"{column}\" AS \"BTC_{name}\" FROM ({SQL[query]}) WHERE symbol = 'purchase')")
        joins.append(f"LEFT JOIN b{i} ON b{i}.bar = k.bar AND k.symbol <> 'purchase'")
        cols.append(f'"BTC_{name}"')
    return f"{', '.join(parts)} SELECT k.symbol, k.bar, {', '.join(cols)} FROM keys k {' '.join(joins)}"


_CONTEXT = [f"BTC_{k}" for k in CONTEXT_FROM if k != "Trend"]
add("jn01_market_context", lambda spark, d: show(structure.market_context(compute(hourly(spark, d), ["returns", "momentum", "volatility", "volume", "trend_state"]), "purchase"), _CONTEXT, ["BTC_Trend"]), context_sql())


def all_features(spark: SparkSession, d: str) -> DataFrame:
    """Every feature of a whole run: by symbol and feature, the values there are and their mean."""
    f = compute(hourly(spark, d))
    names = [c for c in f.columns if c not in ("symbol", "ts", *quality.NUMBERS)]
    cells = [x for i, c in enumerate(names) for x in (F.count(F.col(f"`{c}`")).alias(f"n{i}"), F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}"))]
    wide = f.groupBy("symbol").agg(*cells)
    long = wide.select("symbol", F.expr(f"stack({len(names)}, " + ", ".join(f"'{c}', n{i}, m{i}" for i, c in enumerate(names)) + ") as (feature, n, mean)"))
    return long.withColumn("mean", F.round("mean", 4))


def all_features_sql() -> str:
    """The same from the twins of the feature queries."""
    one = lambda q, c: f"SELECT symbol, '{c}' AS feature, count(\"{c}\") AS n, round(avg(CAST(\"{c}\" AS DOUBLE)), 4) AS mean FROM {q} GROUP BY symbol"
    seen, with_, parts = set(), [], []
    for q, columns in SHOWN.items():
        new = [c for c in columns if c not in seen]
        seen |= set(new)
        if new:
            with_.append(f"q_{q} AS MATERIALIZED ({SQL[q]})")
            parts += [one(f"q_{q}", c) for c in new]
    return f"WITH {', '.join(with_)} {' UNION ALL '.join(parts)}"


add("plan_all_features", all_features, all_features_sql())

# ---- data quality -----------------------------------------------------------------------------------------------


def dirty(spark: SparkSession, d: str) -> DataFrame:
    """Candles with faults put in by rule: repeats, null times, nulls, negatives, broken ranges, rows out of order."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = hourly(spark, d).withColumn("i", F.row_number().over(w))
    twice = c.where("i % 50 = 0").withColumn("part", F.lit(1)).unionByName(c.where("i % 70 = 0").withColumns({"part": F.lit(2), "close": F.col("close") + 1}))
    x = c.withColumn("part", F.lit(0)).unionByName(twice)
    i, p = F.col("i"), F.col("part")
    x = x.withColumns(
        {
            "row_idx": F.when((p == 0) & (i % 40 == 0), i - 3).otherwise(i + p * 100_000),
            "volume": F.when(i % 97 == 0, None).when(i % 89 == 0, -F.col("volume")).otherwise(F.col("volume")),
            "high": F.when(i % 61 == 0, F.col("low") - 1).otherwise(F.col("high")),
            "trades": F.when(i % 83 == 0, -F.col("trades")).otherwise(F.col("trades")),
            "open": F.when(i % 59 == 0, -F.col("open") - 1).when(i % 103 == 0, F.lit(float("inf"))).otherwise(F.col("open")),
        }
    )
    x = x.withColumn("ts", F.when((i % 79 == 0) & (p == 0), None).otherwise(F.col("ts")))
    return x.withColumn("row_idx", F.col("row_idx") * 10 + p).drop("i", "part")


DIRTY = f"""{S.CANDLES}, c0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM candles),
  c1 AS (SELECT *, 0 AS part FROM c0 UNION ALL SELECT *, 1 FROM c0 WHERE i % 50 = 0 UNION ALL SELECT * REPLACE (close + 1 AS close), 2 FROM c0 WHERE i % 70 = 0),
  dirty AS (SELECT symbol, CASE WHEN i % 79 = 0 AND part = 0 THEN NULL ELSE ts END AS ts,
    CASE WHEN i % 59 = 0 THEN -open - 1 WHEN i % 103 = 0 THEN 'inf'::DOUBLE ELSE open END AS open,
    CASE WHEN i % 61 = 0 THEN low - 1 ELSE high END AS high, low, close,
    CASE WHEN i % 97 = 0 THEN NULL WHEN i % 89 = 0 THEN -volume ELSE volume END AS volume, quote_volume,
    CASE WHEN i % 83 = 0 THEN -trades ELSE trades END AS trades,
    (CASE WHEN part = 0 AND i % 40 = 0 THEN i - 3 ELSE i + part * 100000 END) * 10 + part AS row_idx FROM c1)"""
ISSUES = f"""{DIRTY}, t AS (SELECT * FROM dirty WHERE ts IS NOT NULL),
  m AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts, open, high, low, close, volume, quote_volume, trades ORDER BY row_idx) > 1 AS dup_row,
    row_number() OVER (PARTITION BY symbol, ts ORDER BY row_idx) > 1 AS dup_ts, lag(ts) OVER (PARTITION BY symbol ORDER BY row_idx) AS last_ts,
    lag(close) OVER (PARTITION BY symbol ORDER BY ts, row_idx) AS last_close FROM t),
  span AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM t GROUP BY symbol),
  missing AS (SELECT * FROM span ANTI JOIN t USING (symbol, ts)),
  wide AS (SELECT symbol, count(*) FILTER (dup_row) AS "DUPLICATE_ROWS", count(*) FILTER (dup_ts) AS "DUPLICATE_TIMESTAMPS", count(*) FILTER (ts < last_ts) AS "OUT_OF_ORDER_TIMESTAMPS",
    count(*) FILTER (least(open, high, low, close) < 0) AS "NEGATIVE_PRICES", count(*) FILTER (least(volume, quote_volume) < 0) AS "NEGATIVE_VOLUME", count(*) FILTER (trades < 0) AS "NEGATIVE_TRADES",
    count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close) AS "OHLC_INCONSISTENT", count(*) FILTER (abs(close / nullif(last_close, 0) - 1) > 0.5) AS "LARGE_PRICE_JUMPS",
    count(*) FILTER (volume IS NULL) AS "NAN_VALUES", count(*) FILTER (isinf(open)) AS "INFINITE_VALUES" FROM m GROUP BY symbol),
  issues AS (SELECT * FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE symbol) INTO NAME code VALUE n) WHERE n > 0
    UNION ALL SELECT symbol, 'MISSING_HOURLY_CANDLES', count(*) FROM missing GROUP BY symbol
    UNION ALL SELECT symbol, 'BAD_TIMESTAMP_FORMAT', count(*) FROM dirty WHERE ts IS NULL GROUP BY symbol)"""
add("val03_issues", lambda s, d: quality.issues(dirty(s, d)).select("symbol", "code", "n"), f"WITH {ISSUES} SELECT symbol, code, n FROM issues")
REPORTED = f"""{ISSUES}, base AS (SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS "end", round(count(*) * 100.0 / (date_diff('hour', min(ts), max(ts)) + 1), 3) AS coverage_pct FROM t GROUP BY symbol),
  runs AS (SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n FROM (SELECT *, ts - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY symbol ORDER BY ts) AS run FROM missing) GROUP BY symbol, run),
  roll AS (SELECT symbol, CAST(sum(n) AS BIGINT) AS missing_candles, count(*) AS gap_count, max(n) AS largest_gap, first(a ORDER BY n DESC, a) AS ga, first(b ORDER BY n DESC, a) AS gb FROM runs GROUP BY symbol),
  worst AS (SELECT symbol, string_agg(code, ';' ORDER BY code) AS codes, count(*) FILTER (code NOT IN ('MISSING_HOURLY_CANDLES', 'LARGE_PRICE_JUMPS')) AS c, count(*) FILTER (code IN ('MISSING_HOURLY_CANDLES', 'LARGE_PRICE_JUMPS')) AS w,
    max(CASE code WHEN 'DUPLICATE_ROWS' THEN 1 ELSE 0 END) AS f1, max(CASE code WHEN 'DUPLICATE_TIMESTAMPS' THEN 1 ELSE 0 END) AS f2, max(CASE code WHEN 'OUT_OF_ORDER_TIMESTAMPS' THEN 1 ELSE 0 END) AS f3 FROM issues GROUP BY symbol),
  reported AS (SELECT base.symbol, CASE WHEN c > 0 THEN 'FAIL' WHEN w > 0 THEN 'WARN' ELSE 'PASS' END AS status, rows, CAST(floor(epoch(start) / 3600) AS BIGINT) AS start, CAST(floor(epoch("end") / 3600) AS BIGINT) AS "end", coverage_pct,
    coalesce(missing_candles, 0) AS missing_candles, coalesce(gap_count, 0) AS gap_count, largest_gap, CAST(floor(epoch(ga) / 3600) AS BIGINT) AS largest_gap_start, CAST(floor(epoch(gb) / 3600) AS BIGINT) AS largest_gap_end,
    CAST(coalesce(c, 0) AS INT) AS critical_issues, CAST(coalesce(w, 0) AS INT) AS warning_issues, coalesce(codes, '') AS issue_codes,
    concat_ws(';', CASE WHEN f1 = 1 THEN 'dropped duplicate rows' END, CASE WHEN f2 = 1 THEN 'dropped duplicate timestamps' END, CASE WHEN f3 = 1 THEN 'sorted by timestamp' END) AS fixes_applied
    FROM base LEFT JOIN roll USING (symbol) LEFT JOIN worst USING (symbol))"""


def mixed(s, d):
    """The faulty candles of some symbols, and sound ones of others, so that more than one status comes up."""
    clean = hourly(s, d).where("symbol in ('purchase', 'view')").withColumn("row_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    return dirty(s, d).where("symbol not in ('purchase', 'view')").unionByName(clean.select(*quality.CANDLE, F.col("row_idx").cast("bigint").alias("row_idx")))


MIXED = REPORTED.replace("t AS (SELECT * FROM dirty WHERE ts IS NOT NULL)", "clean AS (SELECT symbol, ts, open, high, low, close, volume, quote_volume, trades, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS row_idx FROM candles WHERE symbol IN ('purchase', 'view')), d2 AS (SELECT * FROM dirty WHERE symbol NOT IN ('purchase', 'view') UNION ALL BY NAME SELECT * FROM clean), t AS (SELECT * FROM d2 WHERE ts IS NOT NULL)").replace("FROM dirty WHERE ts IS NULL", "FROM d2 WHERE ts IS NULL")
_bars = ("start", "end", "largest_gap_start", "largest_gap_end")
add("val16_report", lambda s, d: quality.report(mixed(s, d), fixed=True).withColumns({c: bar(c) for c in _bars}), f"WITH {MIXED} SELECT * FROM reported")
add("val18_status_counts", lambda s, d: quality.report(mixed(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n")), f"WITH {MIXED} SELECT status, count(*) AS n FROM reported GROUP BY status")
add("val10_missing_by_column", lambda s, d: quality.missing_by_column(dirty(s, d)), f"WITH {DIRTY}, t AS (SELECT * FROM dirty WHERE ts IS NOT NULL) " + " UNION ALL ".join(f"SELECT symbol, '{c}' AS column, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS infinite FROM t GROUP BY symbol" for c in quality.NUMBERS))
add("val15_largest_jump", lambda s, d: quality.profile(dirty(s, d)).select("symbol", F.round("largest_jump", 6).alias("largest_jump")), f"WITH {ISSUES} SELECT symbol, round(max(abs(close / nullif(last_close, 0) - 1)), 6) AS largest_jump FROM m GROUP BY symbol")

_miss = f"{S.CANDLES}, span AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM candles GROUP BY symbol), missing AS (SELECT * FROM span ANTI JOIN candles USING (symbol, ts))"
_gaps = f"{_miss}, runs AS (SELECT *, ts - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY symbol ORDER BY ts) AS run FROM missing), gaps AS (SELECT symbol, min(ts) AS a, max(ts) AS b, count(*) AS n FROM runs GROUP BY symbol, run)"
_hr = lambda x: f"CAST(floor(epoch({x}) / 3600) AS BIGINT)"
add("val07_missing_hours", lambda s, d: quality.missing_hours(hourly(s, d)).select("symbol", bar().alias("bar")), f"WITH {_miss} SELECT symbol, {S.BAR} FROM missing")
add("val08_gaps", lambda s, d: quality.gaps(hourly(s, d)).select("symbol", F.col("gap_no").cast("bigint").alias("gap_no"), bar("gap_start").alias("gap_start"), bar("gap_end").alias("gap_end"), "missing_hours", bar("previous_ts").alias("previous_ts"), bar("next_ts").alias("next_ts")),
    f"WITH {_gaps} SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY a) AS gap_no, {_hr('a')} AS gap_start, {_hr('b')} AS gap_end, n AS missing_hours, {_hr('a')} - 1 AS previous_ts, {_hr('b')} + 1 AS next_ts FROM gaps")
add("val09_gap_rollup", lambda s, d: quality.gap_rollup(hourly(s, d)).withColumn("largest_start", bar("largest_start")),
    f"WITH {_gaps} SELECT symbol, CAST(sum(n) AS BIGINT) AS missing_candles, count(*) AS gap_count, max(n) AS largest_gap, {_hr('first(a ORDER BY n DESC, a)')} AS largest_start FROM gaps GROUP BY symbol")
_num = ["open", "high", "low", "close", "volume", "quote_volume"]
add("val17_repair", lambda s, d: show(quality.repair(dirty(s, d)), _num, ["trades"]), final(f"{DIRTY}, f AS (SELECT * FROM dirty WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_idx) = 1)", _num, ["trades"]))
add("ing03_accepted", lambda s, d: show(quality.accepted(quality.repair(dirty(s, d))), _num, ["trades"]),
    final(f"{DIRTY}, g AS (SELECT * FROM dirty WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_idx) = 1), f AS (SELECT * FROM g WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND quote_volume >= 0 AND trades >= 0 AND NOT isinf(open) AND high >= low AND high >= open AND high >= close AND low <= open AND low <= close)", _num, ["trades"]))


def flats(s, d):
    """Candles in which every 30th bar repeats the close before it without trades."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = hourly(s, d).withColumns({"_i": F.row_number().over(w), "_p": F.lag("close").over(w)})
    on = (F.col("_i") % 30 == 0) & F.col("_p").isNotNull()
    c = c.withColumns({x: F.when(on, F.col("_p")).otherwise(F.col(x)) for x in quality.PRICES} | {x: F.when(on, F.lit(0)).otherwise(F.col(x)) for x in ("volume", "quote_volume", "trades")})
    return c.drop("_i", "_p")


_fl = f"{S.CANDLES}, p AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS p FROM candles {W()}), e AS (SELECT symbol, ts, CASE WHEN i % 30 = 0 AND p IS NOT NULL THEN p ELSE close END AS close, coalesce(i % 30 = 0 AND p IS NOT NULL, false) AS flat, open, high, low, volume, quote_volume, trades FROM p), f AS (SELECT symbol, ts, close FROM (SELECT *, lag(close) OVER ({S.OVER}) AS q FROM e) WHERE (flat OR (volume = 0 AND quote_volume = 0 AND trades = 0 AND open = q AND high = q AND low = q)) AND close = q)"
add("ing02_suspicious", lambda s, d: show(quality.suspicious(flats(s, d)), ["close"]), final(_fl, ["close"]))
add("ing06_internal_gaps", lambda s, d: quality.internal_gaps(hourly(s, d)).select("symbol", bar("fetch_start").alias("fetch_start"), bar("fetch_end").alias("fetch_end")),
    f"WITH {S.CANDLES} SELECT symbol, {_hr('ts')} + 1 AS fetch_start, {_hr('nxt')} - 1 AS fetch_end FROM (SELECT *, lead(ts) OVER ({S.OVER}) AS nxt FROM candles) WHERE nxt > ts + INTERVAL 1 HOUR")
add("cln05_keep_last", lambda s, d: show(quality.keep_last(dirty(s, d).where("ts is not null")), ["close"]), final(f"{DIRTY}, f AS (SELECT * FROM dirty WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_idx DESC) = 1)", ["close"]))
add("cln04_warm_up", lambda s, d: show(quality.warmed_up(compute(hourly(s, d), ["trend", "momentum", "volatility"])), ["SMA_50"]), final(f"{S.CANDLES}, f AS (SELECT * FROM (SELECT symbol, ts, {r('avg', 'close', 50)} AS \"SMA_50\" FROM candles {W(50)}) WHERE \"SMA_50\" IS NOT NULL)", ["SMA_50"]))
add("cln03_finite", lambda s, d: quality.finite(dirty(s, d), _num).select("symbol", "row_idx", *(F.round(c, 6).alias(c) for c in _num)), f"WITH {DIRTY} SELECT symbol, row_idx, {', '.join(f'round(CASE WHEN NOT isinf({c}) THEN {c} END, 6) AS {c}' for c in _num)} FROM dirty")
add("cln03_infinite_cells", lambda s, d: quality.infinite_cells(dirty(s, d).where("ts is not null"), _num).select("symbol", bar().alias("bar"), "column", F.signum("value").cast("int").alias("sign")),
    f"WITH {DIRTY} " + " UNION ALL ".join(f"SELECT symbol, {S.BAR}, '{c}' AS column, CAST(sign({c}) AS INT) AS sign FROM dirty WHERE ts IS NOT NULL AND isinf({c})" for c in _num))


def short_symbols(s, d):
    """Candles of which two symbols have 40 bars only, and the symbols that a feature run makes no rows of."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    c = hourly(s, d).withColumn("_n", n).where("symbol not in ('purchase', 'view') or _n <= 40").drop("_n")
    return failures(c, quality.warmed_up(compute(c, ["trend", "momentum", "volatility"])))


add("orc01_feature_failures", lambda s, d: short_symbols(s, d).select("symbol", "n_rows"), f"WITH {S.CANDLES} SELECT symbol, least(count(*), 40) AS n_rows FROM candles WHERE symbol IN ('purchase', 'view') GROUP BY symbol")
add("win27_lookback", lambda s, d: show(quality.lookback(hourly(s, d), 100), ["close"]), final(f"{S.CANDLES}, f AS (SELECT * FROM candles QUALIFY ts >= max(ts) OVER (PARTITION BY symbol) - INTERVAL 100 HOUR)", ["close"]))
add("src19_last_times", lambda s, d: last_times(hourly(s, d)).select("symbol", bar("first_ts").alias("first_bar"), bar("last_ts").alias("last_bar")), f"WITH {S.CANDLES} SELECT symbol, min({_hr('ts')}) AS first_bar, max({_hr('ts')}) AS last_bar FROM candles GROUP BY symbol")
add("snk04_merge", lambda s, d: show(quality.merge_tables(hourly(s, d), hourly(s, d).withColumn("close", F.col("close") + 1).withColumn("ts", F.expr("ts + interval 1 hour"))), ["close"]),
    final(f"{S.CANDLES}, n AS (SELECT symbol, ts, close, 0 AS p FROM candles UNION ALL SELECT symbol, ts + INTERVAL 1 HOUR, close + 1, 1 FROM candles), f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY p) = 1)", ["close"]))
add("val14_summary", lambda s, d: quality.summary(dirty(s, d)).select("symbol", "row_count", bar("start_ts").alias("start_bar"), bar("end_ts").alias("end_bar"), "coverage"),
    f"WITH {DIRTY} SELECT symbol, count(*) AS row_count, min({_hr('ts')}) AS start_bar, max({_hr('ts')}) AS end_bar, round(count(*) * 100.0 / (max({_hr('ts')}) - min({_hr('ts')}) + 1), 3) AS coverage FROM dirty WHERE ts IS NOT NULL GROUP BY symbol")
add("ing07_replaced_rows", lambda s, d: show(quality.replace_rows(hourly(s, d), hourly(s, d).where("hour(ts) % 5 = 0").withColumn("close", F.col("close") + 1)), ["close"]),
    final(f"{S.CANDLES}, f AS (SELECT * REPLACE (CASE WHEN hour(ts) % 5 = 0 THEN close + 1 ELSE close END AS close) FROM candles)", ["close"]))
add("snk05_tail_dropped", lambda s, d: show(sinks.drop_tail(hourly(s, d)), ["close"]), final(f"{S.CANDLES}, f AS (SELECT * FROM candles QUALIFY ts < max(ts) OVER (PARTITION BY symbol))", ["close"]))
add("snk07_summary", lambda s, d: sinks.feature_summary(hourly(s, d)).select("symbol", "n_rows", bar("first_ts").alias("first_bar"), bar("last_ts").alias("last_bar"), F.col("n_columns").cast("bigint").alias("n_columns")),
    f"WITH {S.CANDLES} SELECT symbol, count(*) AS n_rows, min({_hr('ts')}) AS first_bar, max({_hr('ts')}) AS last_bar, CAST(9 AS BIGINT) AS n_columns FROM candles GROUP BY symbol")
add("agg03_daily", lambda s, d: show(daily(s, d), _num, ["trades"], 4), final(S.DAILY, _num, ["trades"], source="candles", digits=4))


def klines(s, d):
    """Klines from candles; every 37th low does not parse, every 41st row comes twice."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = hourly(s, d).withColumn("row_idx", F.row_number().over(w))
    k = c.select("symbol", F.unix_millis(F.col("ts").cast("timestamp")).alias("open_time"), *(F.col(x).cast("string").alias(x) for x in ("open", "high", "close", "volume", "quote_volume")), F.when(F.col("row_idx") % 37 == 0, "?").otherwise(F.col("low").cast("string")).alias("low"), F.col("trades").cast("int").alias("trades"), "row_idx")
    return k.unionByName(k.where("row_idx % 41 = 0").withColumns({"row_idx": F.col("row_idx") + 100_000, "close": F.lit("0")}))


add("src10_klines", lambda s, d: show(parse_klines(klines(s, d)), ["open", "high", "low", "close", "volume"], ["trades"]), final(f"{S.CANDLES}, f AS (SELECT * REPLACE (CASE WHEN row_number() OVER ({S.OVER}) % 37 = 0 THEN NULL ELSE low END AS low) FROM candles)", ["open", "high", "low", "close", "volume"], ["trades"]))

add("ing05_rejected", lambda s, d: quality.rejected(quality.repair(dirty(s, d))).select("symbol", bar().alias("bar"), "reason"),
    f"""WITH {DIRTY}, g AS (SELECT * FROM dirty WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY row_idx) = 1),
    r AS (SELECT *, coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND quote_volume >= 0 AND trades >= 0 AND NOT isinf(open), false) AS valid FROM g)
    SELECT symbol, {S.BAR}, CASE WHEN NOT valid THEN 'INVALID_NUMBER' ELSE 'OHLC_INCONSISTENT' END AS reason FROM r WHERE NOT valid OR high < low OR high < open OR high < close OR low > open OR low > close""")  # fmt: skip


def ingestion(s, d):
    """Candles that lack every seventh bar, with the whole table as the source that gaps are filled from."""
    w = Window.partitionBy("symbol").orderBy("ts")
    source = hourly(s, d).select(*quality.CANDLE)
    have = source.withColumn("_i", F.row_number().over(w)).where("_i % 7 <> 3").drop("_i")

    def fetch(ranges: DataFrame) -> DataFrame:
        r = ranges.select(F.col("symbol").alias("_s"), F.explode(F.sequence("fetch_start", "fetch_end", F.expr("interval 1 hour"))).alias("_t"))
        return source.join(r, (F.col("symbol") == F.col("_s")) & (F.col("ts") == F.col("_t"))).drop("_s", "_t")

    return quality.ingested(have, fetch)


_ing = f"""{S.CANDLES}, n AS (SELECT *, row_number() OVER ({S.OVER}) AS i FROM candles), have AS (SELECT * FROM n WHERE i % 7 <> 3), span AS (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM have GROUP BY symbol),
  whole AS (SELECT n.*, i % 7 = 3 AS filled FROM n JOIN span USING (symbol) WHERE ts BETWEEN lo AND hi), g AS (SELECT *, open > 0 AND low > 0 AND high > 0 AND close > 0 AS fine FROM whole)"""
add("ing07_ingested", lambda s, d: show(ingestion(s, d)[0], _num, ["trades"]), final(f"{_ing}, f AS (SELECT * FROM g WHERE fine)", _num, ["trades"]))
add("agg07_run_totals", lambda s, d: sinks.run_totals(ingestion(s, d)[2].withColumn("status", F.when(F.col("candles") > 600, "OK").otherwise("FAILED"))),
    f"""WITH {_ing}, t AS (SELECT symbol, count(*) FILTER (fine) AS candles, count(*) FILTER (filled) AS gaps_filled, count(*) FILTER (NOT fine) AS rejected FROM g GROUP BY symbol)
    SELECT count(*) AS coins, count(*) FILTER (candles > 600) AS ok, 0::BIGINT AS skipped, count(*) FILTER (candles <= 600) AS failed, CAST(sum(candles) AS BIGINT) AS candles, CAST(sum(gaps_filled) AS BIGINT) AS gaps_filled, 0::BIGINT AS corrected, CAST(sum(rejected) AS BIGINT) AS rejected FROM t""")  # fmt: skip

# ---- targets, folds, reduction, scaling, scores -------------------------------------------------------------------

_t = {f"log_return_{h}d": f"ln(CASE WHEN lead(close, {h}) OVER w > 0 AND close > 0 THEN lead(close, {h}) OVER w / close END)" for h in prepare.HORIZONS}
feature("win24_targets", lambda c: prepare.targets(c, steps_per_day=1, check=False), list(_t), [], simple(_t, source=S.DAILY), daily)
_ok = ["log_return_7d", "log_return_30d"]
add("ml02_valid_rows", lambda s, d: show(prepare.valid_rows(prepare.targets(daily(s, d), steps_per_day=1, check=False), _ok[:1], _ok[1]), _ok),
    final(f"{S.DAILY}, f AS (SELECT * FROM (SELECT symbol, ts, {', '.join(f'{x} AS {k}' for k, x in _t.items() if k in _ok)} FROM candles {W()}) WHERE {' AND '.join(f'{k} IS NOT NULL' for k in _ok)})", _ok))
add("seq05_folds", lambda s, d: prepare.fold_table(daily(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))).select("symbol", F.col("fold").cast("bigint").alias("fold"), "train_end", "val_start", "val_end"),
    f"WITH {S.DAILY}, z AS (SELECT symbol, count(*) AS n, CAST(floor(count(*) * 0.6) AS BIGINT) AS t, CAST(floor(count(*) * 0.1) AS BIGINT) AS v FROM candles GROUP BY symbol), g AS (SELECT symbol, t, v, unnest(range(0, 20)) AS k, n FROM z) SELECT symbol, k AS fold, t + k * v AS train_end, t + k * v AS val_start, t + k * v + v AS val_end FROM g WHERE t + k * v + v <= n")
add("jn11_folded_rows", lambda s, d: prepare.folded(daily(s, d), prepare.fold_table(daily(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))).groupBy("symbol", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 2).alias("total")).withColumn("fold", F.col("fold").cast("bigint")),
    f"WITH {S.DAILY}, c AS (SELECT *, row_number() OVER ({S.OVER}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM candles), k AS (SELECT unnest(range(0, 20)) AS fold), g AS (SELECT c.*, fold, CAST(floor(n * 0.6) AS BIGINT) + fold * CAST(floor(n * 0.1) AS BIGINT) AS t, CAST(floor(n * 0.1) AS BIGINT) AS v FROM c, k) SELECT symbol, fold, CASE WHEN i < t THEN 'train' ELSE 'val' END AS part, count(*) AS n, round(sum(close), 2) AS total FROM g WHERE t + v <= n AND i < t + v GROUP BY ALL")
_f = ["open", "high", "low", "close", "volume", "quote_volume"]
_un = " UNION ALL ".join
add("agg08_variance", lambda s, d: prepare.variances(hourly(s, d), _f).select("feature", F.round("variance", 4).alias("variance")), f"WITH {S.CANDLES} " + _un(f"SELECT '{c}' AS feature, round(coalesce(var_samp({c}), 0), 4) AS variance FROM candles" for c in _f))
add("agg09_correlation", lambda s, d: prepare.correlations(hourly(s, d), _f).select("f1", "f2", F.round("r", 6).alias("r")), f"WITH {S.CANDLES} " + _un(f"SELECT '{a}' AS f1, '{b}' AS f2, round(coalesce(abs(corr({a}, {b})), 0), 6) AS r FROM candles" for i, a in enumerate(_f) for b in _f[i + 1 :]))


def reduced(s, d):
    c = hourly(s, d).withColumns({"constant": F.lit(1.0), "close_2": F.col("close") * 2})
    m = prepare.FeatureReducer(least_variance=1e-6, most_correlation=0.95).fit(c, ["constant", "close", "close_2", "volume"])
    return s.createDataFrame([(x, "kept") for x in m.kept] + [(x, "low_variance") for x in m.low_variance] + [(x, "correlated") for x in m.correlated], "feature string, verdict string")


add("ml05_reduction", reduced, f"""WITH {S.CANDLES}, x AS (SELECT 1.0 AS constant, close, close * 2 AS close_2, volume FROM candles),
  v AS (SELECT * FROM (SELECT 'constant' AS feature, 0 AS i, coalesce(var_samp(constant), 0) AS v FROM x UNION ALL SELECT 'close', 1, var_samp(close) FROM x UNION ALL SELECT 'close_2', 2, var_samp(close_2) FROM x UNION ALL SELECT 'volume', 3, var_samp(volume) FROM x)),
  r AS (SELECT 'close' AS a, 'close_2' AS b, abs(corr(close, close_2)) AS r FROM x UNION ALL SELECT 'close', 'volume', abs(corr(close, volume)) FROM x UNION ALL SELECT 'close_2', 'volume', abs(corr(close_2, volume)) FROM x),
  rr AS (SELECT a, b, r FROM r UNION ALL SELECT b, a, r FROM r), mean AS (SELECT a, round((1 + sum(r)) / 3, 9) AS m FROM rr GROUP BY a),
  first AS (SELECT r.*, CASE WHEN ma.m >= mb.m THEN r.a ELSE r.b END AS loser FROM r JOIN mean ma ON ma.a = r.a JOIN mean mb ON mb.a = r.b WHERE r > 0.95 ORDER BY r.a, r.b LIMIT 1)
SELECT feature, CASE WHEN v <= 1e-6 THEN 'low_variance' WHEN feature IN (SELECT loser FROM first) THEN 'correlated' ELSE 'kept' END AS verdict FROM v""")  # fmt: skip
add("ml07_robust_scaler", lambda s, d: show(prepare.RobustScaler().fit(hourly(s, d), ["close", "volume"]).transform(hourly(s, d)), ["close", "volume"]),
    final(f"{S.CANDLES}, q AS (SELECT quantile_cont(close, 0.5) AS m1, quantile_cont(close, 0.75) - quantile_cont(close, 0.25) AS r1, quantile_cont(volume, 0.5) AS m2, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS r2 FROM candles), f AS (SELECT symbol, ts, (close - m1) / CASE WHEN r1 = 0 THEN 1 ELSE r1 END AS close, (volume - m2) / CASE WHEN r2 = 0 THEN 1 ELSE r2 END AS volume FROM candles, q)", ["close", "volume"]))


def predicted(s, d):
    """The quantile baseline: learnt on the first 60 percent of each symbol's days, judged on the rest."""
    w = Window.partitionBy("symbol")
    t = prepare.targets(daily(s, d), (1,), 1, check=False).withColumns({"i": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(w)})
    t = t.where("log_return_1d is not null").withColumn("train", F.col("i") < F.floor(F.col("n") * 0.6))
    q = evaluate.naive_quantiles(t.where("train"), "log_return_1d", ["symbol"])
    return t.where("not train").withColumnRenamed("log_return_1d", "y").join(q, "symbol")


PREDICTED = f"""{S.DAILY}, t0 AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, ln(CASE WHEN lead(close) OVER w > 0 AND close > 0 THEN lead(close) OVER w / close END) AS y FROM candles {W()}),
  t1 AS (SELECT *, i < floor(n * 0.6) AS train FROM t0 WHERE y IS NOT NULL),
  q AS (SELECT symbol, quantile_cont(y, 0.05) AS lower, quantile_cont(y, 0.5) AS point, quantile_cont(y, 0.95) AS upper FROM t1 WHERE train GROUP BY symbol),
  pred AS (SELECT t1.symbol, t1.ts, y, lower, point, upper, close AS ref_price FROM t1 JOIN q USING (symbol) WHERE NOT train)"""
_mc = ["rmse", "mae", "median_ae", "mape", "picp", "mpiw", "direction_accuracy", "direction_precision", "direction_recall", "direction_f1"]
METRICS = """m0 AS (SELECT symbol, sqrt(avg((point - y) ** 2)) AS rmse, avg(abs(point - y)) AS mae, quantile_cont(abs(point - y), 0.5) AS median_ae, avg(abs((point - y) / nullif(y, 0))) AS mape,
    avg(CAST(y BETWEEN lower AND upper AS DOUBLE)) AS picp, avg(upper - lower) AS mpiw, avg(CAST(sign(y) = sign(point) AS DOUBLE)) AS direction_accuracy,
    coalesce(count(*) FILTER (y > 0 AND point > 0) / nullif(count(*) FILTER (point > 0), 0), 0.0) AS direction_precision, coalesce(count(*) FILTER (y > 0 AND point > 0) / nullif(count(*) FILTER (y > 0), 0), 0.0) AS direction_recall FROM pred GROUP BY symbol),
  m AS (SELECT *, coalesce(2 * direction_precision * direction_recall / nullif(direction_precision + direction_recall, 0), 0.0) AS direction_f1 FROM m0)"""
add("evl01_metrics", lambda s, d: evaluate.metrics(predicted(s, d), ["symbol"]).select("symbol", *(F.round(c, 6).alias(c) for c in _mc)), f"WITH {PREDICTED}, {METRICS} SELECT symbol, {', '.join(f'round({c}, 6) AS {c}' for c in _mc)} FROM m")
add("scl14_price_interval", lambda s, d: show(evaluate.price_interval(predicted(s, d)), ["lower_price", "median_price", "upper_price"], digits=4), final(f"{PREDICTED}, f AS (SELECT symbol, ts, ref_price * exp(lower) AS lower_price, ref_price * exp(point) AS median_price, ref_price * exp(upper) AS upper_price FROM pred)", ["lower_price", "median_price", "upper_price"], digits=4))


def scored(s, d):
    """The symbols' baselines as models of one coin."""
    m = evaluate.metrics(predicted(s, d), ["symbol"]).withColumns({"coin": F.lit("all"), "model": F.col("symbol"), "training_time_seconds": F.ascii("symbol").cast("double")})
    return evaluate.ranked(evaluate.composite_score(m, ["coin"]), ["coin"]).select("coin", "model", F.round("score", 6).alias("score"), F.col("place").cast("bigint").alias("place"), "is_winner")


_lo = lambda c: f"coalesce(1 - ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 1.0)"
_up = lambda c: f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 1.0)"
add("evl05_selection", scored, f"WITH {PREDICTED}, {METRICS}, x AS (SELECT *, abs(picp - 0.9) AS miss, CAST(ascii(symbol) AS DOUBLE) AS secs FROM m), y AS (SELECT symbol, 0.4 * ({_lo('rmse')} + {_lo('mae')}) / 2 + 0.35 * ({_lo('miss')} + {_lo('mpiw')}) / 2 + 0.2 * {_up('direction_accuracy')} + 0.05 * {_lo('secs')} AS score FROM x) SELECT 'all' AS coin, symbol AS model, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, symbol) AS place, row_number() OVER (ORDER BY score DESC, symbol) = 1 AS is_winner FROM y")



def averaged(s, d):
    """The baseline's metrics by year, averaged as over folds."""
    m = evaluate.metrics(predicted(s, d).withColumn("fold", F.year("ts")), ["symbol", "fold"])
    m = m.withColumns({"training_time_seconds": F.col("fold") * 0.5, "model_size_bytes": F.col("fold").cast("bigint") * 10})
    return evaluate.average_folds(m, ["symbol"], "fold")


_av = [c for c in _mc if c != "mape"]
AVERAGED = f"""{METRICS.replace("SELECT symbol,", "SELECT symbol, year(ts) AS fold,").replace("GROUP BY symbol", "GROUP BY symbol, fold")},
  av AS (SELECT symbol, {", ".join(f"avg({c}) AS {c}" for c in _av)}, sum(fold * 0.5) AS training_time_seconds, CAST(max(fold) * 10 AS BIGINT) AS model_size_bytes FROM m GROUP BY symbol)"""
add("agg12_fold_average", lambda s, d: averaged(s, d).select("symbol", *(F.round(c, 6).alias(c) for c in _av), "training_time_seconds", "model_size_bytes"),
    f"WITH {PREDICTED}, {AVERAGED} SELECT symbol, {', '.join(f'round({c}, 6) AS {c}' for c in _av)}, CAST(training_time_seconds AS DOUBLE) AS training_time_seconds, model_size_bytes FROM av")
add("sel01_winner", lambda s, d: evaluate.ranked(evaluate.composite_score(averaged(s, d).withColumns({"coin": F.lit("all"), "model": F.col("symbol")}), ["coin"]), ["coin"]).where("is_winner").select("coin", "model", F.round("score", 6).alias("score")),
    f"WITH {PREDICTED}, {AVERAGED}, x AS (SELECT *, abs(picp - 0.9) AS miss FROM av), y AS (SELECT symbol, 0.4 * ({_lo('rmse')} + {_lo('mae')}) / 2 + 0.35 * ({_lo('miss')} + {_lo('mpiw')}) / 2 + 0.2 * {_up('direction_accuracy')} + 0.05 * {_lo('training_time_seconds')} AS score FROM x) SELECT 'all' AS coin, symbol AS model, round(score, 6) AS score FROM y ORDER BY score DESC, symbol LIMIT 1")



def by_horizon(s, d):
    """The baseline's metrics one and two days ahead, averaged over both."""
    out = None
    for h in (1, 2):
        w = Window.partitionBy("symbol")
        t = prepare.targets(daily(s, d), (h,), 1, check=False).withColumns({"i": F.row_number().over(w.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(w)}).withColumnRenamed(f"log_return_{h}d", "y")
        t = t.where("y is not null").withColumn("train", F.col("i") < F.floor(F.col("n") * 0.6))
        q = evaluate.naive_quantiles(t.where("train"), "y", ["symbol"])
        m = evaluate.metrics(t.where("not train").join(q, "symbol"), ["symbol"]).withColumns({"horizon": F.lit(h), "training_time_seconds": F.lit(0.5 * h), "model_size_bytes": F.lit(10 * h).cast("bigint")})
        out = m if out is None else out.unionByName(m)
    return evaluate.average_folds(out, ["symbol"], "horizon")


def _horizon(h: int) -> str:
    body = f"{PREDICTED}, {METRICS}".replace("lead(close) OVER w", f"lead(close, {h}) OVER w")
    return f"(WITH {body} SELECT *, {h} AS horizon FROM m)"


add("agg13_horizon_average", lambda s, d: by_horizon(s, d).select("symbol", *(F.round(c, 6).alias(c) for c in _av), "training_time_seconds", "model_size_bytes"),
    f"SELECT symbol, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _av)}, CAST(sum(0.5 * horizon) AS DOUBLE) AS training_time_seconds, CAST(max(horizon) * 10 AS BIGINT) AS model_size_bytes FROM (SELECT * FROM {_horizon(1)} UNION ALL SELECT * FROM {_horizon(2)}) GROUP BY symbol")


def baseline_run(s, d):
    """Every symbol's baseline one day ahead: folds, averages and the refitted model."""
    c = ExperimentConfig(target=TargetConfig(horizons=[1], steps_per_day=1))
    f = daily(s, d).select("symbol", "ts", "close", "volume")
    pairs = f.select("symbol").distinct().withColumn("model", F.lit("NaiveQuantiles"))
    return f, experiment.trained(f, pairs, c, "exp_001")


RUN = f"""{S.DAILY}, y0 AS (SELECT *, ln(CASE WHEN lead(close) OVER w > 0 AND close > 0 THEN lead(close) OVER w / close END) AS y FROM candles {W()}),
  v AS (SELECT symbol, ts, y, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM y0 WHERE y IS NOT NULL AND volume IS NOT NULL),
  z AS (SELECT symbol, max(n) AS n, CAST(floor(max(n) * 0.6) AS BIGINT) AS t, CAST(floor(max(n) * 0.1) AS BIGINT) AS s FROM v GROUP BY symbol),
  k AS (SELECT symbol, t + j * s AS te, t + j * s + s AS ve FROM (SELECT *, unnest(range(0, 20)) AS j FROM z) WHERE t + j * s + s <= n),
  q AS (SELECT symbol, te, ve, quantile_cont(y, 0.05) AS lower, quantile_cont(y, 0.5) AS point, quantile_cont(y, 0.95) AS upper FROM v JOIN k USING (symbol) WHERE i < te GROUP BY ALL),
  m AS (SELECT symbol, te, sqrt(avg((point - y) ** 2)) AS rmse, avg(abs(point - y)) AS mae, quantile_cont(abs(point - y), 0.5) AS median_ae, avg(CAST(y BETWEEN lower AND upper AS DOUBLE)) AS picp, avg(upper - lower) AS mpiw, avg(CAST(sign(y) = sign(point) AS DOUBLE)) AS dir_accuracy FROM v JOIN q USING (symbol) WHERE i >= te AND i < ve GROUP BY ALL)"""
_rc = ["rmse", "mae", "median_ae", "picp", "mpiw", "dir_accuracy"]
add("ml09_run", lambda s, d: baseline_run(s, d)[1].select("symbol", "model", "horizon", "status", "n_rows", "n_folds", *(F.round(c, 6).alias(c) for c in _rc)),
    f"WITH {RUN} SELECT m.symbol, 'NaiveQuantiles' AS model, 1 AS horizon, 'ok' AS status, any_value(z.n) AS n_rows, CAST(count(*) AS INT) AS n_folds, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _rc)} FROM m JOIN z USING (symbol) GROUP BY m.symbol")


def next_prices(s, d):
    f, found = baseline_run(s, d)
    best, _ = experiment.production(found, experiment.selected(found))
    return experiment.predicted(best, f, 1)


add("ml12_predictor", lambda s, d: next_prices(s, d).select("symbol", "model", *(F.round(c, 4).alias(c) for c in ("ref_price", "lower_price", "median_price", "upper_price"))),
    f"""WITH {RUN}, l AS (SELECT symbol, last(close ORDER BY ts) AS p FROM candles WHERE volume IS NOT NULL GROUP BY symbol), a AS (SELECT symbol, quantile_cont(y, 0.05) AS lo, quantile_cont(y, 0.5) AS mid, quantile_cont(y, 0.95) AS hi FROM v GROUP BY symbol)
    SELECT symbol, 'NaiveQuantiles' AS model, round(p, 4) AS ref_price, round(p * exp(lo), 4) AS lower_price, round(p * exp(mid), 4) AS median_price, round(p * exp(hi), 4) AS upper_price FROM l JOIN a USING (symbol)""")  # fmt: skip


def autoregression(s, d):
    """The next forecast of a second-order autoregression on each symbol's daily log returns."""
    r = prepare.targets(daily(s, d), (1,), 1, check=False).where("log_return_1d is not null").select("symbol", "ts", F.col("log_return_1d").alias("y"))

    def work(pdf):
        y = pdf.sort_values("ts")["y"].to_numpy(float)
        lo, point, hi = local.make("ARIMA").fit(y[:, None], y).predict(y[:1, None])
        return pdf.iloc[:1][["symbol"]].assign(point=point[0], width=hi[0] - lo[0])

    return r.groupBy("symbol").applyInPandas(work, "symbol string, point double, width double")


add("ml11_autoregression", lambda s, d: autoregression(s, d).select("symbol", F.round("point", 6).alias("point"), F.round("width", 6).alias("width")),
    f"""WITH {S.DAILY}, y0 AS (SELECT symbol, ts, ln(lead(close) OVER w / close) AS y FROM candles {W()}), r AS (SELECT symbol, ts, y, lag(y) OVER w AS a, lag(y, 2) OVER w AS b FROM y0 WHERE y IS NOT NULL {W()}),
    o AS (SELECT *, y - avg(y) OVER p AS dy, a - avg(a) OVER p AS da, b - avg(b) OVER p AS db FROM r WHERE b IS NOT NULL WINDOW p AS (PARTITION BY symbol)),
    g AS (SELECT symbol, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, sum(da * da) AS saa, sum(db * db) AS sbb, sum(da * db) AS sab, sum(da * dy) AS say, sum(db * dy) AS sby, sum(dy * dy) AS syy, last(y ORDER BY ts) AS y1, last(a ORDER BY ts) AS y2 FROM o GROUP BY symbol),
    c AS (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS b1, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS b2 FROM g)
    SELECT symbol, round(my + b1 * (y1 - ma) + b2 * (y2 - mb), 6) AS point, round(2 * 1.6448536269514722 * sqrt((syy - b1 * say - b2 * sby) / (n - 3)), 6) AS width FROM c""")  # fmt: skip

# ---- mapping ----------------------------------------------------------------------------------------------------

PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
STABLE = ["10", "20", "30"]


def ranking(s, d):
    c = table(s, d, "customer")
    return c.select(F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"), F.col("c_custkey").cast("string").alias("symbol"))


def markets(s, d):
    o = table(s, d, "orders")
    return o.select(F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_custkey").cast("string").alias("base"), F.col("o_orderpriority").alias("quote"), F.when(F.col("o_orderstatus") == "O", "TRADING").otherwise("BREAK").alias("status"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") * 10).alias("quote_volume"))


def mapped(s, d):
    m = markets(s, d)
    return mapping.map_coins(ranking(s, d), m, m.select("symbol", "quote_volume"), PRIORITY, STABLE)


MAPPED = """rk AS (SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, CAST(c_custkey AS VARCHAR) AS symbol FROM customer),
  mk AS (SELECT concat('M', o_orderkey) AS market, CAST(o_custkey AS VARCHAR) AS base, o_orderpriority AS quote, o_orderkey AS idx, o_totalprice * 10 AS volume,
    CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS pl FROM orders WHERE o_orderstatus = 'O'),
  best AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY base ORDER BY pl NULLS LAST, idx) = 1),
  av AS (SELECT base, string_agg(market, ';' ORDER BY market) AS available_markets FROM mk GROUP BY base),
  j AS (SELECT rk.rank, rk.symbol, best.*, available_markets, rk.symbol IN ('10', '20', '30') AS skip FROM rk LEFT JOIN best ON best.base = rk.symbol LEFT JOIN av ON av.base = rk.symbol),
  sc AS (SELECT *, 50 + CASE WHEN pl = 1 THEN 20 ELSE 0 END + 10 + CASE WHEN volume > 1000000 THEN 10 WHEN volume > 100000 THEN 5 ELSE 0 END + coalesce(11 - pl, 0) AS s0 FROM j),
  mapped AS (SELECT CAST(rank AS INT) AS rank, symbol, CASE WHEN skip THEN 'STABLECOIN_SKIP' WHEN market IS NULL THEN 'NOT_LISTED' WHEN pl = 1 THEN 'READY' ELSE 'NON_1-URGENT_PAIR' END AS status,
    CASE WHEN NOT skip AND market IS NOT NULL THEN CAST(s0 AS INT) END AS score,
    CASE WHEN NOT skip AND market IS NOT NULL THEN CASE WHEN s0 >= 90 THEN 'HIGH' WHEN s0 >= 75 THEN 'MEDIUM' ELSE 'LOW' END END AS level,
    CASE WHEN skip THEN 'Stablecoin' WHEN market IS NULL THEN 'No Spot Market' ELSE concat_ws(',', 'SYMBOL', CASE WHEN pl = 1 THEN '1-URGENT' END, 'TRADING', CASE WHEN volume > 1000000 THEN 'HIGH_VOLUME' WHEN volume > 100000 THEN 'GOOD_VOLUME' END) END AS reason,
    CASE WHEN NOT skip THEN market END AS market, CASE WHEN NOT skip THEN quote END AS quote, CASE WHEN NOT skip THEN available_markets END AS available_markets FROM sc)"""
add("scl12_mapping", mapped, f"WITH {MAPPED} SELECT * FROM mapped")
add("srt04_best_market", lambda s, d: mapping.best_markets(markets(s, d), PRIORITY).select("base", "symbol", "quote"), f"WITH {MAPPED} SELECT base, market AS symbol, quote FROM best")
add("agg16_available_markets", lambda s, d: mapping.available(markets(s, d)), f"WITH {MAPPED} SELECT base, available_markets FROM av")
add("agg01_status_counts", lambda s, d: mapping.status_counts(mapped(s, d)), f"WITH {MAPPED} SELECT status, count(*) AS n FROM mapped GROUP BY status")
add("srt03_top_coins", lambda s, d: mapping.select_top(mapped(s, d), 50, ranking(s, d).where("rank % 2 = 0")).select("rank", "symbol", F.col("selection_order").cast("bigint").alias("selection_order"), "available"),
    f"WITH {MAPPED} SELECT rank, symbol, row_number() OVER (ORDER BY rank) AS selection_order, rank % 2 = 0 AS available FROM mapped WHERE status = 'READY' ORDER BY rank LIMIT 50")
add("jn05_snapshot", lambda s, d: mapping.snapshot(mapped(s, d), mapping.select_top(mapped(s, d), 50)).select("rank", "symbol", "status", "selected"),
    f"WITH {MAPPED} SELECT rank, symbol, status, symbol IN (SELECT symbol FROM mapped WHERE status = 'READY' ORDER BY rank LIMIT 50) AS selected FROM mapped")
add("snk15_first_candle", lambda s, d: mapping.set_first_candle(mapped(s, d).withColumn("first_candle", F.lit(0).cast("bigint")), markets(s, d).where("idx % 2 = 0").select(F.col("symbol").alias("market"), F.col("idx").alias("first_candle"))).select("rank", "market", "first_candle"),
    f"WITH {MAPPED} SELECT rank, market, CASE WHEN CAST(substr(market, 2) AS BIGINT) % 2 = 0 THEN CAST(substr(market, 2) AS BIGINT) ELSE 0 END AS first_candle FROM mapped")

add("snk02_review", lambda s, d: mapping.status_counts(mapping.split_review(mapped(s, d))[1]), f"WITH {MAPPED} SELECT status, count(*) AS n FROM mapped WHERE status IN ('NOT_LISTED', 'STABLECOIN_SKIP') GROUP BY status")
add("prj02_pick", lambda s, d: mapping.pick(mapping.ready_coins(mapped(s, d)), limit=20).unionByName(mapping.pick(mapped(s, d), "77")).select("rank", "symbol", "status"),
    f"WITH {MAPPED} SELECT * FROM (SELECT rank, symbol, status FROM mapped WHERE status = 'READY' ORDER BY rank LIMIT 20) UNION ALL SELECT rank, symbol, status FROM mapped WHERE symbol = '77'")
add("jn08_rank_info", lambda s, d: mapping.with_rank_info(mapping.select_top(mapped(s, d), 50).select("symbol", "selection_order"), mapped(s, d)).select("symbol", F.col("selection_order").cast("bigint").alias("selection_order"), "rank", "market"),
    f"WITH {MAPPED} SELECT symbol, row_number() OVER (ORDER BY rank) AS selection_order, rank, market FROM mapped WHERE status = 'READY' ORDER BY rank LIMIT 50")


def payloads(s, d):
    """A ranking, market lists and ticker lists as a server sends them, 16 pages each, from customer and orders."""
    c = table(s, d, "customer")
    quote = F.array(F.struct(F.lit("EUR").alias("name"), F.lit(0.0).alias("price")), F.struct(F.lit("USD").alias("name"), F.col("c_acctbal").alias("price")))
    coin = F.struct(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey")).alias("cmcRank"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("symbol"), quote.alias("quotes"))
    ranked = c.groupBy(F.pmod("c_custkey", F.lit(16))).agg(F.to_json(F.struct(F.struct(F.collect_list(coin).alias("cryptoCurrencyList")).alias("data"))).alias("value"))
    o = table(s, d, "orders")
    market = F.struct(F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_custkey").cast("string").alias("baseAsset"), F.col("o_orderpriority").alias("quoteAsset"), F.col("o_orderstatus").alias("status"))
    listed = o.groupBy(F.pmod("o_orderkey", F.lit(16))).agg(F.to_json(F.struct(F.collect_list(market).alias("symbols"))).alias("value"))
    tick = F.struct(F.col("o_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), F.col("o_totalprice").cast("string").alias("quoteVolume"), F.col("o_orderkey").alias("count"))
    ticked = o.groupBy(F.pmod("o_custkey", F.lit(16))).agg(F.to_json(F.array_sort(F.collect_list(tick))).alias("value"))
    return ranked, listed, ticked


add("src01_ranking", lambda s, d: rest.parse_ranking(payloads(s, d)[0]).select("Rank", "CMC_ID", "Name", "Symbol", "Price_USD"), "SELECT CAST(c_custkey AS INT) AS \"Rank\", CAST(c_custkey AS INT) AS \"CMC_ID\", c_name AS \"Name\", c_mktsegment AS \"Symbol\", c_acctbal AS \"Price_USD\" FROM customer WHERE c_custkey % 50 <> 0")
add("src02_markets", lambda s, d: rest.parse_markets(payloads(s, d)[1]).select("symbol", "base", "quote", "status"), "SELECT concat('M', o_orderkey) AS symbol, CAST(o_custkey AS VARCHAR) AS base, o_orderpriority AS quote, o_orderstatus AS status FROM orders")
add("src03_tickers", lambda s, d: rest.parse_tickers(payloads(s, d)[2]).select("symbol", F.col("quote_volume").cast("double").alias("quote_volume"), "trades"), "SELECT concat('C', o_custkey) AS symbol, last(o_totalprice ORDER BY o_orderkey) AS quote_volume, max(o_orderkey) AS trades FROM orders GROUP BY o_custkey")

# ---- streams ----------------------------------------------------------------------------------------------------


def ticks(s, d):
    """Ticker messages from events: a purchase is a mini ticker of its user, a view a book ticker; some lines are broken."""
    e = table(s, d, "events").where("event_type in ('purchase', 'view')")
    v, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    mini = F.to_json(F.struct(F.concat(F.lit("u"), "user_id", F.lit("@miniTicker")).alias("stream"), F.struct(F.concat(F.lit("u"), "user_id").alias("s"), F.col("event_id").alias("E"), v.alias("c"), v.alias("o"), v.alias("h"), v.alias("l"), k.alias("v"), k.alias("q")).alias("data")))
    book = F.to_json(F.struct(F.concat(F.lit("u"), "user_id", F.lit("@bookTicker")).alias("stream"), F.struct(F.concat(F.lit("u"), "user_id").alias("s"), v.alias("b"), k.alias("B"), v.alias("a"), k.alias("A")).alias("data")))
    line = F.when(F.col("event_id") % 101 == 0, "{broken").when(F.col("event_type") == "purchase", mini).otherwise(book)
    return ticker.messages(e.select(line.alias("value"), F.col("event_id").alias("seq"), F.col("event_id").alias("ingest_ms")))


def state(df):
    return df.select("symbol", "seq", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("last_price", "volume", "bid_price", "bid_qty")))


TICKS = """k AS (SELECT concat('U', user_id) AS symbol, event_id AS seq, event_type = 'purchase' AS mini, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS q FROM events WHERE event_type IN ('purchase', 'view') AND event_id % 101 <> 0),
  st AS (SELECT symbol, seq, mini, last_value(CASE WHEN mini THEN value END IGNORE NULLS) OVER o AS last_price, last_value(CASE WHEN mini THEN q END IGNORE NULLS) OVER o AS volume,
    last_value(CASE WHEN NOT mini THEN value END IGNORE NULLS) OVER o AS bid_price, last_value(CASE WHEN NOT mini THEN q END IGNORE NULLS) OVER o AS bid_qty FROM k WINDOW o AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)),
  ok AS (SELECT * FROM st WHERE last_price IS NOT NULL AND bid_price IS NOT NULL)"""
_o = "symbol, seq, round(last_price, 6) AS last_price, round(volume, 6) AS volume, round(bid_price, 6) AS bid_price, round(bid_qty, 6) AS bid_qty"
add("str01_ticker_merge", lambda s, d: state(ticker.merged_batch(ticks(s, d))), f"WITH {TICKS} SELECT {_o} FROM ok")
add("str02_emit_on_mini", lambda s, d: state(ticker.merged_batch(ticks(s, d), "mini")), f"WITH {TICKS} SELECT {_o} FROM ok WHERE mini")
add("str09_sampled", lambda s, d: ticker.sampled(ticker.merged_batch(ticks(s, d))).select("symbol", "tick", F.round(F.col("last_price").cast("double"), 6).alias("last_price")), f"WITH {TICKS} SELECT symbol, CAST(floor(seq / 1000) AS BIGINT) AS tick, round(last(last_price ORDER BY seq), 6) AS last_price FROM ok GROUP BY 1, 2")
add("str03_event_time_windows", lambda s, d: live.windowed(ticker.merged_batch(ticks(s, d)), "1 second").select("symbol", F.unix_seconds("ts").alias("second"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "n"),
    f"WITH {TICKS} SELECT symbol, CAST(floor(seq / 1000) AS BIGINT) AS second, round(first(last_price ORDER BY seq), 6) AS open, round(max(last_price), 6) AS high, round(min(last_price), 6) AS low, round(last(last_price ORDER BY seq), 6) AS close, count(*) AS n FROM ok GROUP BY 1, 2")
add("str06_flushes", lambda s, d: live.flushes(ticker.merged_batch(ticks(s, d)), 10).groupBy("symbol", "flush").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq")),
    f"WITH {TICKS}, o AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1) // 10 AS flush FROM ok) SELECT symbol, flush, count(*) AS n, max(seq) AS last_seq FROM o GROUP BY ALL")
