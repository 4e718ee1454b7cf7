"""Technical indicators of candles: every column is causal.

Each function takes a candle table (symbol, ts, open, high, low, close, volume,
quote_volume, trades) and returns it with more columns.  Null means missing;
divisions by zero are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.windows import change, ewm, lag, log_positive, ratio, rolling, rows, upto

RETURN_HOURS = (1, 3, 6, 12, 24)
#: fixed values: retracement ratios
FIB_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
FIB_WINDOW = 100
MONTH_BARS = 720


def _cols():
    return tuple(F.col(x) for x in ("open", "high", "low", "close", "volume"))


def returns(df: DataFrame) -> DataFrame:
    c = F.col("close")
    return df.withColumns({f"Return_{n}h": change(c, n) for n in RETURN_HOURS} | {"Log_Return": log_positive(ratio(c, lag(c)))})


def trend(df: DataFrame) -> DataFrame:
    c = F.col("close")
    df = df.withColumns({f"SMA_{n}": rolling(F.avg, c, n) for n in (10, 20, 50)})
    for n in (20, 50):
        df = ewm(df, "close", 2 / (n + 1), f"EMA_{n}")
    return df.withColumns({"Close_SMA10_Ratio": ratio(c, F.col("SMA_10")), "Close_SMA20_Ratio": ratio(c, F.col("SMA_20")), "Close_EMA20_Ratio": ratio(c, F.col("EMA_20"))})


def rsi(df: DataFrame, period: int) -> DataFrame:
    """Wilder's relative strength; 100 without losses, null while it warms up."""
    delta = F.col("close") - lag("close")
    df = df.withColumns({"_gain": F.greatest(delta, F.lit(0.0) * delta), "_loss": F.greatest(-delta, F.lit(0.0) * delta)})
    df = ewm(ewm(df, "_gain", 1 / period, "_up", period), "_loss", 1 / period, "_down", period)
    up, down = F.col("_up"), F.col("_down")
    return df.withColumn(f"RSI_{period}", F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + ratio(up, down)))).drop("_gain", "_loss", "_up", "_down")


def macd(df: DataFrame) -> DataFrame:
    df = ewm(ewm(df, "close", 2 / 13, "_fast"), "close", 2 / 27, "_slow").withColumn("MACD", F.col("_fast") - F.col("_slow"))
    df = ewm(df, "MACD", 2 / 10, "MACD_Signal")
    return df.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal")).drop("_fast", "_slow")


def stochastic(df: DataFrame) -> DataFrame:
    low, high = rolling(F.min, "low", 14), rolling(F.max, "high", 14)
    df = df.withColumn("Stoch_%K", ratio(100 * (F.col("close") - low), high - low))
    return df.withColumn("Stoch_%D", rolling(F.avg, F.col("Stoch_%K"), 3))


def momentum(df: DataFrame) -> DataFrame:
    return stochastic(macd(rsi(rsi(df, 7), 14))).withColumn("ROC_12", change(F.col("close"), 12) * 100)


def atr(df: DataFrame) -> DataFrame:
    _, h, l, _, _ = _cols()
    last = lag("close")
    df = df.withColumn("_range", F.greatest(h - l, F.abs(h - last), F.abs(l - last)))
    return ewm(df, "_range", 1 / 14, "ATR_14", 14).drop("_range")


def bands(df: DataFrame) -> DataFrame:
    mean, std = rolling(F.avg, "close", 20), rolling(F.stddev_samp, "close", 20)
    df = df.withColumns({"BB_Upper": mean + 2 * std, "BB_Lower": mean - 2 * std})
    return df.withColumn("BB_Width", ratio(F.col("BB_Upper") - F.col("BB_Lower"), mean))


def volatility(df: DataFrame) -> DataFrame:
    df = bands(atr(df)).withColumn("Rolling_Std_24", rolling(F.stddev_samp, "close", 24))
    df = df.withColumn("_log", log_positive(ratio(F.col("close"), lag("close"))))
    return df.withColumn("Historical_Volatility", rolling(F.stddev_samp, "_log", 24) * (24**0.5)).drop("_log")


def volume(df: DataFrame) -> DataFrame:
    c, v = F.col("close"), F.col("volume")
    df = df.withColumn("_signed", F.coalesce(F.signum(c - lag(c)), F.lit(0.0)) * v)
    df = df.withColumns({"OBV": F.sum("_signed").over(upto()), "Volume_SMA20": rolling(F.avg, v, 20)}).drop("_signed")
    return df.withColumns({"Volume_Ratio": ratio(v, F.col("Volume_SMA20")), "Volume_Change_Pct": change(v, 1) * 100})


def candle(df: DataFrame) -> DataFrame:
    o, h, l, c, _ = _cols()
    return df.withColumns(
        {
            "Body_Size": F.abs(c - o),
            "Upper_Wick": h - F.greatest(o, c),
            "Lower_Wick": F.least(o, c) - l,
            "Body_Pct": ratio(F.abs(c - o), h - l),
            "Range_Pct": ratio(h - l, o),
            "High_Low_Pct": ratio(h - l, l) * 100,
            "Bullish_Candle": F.coalesce(c > o, F.lit(False)).cast("int"),
            "Bearish_Candle": F.coalesce(c < o, F.lit(False)).cast("int"),
        }
    )


def clock(df: DataFrame) -> DataFrame:
    """Hour, day of week (Monday 0), month and weekend flag."""
    return df.withColumns({"Hour": F.hour("ts"), "Day_Of_Week": F.weekday("ts"), "Month": F.month("ts"), "Weekend_Flag": (F.weekday("ts") >= 5).cast("int")})


def rolling_stats(df: DataFrame) -> DataFrame:
    kinds = {"Rolling_Mean_24": F.avg, "Rolling_Std_24_Close": F.stddev_samp, "Rolling_Max_24": F.max, "Rolling_Min_24": F.min}
    return df.withColumns({k: rolling(f, "close", 24) for k, f in kinds.items()})


def relative_strength(df: DataFrame) -> DataFrame:
    c = F.col("close")
    tops = {"Distance_From_ATH": F.max("high").over(upto()), "Distance_From_30D_High": F.max("high").over(rows(MONTH_BARS)), "Distance_From_30D_Low": F.min("low").over(rows(MONTH_BARS))}
    return df.withColumns({k: ratio(c - x, x) for k, x in tops.items()})


def fibonacci(df: DataFrame) -> DataFrame:
    df = df.withColumns({"Fib_Swing_High": F.max("high").over(rows(FIB_WINDOW)), "Fib_Swing_Low": F.min("low").over(rows(FIB_WINDOW))})
    low, span, c = F.col("Fib_Swing_Low"), F.col("Fib_Swing_High") - F.col("Fib_Swing_Low"), F.col("close")
    names = {round(r * 1000): low + span * r for r in FIB_RATIOS}
    return df.withColumns({f"Fib_Level_{k}": x for k, x in names.items()} | {f"Fib_Distance_{k}": ratio(c - x, c) for k, x in names.items()})

