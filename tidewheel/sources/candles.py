"""Candle sources: events, daily tables, kline arrays and CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: candles: one table for all symbols
CANDLE_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades bigint"
#: a kline as exchanges send it: numbers as strings
KLINE_SCHEMA = "open_time bigint, open string, high string, low string, close string, volume string, close_time bigint, quote_volume string, trades int, taker_base string, taker_quote string, ignored string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(df: DataFrame, symbol: Column, ts: Column, unit: str, price: Column, size: Column, order: list[Column]) -> DataFrame:
    """Candles of `unit` from ticks: first and last price in `order`, extremes, sums and the number of ticks."""
    d = df.select(symbol.alias("symbol"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("ts"), price.alias("p"), size.alias("q"), F.struct(*order).alias("at"))
    return d.groupBy("symbol", "ts").agg(
        F.min_by("p", "at").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "at").alias("close"),
        F.sum("q").alias("volume"),
        F.sum(F.col("q") * F.col("p")).alias("quote_volume"),
        F.count(F.lit(1)).alias("trades"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles of the events table; an event type is a symbol and props.k the size."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return bars(e, F.col("event_type"), F.col("ts"), "hour", F.col("value"), k, [F.col("ts"), F.col("event_id")])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of lineitem; a return flag is a symbol."""
    x = table(spark, sf_dir, "lineitem")
    return bars(x, F.col("l_returnflag"), F.col("l_shipdate"), "day", F.col("l_extendedprice"), F.col("l_quantity"), [F.col("l_orderkey"), F.col("l_linenumber")])


def parse_klines(raw: DataFrame) -> DataFrame:
    """Candles from klines (symbol and the columns of KLINE_SCHEMA).

    Numbers that do not parse are null; of klines with one opening time the first
    (by row_idx) counts.
    """
    num = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    d = raw.select("symbol", F.timestamp_millis("open_time").cast("timestamp_ntz").alias("ts"), num("open"), num("high"), num("low"), num("close"), num("volume"), num("quote_volume"), F.expr("try_cast(trades as bigint)").alias("trades"), "row_idx")
    from tidewheel.operators.quality import keep_first

    return keep_first(d).drop("row_idx")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Candle files <SYMBOL>.csv; lines that do not parse are kept in _corrupt_record, and a file without a needed column raises."""
    names = "timestamp string, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, _corrupt_record string"
    need = [x.split()[0] for x in names.split(", ")][:-1]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    head = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "line").alias("header"))
    lost = F.array_except(F.array(*map(F.lit, need)), F.transform(F.split("header", ","), lambda x: F.trim(x)))
    if bad := head.select("path", lost.alias("lost")).where(F.size("lost") > 0).first():
        raise ValueError(f"missing columns: {bad['lost']} in {bad['path']}")
    d = spark.read.schema(names).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path)
    symbol = F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))
    idx = F.monotonically_increasing_id()
    return d.select(symbol.alias("symbol"), F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"), *need[1:], idx.alias("row_idx"), "_corrupt_record")


def last_times(df: DataFrame) -> DataFrame:
    """Each symbol's first and last time."""
    return df.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at path; no rows if there is none yet.  Any other failure raises."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
