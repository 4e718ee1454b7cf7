"""Streams equal their batch twins."""

import json

import pytest

from tidewheel.sources.candles import read_or_empty
from tidewheel.streaming.ticker import FIELDS, append_candles, merged_batch, merged_stream, messages, sampled

LINES = [
    {"stream": "a@bookTicker", "data": {"s": "A", "b": "1", "B": "2", "a": "3", "A": "4"}},
    {"stream": "a@miniTicker", "data": {"s": "A", "E": 1500, "c": "9", "o": "8", "h": "9", "l": "7", "v": "5", "q": "6"}},
    {"stream": "b@miniTicker", "data": {"s": "B", "E": 1600, "c": "1"}},
    {"stream": "a@bookTicker", "data": {"s": "A", "b": "1.5", "B": "2", "a": "3", "A": "4"}},
    {"stream": "a@kline", "data": {"s": "A"}},
    {"stream": "a@miniTicker", "data": {"E": 1}},
]


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(json.dumps(x), i, 1000 + i) for i, x in enumerate(LINES)] + [("{broken", 9, 9), ("", 10, 10)]
    return spark.createDataFrame(rows, "value string, seq bigint, ingest_ms bigint")


def test_merge(lines):
    out = [tuple(r) for r in merged_batch(messages(lines)).orderBy("seq").select("symbol", "seq", "event_ms", "last_price", "bid_price").collect()]
    assert out == [("A", 1, 1500, "9", "1"), ("A", 3, 1003, "9", "1.5")]
    assert [r["seq"] for r in merged_batch(messages(lines), "mini").collect()] == [1]
    assert sampled(merged_batch(messages(lines))).first()["bid_price"] == "1.5"


def test_stream_equals_batch(spark, lines, tmp_path):
    lines.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lines.schema).parquet(f"{tmp_path}/in")
    q = merged_stream(messages(stream)).writeStream.format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = merged_batch(messages(lines)).select("symbol", "seq", *FIELDS).orderBy("seq").collect()
    assert spark.table("merged").select("symbol", "seq", *FIELDS).orderBy("seq").collect() == want


def test_incremental_candles(spark, tmp_path):
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, quote_volume double, trades bigint"

    def run(rows):
        spark.sql("select 1")
        spark.createDataFrame(rows, "symbol string, t string, c double").selectExpr("symbol", "cast(t as timestamp) as ts", "c as open", "c as high", "c as low", "c as close", "1D as volume", "1D as quote_volume", "1L as trades").write.mode("append").parquet(f"{tmp_path}/src")
        append_candles(spark.readStream.schema(schema).parquet(f"{tmp_path}/src"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
        return sorted((r["symbol"], r["ts"].hour, r["close"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run([("A", "2024-01-31 22:00:00", 1.0), ("A", "2024-01-31 23:00:00", 2.0)]) == [("A", 22, 1.0), ("A", 23, 2.0)]
    assert run([("A", "2024-01-31 23:00:00", 3.0), ("A", "2024-02-01 00:00:00", 4.0)]) == [("A", 0, 4.0), ("A", 22, 1.0), ("A", 23, 3.0)]


def test_read_or_empty(spark, tmp_path):
    """Only a table that is not there yet is empty; one that cannot be read raises."""
    schema = "symbol string, month string"
    assert read_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet file")
    with pytest.raises(Exception, match="FAILED_READ_FILE|not a Parquet file"):
        read_or_empty(spark, f"{tmp_path}/bad", schema).count()
