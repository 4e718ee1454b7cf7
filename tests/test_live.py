"""Connections, the stream of tickers, late events, the buffer, status and stop."""

import json

import pytest

from tidewheel.streaming import live
from tidewheel.streaming.ticker import FIELDS, merged_batch, merged_stream, messages


def test_groups_and_backoff():
    g = live.groups([f"S{i}" for i in range(136)])
    assert [len(x) for x in g] == [100, 36] and live.groups(["A", "B"], 1) == [["A"], ["B"]] and live.groups([]) == []
    assert live.stream_names(["BTC"]) == ["btc@miniTicker", "btc@bookTicker"]
    assert [live.backoff(k) for k in (0, 1, 2, 6, 7, 20)] == [0, 1, 2, 32, 60, 60]


def test_reconnecting():
    tries, slept = iter([["a", "b"], OSError(), OSError(), ["c"], OSError()]), []

    def connect():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        yield from x

    out = live.reconnecting(connect, stopped=lambda: len(slept) >= 5, sleep=slept.append)
    assert list(out) == ["a", "b", "c"] and slept == [1, 2, 4, 1, 2]  # a clean connection starts the wait again


def lines(n, symbols=("A", "B", "C")):
    out = []
    for i in range(n):
        s = symbols[i % len(symbols)].lower()
        if i % 2:
            out.append(json.dumps({"stream": f"{s}@miniTicker", "data": {"s": s.upper(), "E": 1000 * i, "c": str(i), "o": "1", "h": "2", "l": "0", "v": "5", "q": "6"}}))
        else:
            out.append(json.dumps({"stream": f"{s}@bookTicker", "data": {"s": s.upper(), "b": str(i), "B": "1", "a": "2", "A": "3"}}))
    out[5] = "{broken"
    return out


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    all_ = lines(60)
    (tmp_path / "in" / "0.jsonl").write_text("\n".join(all_[:40]) + "\n")
    return tmp_path, all_


def batch_of(spark, all_):
    return spark.createDataFrame([(x, i, 0) for i, x in enumerate(all_)], "value string, seq bigint, ingest_ms bigint")


def test_connections_replay_once(spark, folder):
    """A stream of connections, stopped and started again, equals its batch twin."""
    path, all_ = folder
    live.register(spark)

    def run():
        s = spark.readStream.format("tickers").options(folder=f"{path}/in", symbols="A,B,C", most_streams="2").load()
        out = merged_stream(messages(s)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").start()
        live.stop(out)

    run()
    (path / "in" / "1.jsonl").write_text("\n".join(all_[40:]) + "\n")
    run()
    got = spark.read.parquet(f"{path}/out").select("symbol", "seq", *FIELDS).orderBy("seq").collect()
    want = merged_batch(messages(batch_of(spark, all_))).select("symbol", "seq", *FIELDS).orderBy("seq").collect()
    assert got == want and len(want) > 40


def test_late_events(spark, tmp_path):
    """Windows by event time: rows within the watermark count, rows behind it are dropped, a table has all."""
    schema = "symbol string, event_ms bigint, seq bigint, last_price string"
    parts = [[("A", 1000, 0, "5"), ("A", 61_000, 1, "6")], [("A", 2000, 2, "9"), ("A", 200_000, 3, "7")], [("A", 3000, 4, "99"), ("A", 400_000, 5, "8")]]
    frames = [spark.createDataFrame(p, schema) for p in parts]
    frames[0].coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.windowed(stream, "1 minute", "2 minutes").writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    for f in frames[1:]:
        f.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q.processAllAvailable()
    q.stop()
    first = [(r["high"], r["n"]) for r in spark.table("late").where("ts = timestamp'1970-01-01 00:00:00'").collect()]
    assert first == [(5.0, 1), (9.0, 2)]  # the third one came when its window had closed
    whole = live.windowed(frames[0].unionByName(frames[1]).unionByName(frames[2]), "1 minute").where("ts = timestamp'1970-01-01 00:00:00'").first()
    assert (whole["open"], whole["high"], whole["close"], whole["n"]) == (5.0, 99.0, 99.0, 3)


def test_buffer(spark, tmp_path):
    """Full buffers leave as their batch twin says; what is left leaves when its time is up."""
    schema, rows = "symbol string, seq bigint, p string", [(s, i * 2 + k, str(i)) for k, s in enumerate("AB") for i in range(25 if s == "A" else 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.buffered(stream, ["seq", "p"], rows=10, seconds=1).writeStream.format("memory").queryName("buffered").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start()
    import time

    end = time.time() + 60
    while spark.table("buffered").count() < 28 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    got = sorted((r["symbol"], r["seq"], r["flush"]) for r in spark.table("buffered").collect())
    assert got == sorted((r["symbol"], r["seq"], r["flush"]) for r in live.flushes(spark.createDataFrame(rows, schema), 10).collect())


def test_sink_status_and_reset(spark, folder):
    path, all_ = folder
    (path / "in" / "1.jsonl").write_text("\n".join(all_[40:]) + "\n")
    live.register(spark)
    told = []
    status = live.Status(seconds=0, report=told.append)
    spark.streams.addListener(status)
    s = spark.readStream.format("tickers").options(folder=f"{path}/in", symbols="A,B,C").load()
    q = live.live_sink(merged_stream(messages(s)), f"{path}/live", f"{path}/ck", seconds=0.2)
    live.stop(q)
    want = merged_batch(messages(batch_of(spark, all_))).groupBy("symbol").count()
    got = spark.read.parquet(f"{path}/live").groupBy("symbol").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    import time

    end = time.time() + 30
    while status.received < 60 and time.time() < end:
        time.sleep(0.2)
    spark.streams.removeListener(status)
    assert status.received >= 60 and told and "messages received" in told[-1] and not status.errors
    live.reset(spark, f"{path}/live", f"{path}/ck")
    assert not (path / "live").exists() and not (path / "ck").exists()
