"""The live side: connections and their messages, a buffered sink, status and a clean stop.

A connection is anything that yields JSON lines.  `FolderLines` replays landed files; a
websocket client can stand in its place.  What a lost connection did not deliver is not
replayed.
"""

from __future__ import annotations

import glob
import json
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

log = logging.getLogger(__name__)
#: two streams for each symbol
STREAMS_A_SYMBOL = 2
MOST_STREAMS = 200
ROWS, SECONDS, LANES = 100, 10.0, 8


def groups(symbols: list[str], most_streams: int = MOST_STREAMS) -> list[list[str]]:
    """Symbols by connection: as many as its streams allow, one at least."""
    n = max(1, most_streams // STREAMS_A_SYMBOL)
    return [symbols[i : i + n] for i in range(0, len(symbols), n)]


def stream_names(symbols: list[str]) -> list[str]:
    return [f"{s.lower()}@{kind}" for s in symbols for kind in ("miniTicker", "bookTicker")]


def backoff(failures: int, first: float = 1.0, most: float = 60.0) -> float:
    """Seconds to wait after so many failures in a row."""
    return min(first * 2.0 ** (failures - 1), most) if failures else 0.0


def reconnecting(connect: Callable[[], Iterator[str]], stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """Messages of a connection that is opened again whenever it ends or fails, after a growing wait.

    The first message of a connection resets the wait.
    """
    failures = 0
    while not stopped():
        try:
            for m in connect():
                failures = 0
                yield m
                if stopped():
                    return
        except Exception as e:
            log.warning("connection lost: %s", e)
        failures += 1
        sleep(backoff(failures))


@dataclass
class FolderLines:
    """Lines of the files of a folder in the order of their names: what arrived, in order."""

    folder: str

    def count(self) -> int:
        return sum(1 for _ in self.lines(0, 1 << 62))

    def lines(self, start: int, end: int) -> Iterator[tuple[int, str]]:
        n = 0
        for path in sorted(glob.glob(f"{self.folder}/*")):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    if n >= end:
                        return
                    if n >= start:
                        yield n, line.rstrip("\n")
                    n += 1


class TickerSource(DataSource):
    """A stream of ticker messages, one partition for each connection.

    Options: folder (landed lines, on storage that driver and executors share), symbols
    (joined by commas), most_streams.
    """

    @classmethod
    def name(cls) -> str:
        return "tickers"

    def schema(self) -> str:
        return "value string, seq bigint, ingest_ms bigint, connection int"

    def streamReader(self, schema):
        return TickerReader(self.options)


@dataclass
class Span(InputPartition):
    connection: int
    symbols: list
    start: int
    end: int


class TickerReader(DataSourceStreamReader):
    def __init__(self, options):
        self.o = dict(options)
        self.source = FolderLines(self.o["folder"])
        self.groups = groups([s.strip() for s in self.o["symbols"].split(",") if s.strip()], int(self.o.get("most_streams", MOST_STREAMS)))

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": self.source.count()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(i, g, start["line"], end["line"]) for i, g in enumerate(self.groups)]

    def read(self, partition: Span):
        """The lines whose stream is one of the connection's; lines that name no stream come by the first connection."""
        own = set(stream_names(partition.symbols))
        every = {x for g in self.groups for x in stream_names(g)}
        now = int(time.time() * 1000)
        for n, line in self.source.lines(partition.start, partition.end):
            try:
                name = json.loads(line).get("stream")
            except (ValueError, AttributeError):
                name = None
            if name in own or (name not in every and partition.connection == 0):
                yield (line, n, now, partition.connection)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TickerSource)


# ---- event time ---------------------------------------------------------------------------------------------------


def windowed(states: DataFrame, size: str = "1 minute", late: str = "10 seconds") -> DataFrame:
    """Candles of the last price by symbol and window of event time; a stream drops what is later than `late`, a table has all.

    states: symbol, event_ms, seq, last_price.
    """
    d = states.select("symbol", F.timestamp_millis("event_ms").alias("at"), F.col("last_price").try_cast("double").alias("p"), F.struct("event_ms", "seq").alias("o"))
    if states.isStreaming:
        d = d.withWatermark("at", late)
    c = d.where("p is not null").groupBy("symbol", F.window("at", size).alias("w"))
    return c.agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


# ---- the buffered sink --------------------------------------------------------------------------------------------


def buffered(states: DataFrame, columns: list[str], rows: int = ROWS, seconds: float = SECONDS) -> DataFrame:
    """symbol, flush and the columns: rows leave once `rows` of a symbol wait, or `seconds` after the first that waits.

    `flush` numbers a symbol's flushes; rows keep the order of seq.
    """
    types = dict(states.dtypes)
    schema = "symbol string, flush bigint, " + ", ".join(f"`{c}` {types[c]}" for c in columns)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting = (state.get[0], json.loads(state.get[1])) if state.exists else (0, [])
        if not state.hasTimedOut:
            new = pd.concat(list(frames)).sort_values("seq")
            waiting += json.loads(new[columns].to_json(orient="values"))
        out = []
        while len(waiting) >= rows or (state.hasTimedOut and waiting):
            out += [(key[0], number, *r) for r in waiting[:rows]]
            waiting, number = waiting[rows:], number + 1
        state.update((number, json.dumps(waiting)))
        if waiting:
            state.setTimeoutDuration(max(1, int(seconds * 1000)))
        yield pd.DataFrame(out, columns=["symbol", "flush", *columns])

    return states.groupBy("symbol").applyInPandasWithState(step, schema, "number long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def flushes(states: DataFrame, rows: int = ROWS) -> DataFrame:
    """The batch twin of `buffered` for rows that come at once: the number of the flush that each row leaves with."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("seq")) - 1
    return states.withColumn("flush", F.floor(n / rows).cast("bigint"))


def live_sink(states: DataFrame, path: str, checkpoint: str, seconds: float = SECONDS, lanes: int = LANES):
    """Write states to a folder for each symbol every `seconds`: a symbol's rows go through one lane, in order of seq.

    Each micro-batch is written under its number, so one that is repeated after a
    failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        by = batch.repartition(lanes, "symbol").sortWithinPartitions("symbol", "seq").withColumn("batch", F.lit(number))
        by.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "batch").parquet(path)

    return states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, int(seconds * 1000))} milliseconds").start()


def reset(spark: SparkSession, *paths: str) -> None:
    """Delete the folders of an earlier session."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---- status and stop ----------------------------------------------------------------------------------------------


class Status(StreamingQueryListener):
    """Messages received and rows written by all streams, reported every `seconds`."""

    def __init__(self, seconds: float = 60.0, report: Callable[[str], None] = log.info, now: Callable[[], float] = time.time):
        self.seconds, self.report, self.now = seconds, report, now
        self.received = self.written = self.batches = 0
        self.last = now()
        self.errors: list[str] = []

    def line(self) -> str:
        return f"status: {self.received} messages received, {self.written} rows written to disk."

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.received += p.numInputRows
        self.written += max(0, p.sink.numOutputRows if p.sink.numOutputRows is not None else 0)
        self.batches += 1
        if self.now() - self.last >= self.seconds:
            self.last = self.now()
            self.report(self.line())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.errors.append(event.exception)


def drained(q, seconds: float = 60.0) -> bool:
    """Wait until a stream has taken in what has arrived; False if that takes longer.

    Streams whose state has a time limit run batches all the time, so what counts is
    a batch without input, or that the stream waits for data.
    """
    end = time.time() + seconds
    while q.isActive and time.time() < end:
        p, now = q.lastProgress, q.status
        idle = not now["isDataAvailable"] and not now["isTriggerActive"] and now["message"].startswith("Waiting")
        if p is not None and p["numInputRows"] == 0 or idle:
            return True
        time.sleep(0.1)
    return not q.isActive


def stop(*queries, drain: bool = True, seconds: float = 60.0) -> None:
    """Stop streams after what has arrived is written, or after `seconds` in any case."""
    for q in queries:
        if drain and not drained(q, seconds):
            log.warning("stopped with input left")
    for q in queries:
        q.stop()
