"""A paged kline source: one partition for each symbol and slice of time, with retries.

Pages come from a function, so any transport can stand behind it; `FolderPages`
replays landed JSON files, one page each.
"""

from __future__ import annotations

import json
import logging
import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewheel.sources.candles import KLINE_SCHEMA

HOUR_MS = 3_600_000
PAGE = 1000
ATTEMPTS = 3
FAILURES = 5


def retried(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """Call, and after a failure wait 1, 2, 4, ... seconds and call again."""
    for i in range(attempts):
        try:
            return call()
        except Exception:
            if i + 1 == attempts:
                raise
            sleep(2**i)


def pages(fetch: Callable[[str, int, int, int], list], symbol: str, start: int, end: int, limit: int = PAGE, failures: int = FAILURES, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """All klines of [start, end], page by page.

    The cursor follows the last opening time.  A short page does not end the history:
    an empty one does, or one whose last kline is less than an hour before the end.
    After `failures` requests in a row have failed, waiting 2, 4, 8, ... seconds, the
    last failure is raised.
    """
    at, failed = start, 0
    while at <= end:
        try:
            page = fetch(symbol, at, end, limit)
            failed = 0
        except Exception:
            failed += 1
            if failed >= failures:
                raise
            sleep(2**failed)
            continue
        if not page:
            return
        yield from page
        last = int(page[-1][0])
        if end - last < HOUR_MS or last + HOUR_MS <= at:
            return
        at = last + HOUR_MS


class FolderPages:
    """Klines from <folder>/<symbol>.json, an array of 12-element arrays; a file is parsed once."""

    def __init__(self, folder: str):
        self.folder, self.held = folder, {}

    def __call__(self, symbol: str, start: int, end: int, limit: int) -> list:
        if symbol not in self.held:
            path = Path(self.folder, f"{symbol}.json")
            rows = json.loads(path.read_text()) if path.exists() else []
            self.held = {symbol: (rows, [int(k[0]) for k in rows])}
        rows, opens = self.held[symbol]
        first = bisect_left(opens, start)
        return rows[first : min(first + limit, bisect_right(opens, end))]


class KlineSource(DataSource):
    """Options: folder (landed files) or base (a server), symbols (joined by commas), start and end (ms), slice_hours, interval."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, " + KLINE_SCHEMA

    def reader(self, schema):
        return KlineReader(self.options)


@dataclass
class Slice(InputPartition):
    symbol: str
    start: int
    end: int


class KlineReader(DataSourceReader):
    def __init__(self, options):
        self.o = dict(options)

    def partitions(self) -> list[Slice]:
        start, end = int(self.o["start"]), int(self.o["end"])
        width = int(self.o.get("slice_hours", 24 * 365)) * HOUR_MS
        return [Slice(s.strip(), a, min(a + width, end + 1) - 1) for s in self.o["symbols"].split(",") for a in range(start, end + 1, width)]

    def fetch(self) -> Callable[[str, int, int, int], list]:
        if "base" not in self.o:
            return FolderPages(self.o["folder"])
        from tidewheel.sources.rest import Exchange, Http

        return Exchange(Http(self.o["base"]), self.o.get("interval", "1h")).klines

    def read(self, partition: Slice):
        """Arrow batches, a page each at most."""
        import pyarrow as pa

        names = ["symbol", *(x.split()[0] for x in KLINE_SCHEMA.split(", "))]
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 3]
        rows = []

        def batch():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for k in pages(self.fetch(), partition.symbol, partition.start, partition.end):
            rows.append((partition.symbol, int(k[0]), *map(str, k[1:6]), int(k[6]), str(k[7]), int(k[8]), *map(str, k[9:12])))
            if len(rows) == PAGE:
                yield batch()
                rows = []
        if rows:
            yield batch()


def ranges_from(spark: SparkSession, ranges: DataFrame, options: dict) -> DataFrame:
    """Klines of ranges (symbol, fetch_start, fetch_end), both ends included; a range that cannot be fetched gives no rows."""
    reader = KlineReader({"start": "0", "end": "0", "symbols": "", **options})

    def run(batches):
        for b in batches:
            for symbol, a, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    yield from reader.read(Slice(symbol, a, z))
                except Exception as e:  # what cannot be fetched stays a gap
                    logging.getLogger(__name__).warning("%s %s-%s: %s", symbol, a, z, e)

    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return ranges.select("symbol", ms("fetch_start"), ms("fetch_end")).mapInArrow(run, "symbol string, " + KLINE_SCHEMA)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KlineSource)
