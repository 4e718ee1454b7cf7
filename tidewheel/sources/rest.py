"""Market data over HTTP: ranking, exchange information, tickers and klines.

A transport is anything with get(endpoint, params) that returns decoded JSON.
`Http` asks a server; `Landed` answers from a folder of JSON files.  Payloads become
tables by `from_json`, so the same parsing serves payloads that were landed in bulk.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.sources.klines import retried

CACHE_HOURS = 12.0
#: fixed values: columns of the ranking and of the currency whose quote counts
USD = "USD"
RANKING = "Rank int, CMC_ID int, Name string, Symbol string, Slug string, Price_USD double, MarketCap double, Volume24h double, CirculatingSupply double, TotalSupply double, MaxSupply double, DateAdded string"
COIN = "struct<cmcRank: int, id: int, name: string, symbol: string, slug: string, quotes: array<struct<name: string, price: double, marketCap: double, volume24h: double>>, circulatingSupply: double, totalSupply: double, maxSupply: double, dateAdded: string>"
MARKET = "struct<symbol: string, baseAsset: string, quoteAsset: string, status: string>"
TICKER = "struct<symbol: string, lastPrice: string, quoteVolume: string, priceChangePercent: string, count: bigint>"


@dataclass
class Http:
    """GET with a time limit, three attempts with growing waits, and a pause after each success."""

    base: str
    attempts: int = 3
    timeout: float = 30.0
    pause: float = 0.15
    headers: dict = field(default_factory=dict)
    open: Callable = urllib.request.urlopen
    sleep: Callable[[float], None] = time.sleep

    def get(self, endpoint: str, params: dict | None = None):
        url = self.base + endpoint + ("?" + urllib.parse.urlencode(params) if params else "")

        def once():
            with self.open(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as r:
                return json.loads(r.read())

        out = retried(once, self.attempts, self.sleep)
        self.sleep(self.pause)
        return out


@dataclass
class Landed:
    """Answers from <folder>/<last part of the endpoint>.json; klines from <folder>/klines/<symbol>.json, cut as the server cuts them."""

    folder: str

    def get(self, endpoint: str, params: dict | None = None):
        name, p = endpoint.rstrip("/").rsplit("/", 1)[-1], params or {}
        if name != "klines":
            return json.loads(Path(self.folder, f"{name}.json").read_text(encoding="utf-8"))
        path = Path(self.folder, "klines", f"{p['symbol']}.json")
        rows = json.loads(path.read_text(encoding="utf-8")) if path.exists() else []
        return [k for k in rows if p.get("startTime", 0) <= int(k[0]) <= p.get("endTime", 1 << 62)][: p.get("limit", 1000)]


@dataclass
class Exchange:
    """The endpoints of a spot exchange, and a ranking service."""

    transport: object
    interval: str = "1h"

    def exchange_info(self) -> dict:
        return self.transport.get("/api/v3/exchangeInfo")

    def tickers(self) -> list:
        return self.transport.get("/api/v3/ticker/24hr")

    def ranking(self, limit: int = 200) -> dict:
        return self.transport.get("/data-api/v3/cryptocurrency/listing", {"start": 1, "limit": limit})

    def klines(self, symbol: str, start: int, end: int, limit: int = 1000) -> list:
        return self.transport.get("/api/v3/klines", {"symbol": symbol, "interval": self.interval, "startTime": start, "endTime": end, "limit": limit})

    def first_open(self, symbol: str) -> int | None:
        """The opening time of the first kline there is; None if there is none or the request fails."""
        try:
            page = self.klines(symbol, 0, (1 << 53), 1)
            return int(page[0][0]) if page else None
        except Exception:  # a symbol that cannot be asked for has no known first kline
            return None


def cached(path: str, call: Callable[[], object], hours: float = CACHE_HOURS, now: Callable[[], float] = time.time):
    """What call returned less than `hours` ago, from the file at path, or else what it returns now."""
    p = Path(path)
    if p.exists() and now() - p.stat().st_mtime < hours * 3600:
        return json.loads(p.read_text(encoding="utf-8"))
    out = call()
    p.parent.mkdir(parents=True, exist_ok=True)
    p.with_suffix(".tmp").write_text(json.dumps(out), encoding="utf-8")
    p.with_suffix(".tmp").replace(p)
    return out


def payload(spark: SparkSession, found) -> DataFrame:
    """One row with a decoded payload as JSON text."""
    return spark.createDataFrame([(json.dumps(found),)], "value string")


def parse_ranking(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Coins of ranking payloads, columns RANKING, best rank first; entries without a rank are left out."""
    schema = f"data struct<cryptoCurrencyList: array<{COIN}>>"
    c = payloads.select(F.explode(F.from_json(column, schema)["data"]["cryptoCurrencyList"]).alias("c")).where("c.cmcRank is not null")
    usd = F.get(F.filter("c.quotes", lambda q: q["name"] == USD), F.lit(0))
    pick = {"Rank": "c.cmcRank", "CMC_ID": "c.id", "Name": "c.name", "Symbol": "c.symbol", "Slug": "c.slug"}
    quotes = {"Price_USD": "price", "MarketCap": "marketCap", "Volume24h": "volume24h"}
    rest = {"CirculatingSupply": "c.circulatingSupply", "TotalSupply": "c.totalSupply", "MaxSupply": "c.maxSupply", "DateAdded": "c.dateAdded"}
    cols = [F.col(x).alias(k) for k, x in pick.items()] + [usd[x].alias(k) for k, x in quotes.items()] + [F.col(x).alias(k) for k, x in rest.items()]
    return c.select(*cols).orderBy("Rank")


def parse_markets(payloads: DataFrame, column: str = "value") -> DataFrame:
    """symbol, base, quote, status and idx (place in the list) of exchange information."""
    m = payloads.select(F.posexplode(F.from_json(column, f"symbols array<{MARKET}>")["symbols"]).alias("idx", "m"))
    return m.select("m.symbol", F.col("m.baseAsset").alias("base"), F.col("m.quoteAsset").alias("quote"), "m.status", "idx")


def parse_tickers(payloads: DataFrame, column: str = "value") -> DataFrame:
    """symbol, last_price, quote_volume, price_change_percent, trades; of tickers of one symbol the last counts."""
    t = payloads.select(F.posexplode(F.from_json(column, f"array<{TICKER}>")).alias("idx", "t")).where("t.symbol is not null")
    last = t.groupBy(F.col("t.symbol").alias("symbol")).agg(F.max_by("t", "idx").alias("t"))
    return last.select("symbol", F.col("t.lastPrice").alias("last_price"), F.col("t.quoteVolume").alias("quote_volume"), F.col("t.priceChangePercent").alias("price_change_percent"), F.col("t.count").alias("trades"))


def ranking(spark: SparkSession, exchange: Exchange, limit: int = 200) -> DataFrame:
    return parse_ranking(payload(spark, exchange.ranking(limit)))


def markets(spark: SparkSession, exchange: Exchange, cache: str | None = None) -> DataFrame:
    found = cached(f"{cache}/exchangeInfo.json", exchange.exchange_info) if cache else exchange.exchange_info()
    return parse_markets(payload(spark, found))


def tickers(spark: SparkSession, exchange: Exchange, cache: str | None = None) -> DataFrame:
    found = cached(f"{cache}/ticker24.json", exchange.tickers) if cache else exchange.tickers()
    return parse_tickers(payload(spark, found))


def first_opens(symbols: DataFrame, exchange: Exchange) -> DataFrame:
    """symbol and first_open (ms; null if unknown) of each symbol, asked for in parallel."""

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([exchange.first_open(x) for x in names], pa.int64())], ["symbol", "first_open"])

    return symbols.select("symbol").mapInArrow(ask, "symbol string, first_open bigint")
