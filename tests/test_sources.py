"""Files, REST payloads and paging."""

import json
import os

import pytest

from tidewheel.operators import quality
from tidewheel.sources import files, klines, rest
from tidewheel.sources.candles import parse_klines

HEAD = "timestamp,open,high,low,close,volume,quote_volume,trades"
HOUR = 3_600_000


def line(h, c=2.0, day=1):
    return f"2024-01-{day:02d} {h:02d}:00:00,1,3,1,{c},5,10,4"


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        (tmp_path / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    put("GOOD.csv", "\n".join([HEAD, line(0), line(1), line(2)]))
    put("FIX.csv", "\n".join([HEAD, line(0), line(0), line(3), line(2, 2.5)]))
    put("EMPTY.csv", "")
    put("HEAD.csv", HEAD + "\n")
    put("LESS.csv", "timestamp,open,close\n2024-01-01 00:00:00,1,2\n")
    put("RAGGED.csv", HEAD + "\n" + line(0) + ",9,9,9\n")
    put("BYTES.csv", HEAD.encode() + b"\n\xff\xfe\x80,1,1\n")
    return str(tmp_path)


def test_file_issues(spark, folder):
    names = spark.createDataFrame([(x,) for x in ("good", "FIX", "EMPTY", "HEAD", "LESS", "RAGGED", "BYTES", "GONE")], "symbol string")
    got = {r["symbol"]: r["code"] for r in files.file_issues(spark, folder, names).collect()}
    assert got == {"EMPTY": "FILE_EMPTY", "HEAD": "NO_DATA_ROWS", "LESS": "MISSING_COLUMNS", "RAGGED": "FILE_UNREADABLE", "BYTES": "FILE_UNREADABLE", "GONE": "FILE_MISSING"}
    report, issues, candles = files.checked_folder(spark, folder, names, fixed=True)
    rows = {r["symbol"]: r.asDict() for r in report.collect()}
    assert report.columns == quality.REPORT and len(rows) == 8
    assert rows["GOOD"]["status"] == "PASS" and rows["GOOD"]["rows"] == 3 and rows["GOOD"]["coverage_pct"] == 100.0
    assert rows["FIX"]["status"] == "FAIL" and rows["FIX"]["fixes_applied"] == "dropped duplicate rows;dropped duplicate timestamps;sorted by timestamp" and rows["FIX"]["missing_candles"] == 1
    assert rows["GONE"]["status"] == "FAIL" and rows["GONE"]["issue_codes"] == "FILE_MISSING" and rows["GONE"]["rows"] == 0
    assert issues.where("symbol = 'FIX'").count() == 4 and candles.count() == 7
    changed = files.write_repaired(candles, report, f"{folder}/out")
    fixed = spark.read.parquet(f"{folder}/out")
    assert [r["symbol"] for r in changed.collect()] == ["FIX"] and fixed.count() == 3
    assert files.checked_folder(spark, f"{folder}/none", names)[0].where("issue_codes = 'FILE_MISSING'").count() == 8


def test_feature_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / f"{name}_features.csv").write_text(text)

    put("AAA", "timestamp,close,f\n2024-01-01 01:00:00,2,inf\n2024-01-01 00:00:00,1,5\n2024-01-01 00:00:00,9,9\nnever,1,1\n")
    put("BBB", "timestamp,close,g\n2024-01-01 00:00:00,3,7\n")
    put("CCC", "timestamp,f\n2024-01-01 00:00:00,3\n")
    assert [r["symbol"] for r in files.feature_symbols(spark, str(tmp_path)).collect()] == ["AAA", "BBB", "CCC"]
    good, bad = files.load_features(spark, str(tmp_path), ["aaa", "BBB", "CCC", "DDD"])
    rows = sorted((r["symbol"], r["ts"].hour, r["close"], r["f"], r["g"]) for r in good.collect())
    assert rows == [("AAA", 0, 1.0, 5.0, None), ("AAA", 1, 2.0, None, None), ("BBB", 0, 3.0, None, 7.0)]
    assert {r["symbol"]: r["message"] for r in bad.collect()} == {"CCC": "missing columns: ['close']", "DDD": "no file"}
    assert files.dataset_summary(good).where("symbol = 'AAA'").first()["n_rows"] == 2
    empty, lost = files.load_features(spark, f"{tmp_path}/none", ["X"])
    assert empty.count() == 0 and lost.count() == 1


def test_ranking_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Rank,Symbol,Status\n1,BTC,READY\n")
    (tmp_path / "bad.csv").write_text("Rank,Name\n1,BTC\n")
    assert files.read_ranking(spark, f"{tmp_path}/r.csv").first()["symbol"] == "BTC"
    with pytest.raises(ValueError, match="Symbol"):
        files.read_ranking(spark, f"{tmp_path}/bad.csv")


class Reply:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def read(self):
        return json.dumps(self.body).encode()


def test_http():
    asked, slept = [], []

    def open_(request, timeout):
        asked.append(request.full_url)
        if len(asked) < 3:
            raise OSError("no answer")
        return Reply({"ok": 1})

    h = rest.Http("http://x", open=open_, sleep=slept.append)
    assert h.get("/a/b", {"q": 1}) == {"ok": 1} and asked[0] == "http://x/a/b?q=1" and slept == [1, 2, 0.15]
    with pytest.raises(OSError):
        rest.Http("http://x", open=lambda *a, **k: (_ for _ in ()).throw(OSError()), sleep=slept.append).get("/")


def test_cache(tmp_path):
    calls = []
    call = lambda: calls.append(1) or {"n": len(calls)}
    path = f"{tmp_path}/c/x.json"
    assert rest.cached(path, call) == rest.cached(path, call) == {"n": 1}
    assert rest.cached(path, call, now=lambda: os.stat(path).st_mtime + 13 * 3600) == {"n": 2}


def test_payloads(spark, tmp_path):
    (tmp_path / "klines").mkdir()
    (tmp_path / "listing.json").write_text(json.dumps({"data": {"cryptoCurrencyList": [{"cmcRank": 2, "id": 7, "name": "E", "symbol": "ETH", "quotes": []}, {"cmcRank": None, "id": 9, "symbol": "AD"}, {"cmcRank": 1, "id": 1, "name": "B", "symbol": "BTC", "quotes": [{"name": "EUR", "price": 1}, {"name": "USD", "price": 5.5, "marketCap": 9}]}]}}))
    (tmp_path / "exchangeInfo.json").write_text(json.dumps({"symbols": [{"symbol": "BTCUSDT", "baseAsset": "BTC", "quoteAsset": "USDT", "status": "TRADING"}]}))
    (tmp_path / "24hr.json").write_text(json.dumps([{"symbol": "BTCUSDT", "quoteVolume": "1"}, {"symbol": "BTCUSDT", "quoteVolume": "2000000", "lastPrice": "5", "count": 3}]))
    rows = [[HOUR * i, "1", "3", "1", "2", "5", HOUR * (i + 1) - 1, "9", 4, "0", "0", "0"] for i in range(5, 9)]
    (tmp_path / "klines" / "BTCUSDT.json").write_text(json.dumps(rows))
    e = rest.Exchange(rest.Landed(str(tmp_path)))
    r = rest.ranking(spark, e).collect()
    assert [(x["Rank"], x["Symbol"], x["Price_USD"]) for x in r] == [(1, "BTC", 5.5), (2, "ETH", None)]
    assert rest.markets(spark, e, f"{tmp_path}/cache").first()["base"] == "BTC" and os.path.exists(f"{tmp_path}/cache/exchangeInfo.json")
    assert rest.tickers(spark, e).first()["quote_volume"] == "2000000"
    got = rest.first_opens(spark.createDataFrame([("BTCUSDT",), ("NONE",)], "symbol string"), e).collect()
    assert {x["symbol"]: x["first_open"] for x in got} == {"BTCUSDT": 5 * HOUR, "NONE": None}


def test_pages():
    hours = list(range(0, 25))
    bad, slept = iter([True, True, False, False, True, False]), []

    def fetch(symbol, start, end, limit):
        if next(bad, False):
            raise OSError
        return [[h * HOUR] for h in hours if start <= h * HOUR <= end][: min(limit, 7)]

    assert [k[0] // HOUR for k in klines.pages(fetch, "A", 0, 24 * HOUR, 10, sleep=slept.append)] == hours
    assert slept == [2, 4, 2]
    with pytest.raises(OSError):
        list(klines.pages(lambda *a: (_ for _ in ()).throw(OSError()), "A", 0, HOUR, sleep=slept.append))
    assert list(klines.pages(lambda *a: [], "A", 0, HOUR)) == []


def test_ranges(spark, tmp_path):
    rows = [[HOUR * i, "1", "3", "1", "2", "5", HOUR * (i + 1) - 1, "9", 4, "0", "0", "0"] for i in range(10)]
    (tmp_path / "A.json").write_text(json.dumps(rows))
    import datetime as dt

    at = lambda h: dt.datetime(1970, 1, 1) + dt.timedelta(hours=h)
    ranges = spark.createDataFrame([("A", at(2), at(4)), ("B", at(0), at(3))], "symbol string, fetch_start timestamp_ntz, fetch_end timestamp_ntz")
    raw = klines.ranges_from(spark, ranges, {"folder": str(tmp_path)}).selectExpr("*", "open_time as row_idx")
    assert [r["ts"].hour for r in parse_klines(raw).orderBy("ts").collect()] == [2, 3, 4]


def test_ingested(spark):
    import datetime as dt

    rows = [("A", dt.datetime(2024, 1, 1, h), 1.0, 3.0, 1.0, 2.0, 5.0, 9.0, 4, h) for h in (0, 1, 4, 5, 6)]
    rows[3] = ("A", dt.datetime(2024, 1, 1, 5), 2.0, 2.0, 2.0, 2.0, 0.0, 0.0, 0, 5)  # nothing happened
    rows[4] = ("A", dt.datetime(2024, 1, 1, 6), 9.0, 3.0, 1.0, 2.0, 5.0, 9.0, 4, 6)  # opens above its high
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, row_idx bigint"
    have = spark.createDataFrame(rows, schema)
    source = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, h), 1.0, 3.0, 1.0, 2.0, 5.0, 9.0, 4) for h in (2, 5)], schema.rsplit(",", 1)[0])

    def fetch(ranges):
        r = ranges.selectExpr("symbol as _s", "fetch_start as _a", "fetch_end as _z")
        return source.join(r, (source["symbol"] == r["_s"]) & source["ts"].between(r["_a"], r["_z"])).drop("_s", "_a", "_z")

    good, bad, totals = quality.ingested(have, fetch)
    assert sorted((r["ts"].hour, r["volume"]) for r in good.collect()) == [(0, 5.0), (1, 5.0), (2, 5.0), (4, 5.0), (5, 5.0)]
    assert [(r["ts"].hour, r["reason"]) for r in bad.collect()] == [(6, "OHLC_INCONSISTENT")]
    assert totals.first().asDict() == {"symbol": "A", "candles": 5, "gaps_filled": 1, "corrected": 1, "rejected": 1}
