"""Operators against literals and procedural models."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.ml.evaluate import composite_score, metrics, price_interval, ranked
from tidewheel.ml.prepare import FeatureReducer, RobustScaler, fold_table, folded, targets, valid_rows
from tidewheel.operators import indicators, quality, structure
from tidewheel.operators.mapping import map_coins, select_top, snapshot
from tidewheel.plans.features import compute, features, incremental
from tidewheel.sources.candles import CANDLE_SCHEMA, read_csv
from tidewheel.sources.klines import HOUR_MS, pages, register, retried

START = dt.datetime(2024, 1, 1)


def series(seed: int, n: int, symbol: str = "AAA", skip=()):
    rng, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        o = p
        p = max(1.0, round(p + rng.choice([-3, -2, -1, 0, 1, 2, 3]) * rng.choice([0.5, 1, 2]), 2))
        h, low = max(o, p) + rng.choice([0, 0.5, 1]), min(o, p) - rng.choice([0, 0.5])
        if i not in skip:
            out.append((symbol, START + dt.timedelta(hours=i), o, h, low, p, float(rng.randint(0, 9)), float(rng.randint(0, 99)), rng.randint(0, 5)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(series(7, 620) + series(8, 300, "BTC", skip=range(30, 60)), CANDLE_SCHEMA)


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("symbol", "ts").select(*(f"`{c}`" for c in cols)).collect()]


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_smoothed_means(spark, bars):
    import pandas as pd

    df = indicators.rsi(indicators.atr(indicators.macd(indicators.trend(bars))), 14).where("symbol = 'AAA'").orderBy("ts").toPandas()
    c = df["close"]
    assert max(abs(df["EMA_20"] - c.ewm(span=20, adjust=False).mean())) < 1e-9
    m = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert max(abs(df["MACD_Signal"] - m.ewm(span=9, adjust=False).mean())) < 1e-9
    d = c.diff()
    up, down = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (d.clip(lower=0), -d.clip(upper=0)))
    want = 100 - 100 / (1 + up / down)
    assert df["RSI_14"].isna().sum() == want.isna().sum() == 14 and (df["RSI_14"] - want).abs().max() < 1e-9
    tr = pd.concat([df.high - df.low, (df.high - c.shift()).abs(), (df.low - c.shift()).abs()], axis=1).max(axis=1)
    assert (df["ATR_14"] - tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()).abs().max() < 1e-9


def trend_model(rows, n=5):
    """Swings and the state machine, bar by bar."""
    high, low, shut = ([r[k] for r in rows] for k in (3, 4, 5))
    sh = sl = None
    state, out = 0, []
    for t in range(len(rows)):
        up = dn = False
        i = t - n
        if i >= n:
            if high[i] > max(high[i - n : i]) and high[i] >= max(high[i + 1 : t + 1]):
                up, dn = (up or (sh is not None and high[i] > sh)), (dn or (sh is not None and high[i] <= sh))
                sh = high[i]
            if low[i] < min(low[i - n : i]) and low[i] <= min(low[i + 1 : t + 1]):
                up, dn = (up or (sl is not None and low[i] > sl)), (dn or (sl is not None and low[i] <= sl))
                sl = low[i]
        over, under, turn = sh is not None and shut[t] > sh, sl is not None and shut[t] < sl, 0
        if up and (state >= 0 or over):
            turn, state = (1 if state < 0 else turn), 1
        if dn and (state <= 0 or under):
            turn, state = (1 if state > 0 else turn), -1
        out.append((sh, sl, state, int((state == 1 and over) or (state == -1 and under)), turn))
    return out


def test_trend_equals_the_state_machine(bars):
    df = structure.trend_state(structure.swings(bars)).where("symbol = 'AAA'")
    assert got(df, "Last_Swing_High", "Last_Swing_Low", "Current_Trend", "Break_Of_Structure", "Change_Of_Character") == trend_model(series(7, 620))


def gap_model(rows, age=500):
    out, zones = [], []
    for i, r in enumerate(rows):
        h, low, c = r[3], r[4], r[5]
        if i >= 2 and low > rows[i - 2][3]:
            zones.append([i, 0, rows[i - 2][3], low, False])
        if i >= 2 and h < rows[i - 2][4]:
            zones.append([i, 1, h, rows[i - 2][4], False])
        zones = [z for z in zones if not z[4] and i - z[0] <= age]
        for z in zones:
            z[4] = z[2] <= c <= z[3]
        row = []
        for side in (0, 1):
            free = [z for z in zones if z[1] == side and not z[4]]
            near = min(free, key=lambda z: (abs(c - (z[2] + z[3]) / 2), z[0]), default=None)
            row.append(None if near is None else ((c - (near[2] + near[3]) / 2) / c, i - near[0]))
        newest = max(zones, key=lambda z: (z[0], -z[1]), default=None)
        out.append((row[0] and row[0][0], row[1] and row[1][0], row[0] and row[0][1], int(bool(newest and newest[4]))))
    return out


def test_gaps_equal_the_model(bars):
    df = structure.fair_value_gaps(bars).where("symbol = 'AAA'")
    rows = got(df, "Distance_To_Bullish_FVG", "Distance_To_Bearish_FVG", "FVG_Age", "FVG_Filled")
    for a, b in zip(rows, gap_model(series(7, 620)), strict=True):
        assert close(a[0], b[0]) and close(a[1], b[1]) and a[2:] == b[2:]


def block_model(rows, swings, atr, age=500):
    out, zones = [], []
    for i, r in enumerate(rows):
        c, ref = r[5], rows[max(0, i - 3)][5]
        sh, sl = swings[i][:2]
        far, move = abs(c - ref) >= 2 * (atr[i] or 0), (c - ref) / ref
        for side, made in ((0, (far or move >= 0.03) and c > ref and sh is not None and c > sh), (1, (far or move <= -0.03) and c < ref and sl is not None and c < sl)):
            if i and made:
                for j in range(i - 1, max(-1, i - 11), -1):
                    if (rows[j][5] < rows[j][2]) if side == 0 else (rows[j][5] > rows[j][2]):
                        zones.append([i, side, rows[j][4], rows[j][3], 0])
                        break
        zones = [z for z in zones if i - z[0] <= age]
        row = ()
        for z in zones:
            z[4] += z[2] <= c <= z[3]
        for side in (0, 1):
            near = min((z for z in zones if z[1] == side), key=lambda z: (abs(c - (z[2] + z[3]) / 2), z[0]), default=None)
            row += (0, None, None, 0) if near is None else (1, (c - (near[2] + near[3]) / 2) / c, i - near[0], near[4])
        out.append(row)
    return out


def test_order_blocks_equal_the_model(bars):
    df = structure.order_blocks(structure.swings(indicators.atr(bars))).where("symbol = 'AAA'")
    names = [f"{a}{s}{b}" for s in ("Bullish", "Bearish") for a, b in (("", "_OB_Exists"), ("Distance_To_", "_OB"), ("", "_OB_Age"), ("", "_OB_Retest_Count"))]
    rows, atr = got(df, *names), [r[0] for r in got(df, "ATR_14")]
    assert any(r[0] for r in rows) and any(r[4] for r in rows)
    for a, b in zip(rows, block_model(series(7, 620), trend_model(series(7, 620)), atr), strict=True):
        assert all(close(x, y) for x, y in zip(a, b, strict=True)), (a, b)


def test_features_are_causal(spark, bars):
    whole = compute(bars)
    names = [c for c in whole.columns if c not in bars.columns]
    assert len(names) == 92
    for n in (80, 333):
        part = compute(spark.createDataFrame(series(7, n), CANDLE_SCHEMA))
        a, b = got(part, *names), got(whole.where("symbol = 'AAA'"), *names)[:n]
        assert all(close(x, y) for r, q in zip(a, b, strict=True) for x, y in zip(r, q, strict=True))


def test_context_and_incremental(spark, bars):
    full = features(bars)
    assert len(full.columns) == 9 + 92 + 8
    assert full.where("symbol = 'BTC' and BTC_Close is not null").count() == 0
    old = features(bars.where("ts < timestamp_ntz'2024-01-10 00:00:00'"))
    new = incremental(bars, old)
    last = old.groupBy("symbol").agg(F.max("ts").alias("t"))
    assert new.count() == full.join(last, "symbol").where("ts >= t").count()


def test_days_and_weeks(spark):
    rows = [("A", START + dt.timedelta(hours=h), 1.0, 10.0 + h // 24, 1.0, 5.0, 1.0, 1.0, 1) for h in range(24 * 28) if h // 24 != 9]
    df = structure.liquidity(spark.createDataFrame(rows, CANDLE_SCHEMA)).where("hour(ts) = 0")
    d = {r["ts"].day: r for r in df.collect()}
    assert d[1]["Distance_To_Prev_Day_High"] is None and d[2]["Distance_To_Prev_Day_High"] == (5 - 10) / 5
    assert d[11]["Distance_To_Prev_Day_High"] is None  # the day before has no bar
    assert d[15]["Distance_To_Prev_Week_High"] == (5 - 16) / 5  # Monday: the week before the last
    assert d[14]["Distance_To_Prev_Week_High"] == (5 - 16) / 5  # Sunday: the last week


def test_quality(spark):
    t = lambda h: START + dt.timedelta(hours=h)
    row = lambda h, *x: ("A", t(h) if h is not None else None, *x)
    rows = [row(0, 1.0, 2.0, 1.0, 1.5, 1.0, 1.0, 1, 0), row(0, 1.0, 2.0, 1.0, 1.5, 1.0, 1.0, 1, 1), row(0, 1.0, 2.0, 1.0, 1.6, 1.0, 1.0, 1, 2), row(5, 1.0, 2.0, 1.0, 1.5, None, 1.0, 1, 3), row(2, -1.0, 2.0, 1.0, 9.0, 1.0, -1.0, -1, 4), row(6, float("inf"), 2.0, 1.0, 1.5, 1.0, 1.0, 1, 5), row(None, 1.0, 2.0, 1.0, 1.5, 1.0, 1.0, 1, 6)]
    df = spark.createDataFrame(rows, CANDLE_SCHEMA + ", row_idx bigint")
    found = {r["code"]: r["n"] for r in quality.issues(df).collect()}
    assert found == {"DUPLICATE_ROWS": 1, "DUPLICATE_TIMESTAMPS": 2, "OUT_OF_ORDER_TIMESTAMPS": 1, "MISSING_HOURLY_CANDLES": 3, "NAN_VALUES": 1, "INFINITE_VALUES": 1, "NEGATIVE_PRICES": 1, "NEGATIVE_VOLUME": 1, "NEGATIVE_TRADES": 1, "OHLC_INCONSISTENT": 2, "LARGE_PRICE_JUMPS": 2, "BAD_TIMESTAMP_FORMAT": 1}
    assert quality.report(df).first()["status"] == "FAIL"
    assert [(r["missing_hours"], r["gap_start"].hour) for r in quality.gaps(df.where("ts is not null")).orderBy("gap_no").collect()] == [(1, 1), (2, 3)]
    assert quality.gap_rollup(df.where("ts is not null")).first()["largest_gap"] == 2
    assert quality.repair(df).count() == 4 and quality.accepted(df).count() == 4
    clean = spark.createDataFrame(series(1, 30), CANDLE_SCHEMA).withColumn("row_idx", F.row_number().over(quality.Window.partitionBy("symbol").orderBy("ts")))
    assert quality.report(clean).first()["status"] == "PASS"


def test_targets(spark):
    prices = [100, 105, 110, 108, 112, 115, 120, 118, 122, 125]
    df = spark.createDataFrame([("A", dt.datetime(2026, 1, 1 + i), float(p)) for i, p in enumerate(prices)], "symbol string, ts timestamp_ntz, close double")
    rows = got(targets(df, (1, 7), 1), "log_return_1d", "log_return_7d")
    assert close(rows[0][0], math.log(105 / 100)) and rows[-1][0] is None and close(rows[0][1], math.log(118 / 100)) and rows[3][1] is None
    assert valid_rows(targets(df, (1, 7), 1), ["close"], "log_return_7d").count() == 3
    with pytest.raises(ValueError):
        targets(df, (0,), 1)
    with pytest.raises(ValueError):
        targets(df.withColumn("close", F.lit(0.0)), (1,), 1)
    with pytest.raises(KeyError):
        targets(df, (1,), 1, price="none")


def test_folds(spark):
    sizes = spark.createDataFrame([("A", 100)], "symbol string, n bigint")
    f = [tuple(r) for r in fold_table(sizes).orderBy("fold").collect()]
    assert f == [("A", 0, 60, 60, 70), ("A", 1, 70, 70, 80), ("A", 2, 80, 80, 90), ("A", 3, 90, 90, 100)]
    assert fold_table(sizes, embargo=5).first()["train_end"] == 55
    with pytest.raises(Exception, match="too few rows"):
        fold_table(spark.createDataFrame([("A", 5)], "symbol string, n bigint")).collect()
    df = spark.createDataFrame(series(3, 100), CANDLE_SCHEMA)
    c = {(r["fold"], r["part"]): r["n"] for r in folded(df, fold_table(sizes.withColumn("symbol", F.lit("AAA")))).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert c[0, "train"] == 60 and c[3, "val"] == 10


def test_scaler_and_reducer(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (4.0,), (5.0,)], "feat1 double")
    s = RobustScaler().fit(train)
    assert s.stats == {"feat1": (4.0, 3.0)}
    assert [r[0] for r in RobustScaler.from_json(s.to_json()).transform(spark.createDataFrame([(3.0,), (6.0,)], "feat1 double")).collect()] == [-1 / 3, 2 / 3]
    with pytest.raises(RuntimeError):
        RobustScaler().transform(train)
    rng = random.Random(1)
    rows = [(1.0, a := rng.gauss(0, 1), a + 1e-6 * rng.gauss(0, 1)) for _ in range(100)]
    df = spark.createDataFrame(rows, "zero_var double, col_a double, col_b double")
    m = FeatureReducer(1e-5, 0.95).fit(df, df.columns)
    assert m.low_variance == ["zero_var"] and len(m.kept) == len(m.correlated) == 1
    assert FeatureReducer.from_json(m.to_json()).transform(df).columns == m.kept
    with pytest.raises(RuntimeError):
        FeatureReducer().transform(df)


def test_metrics_and_scores(spark):
    p = spark.createDataFrame([("m", 0.01, 0.012, 0.0, 0.03), ("m", -0.02, -0.015, -0.03, 0.0), ("m", 0.03, 0.025, 0.01, 0.05), ("m", 0.04, 0.045, 0.02, 0.06)], "model string, y double, point double, lower double, upper double")
    r = metrics(p, ["model"]).first()
    assert r["picp"] == r["direction_accuracy"] == r["direction_f1"] == 1 and r["rmse"] > 0 and r["mae"] > 0
    m = spark.createDataFrame([("c", "A", 1.0, 1.0, 0.9, 1.0, 0.9, 1.0), ("c", "B", 2.0, 2.0, 0.5, 2.0, 0.5, 2.0)], "coin string, model string, rmse double, mae double, picp double, mpiw double, direction_accuracy double, training_time_seconds double")
    out = ranked(composite_score(m, ["coin"]), ["coin"]).orderBy("place").collect()
    assert out[0]["model"] == "A" and out[0]["is_winner"] and out[0]["score"] > out[1]["score"]
    with pytest.raises(ValueError):
        composite_score(m, ["coin"], weights={"accuracy": 0.5})
    q = price_interval(spark.createDataFrame([(100.0, 0.02, 0.05, 0.08)], "ref_price double, lower double, point double, upper double")).first()
    assert close(q["median_price"], 100 * math.exp(0.05)) and q["lower_price"] < q["median_price"] < q["upper_price"]


def test_mapping(spark):
    ranking = spark.createDataFrame([(1, "BTC"), (2, "usdt"), (3, "ETH"), (4, "XYZ"), (5, "ABC")], "rank int, symbol string")
    markets = spark.createDataFrame([("BTCEUR", "BTC", "EUR", "TRADING", 0), ("BTCUSDT", "BTC", "USDT", "TRADING", 1), ("ETHBTC", "ETH", "BTC", "TRADING", 2), ("ABCQQQ", "ABC", "QQQ", "TRADING", 3), ("XYZUSDT", "XYZ", "USDT", "BREAK", 4)], "symbol string, base string, quote string, status string, idx int")
    tickers = spark.createDataFrame([("BTCUSDT", "2000000.5"), ("ETHBTC", "bad")], "symbol string, quote_volume string")
    out = {r["symbol"]: r for r in map_coins(ranking, markets, tickers).collect()}
    assert out["BTC"]["status"] == "READY" and out["BTC"]["score"] == 100 and out["BTC"]["level"] == "HIGH" and out["BTC"]["available_markets"] == "BTCEUR;BTCUSDT"
    assert out["usdt"]["status"] == "STABLECOIN_SKIP" and out["XYZ"]["status"] == "NOT_LISTED"
    assert (out["ETH"]["status"], out["ETH"]["score"], out["ETH"]["reason"]) == ("NON_USDT_PAIR", 67, "SYMBOL,TRADING") and out["ABC"]["market"] == "ABCQQQ"
    coins = spark.createDataFrame([(i, f"COIN{i}", "READY") for i in range(10)] + [(20, "N", "NOT_LISTED")], "rank int, symbol string, status string")
    assert [r["symbol"] for r in select_top(coins, 5).orderBy("rank").collect()] == [f"COIN{i}" for i in range(5)]
    assert select_top(coins, 50).count() == 10 and snapshot(coins, select_top(coins, 5)).where("selected").count() == 5
    with pytest.raises(ValueError):
        select_top(coins, 0)
    with pytest.raises(ValueError):
        select_top(coins.where("status <> 'READY'"), 5)


def test_kline_source(spark, tmp_path):
    history = [[i * HOUR_MS, "1", "2", "0.5", "1.5", "9", i * HOUR_MS + 1, "3", 4, "0", "0", "0"] for i in range(2500) if i % 700]
    (tmp_path / "AAA.json").write_text(json.dumps(history))
    register(spark)
    df = spark.read.format("klines").options(folder=str(tmp_path), symbols="AAA, BBB", start=0, end=2500 * HOUR_MS, slice_hours=1000).load()
    assert df.count() == len(history) == df.select("open_time").distinct().count()
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    waits = []
    assert retried(flaky, sleep=waits.append) == 7 and waits == [1, 2]
    short = iter([[[0]], [[HOUR_MS]], []])
    assert len(list(pages(lambda *_: next(short), "A", 0, 10 * HOUR_MS))) == 2


def test_csv(spark, tmp_path):
    (tmp_path / "aaa.csv").write_text("timestamp,open,high,low,close,volume,quote_volume,trades\n2024-01-01 00:00:00,1,2,0.5,1.5,9,3,4\nnever,1,2,0.5,oops,9,3,4\n")
    rows = read_csv(spark, f"{tmp_path}/aaa.csv").collect()
    assert [r["symbol"] for r in rows] == ["AAA", "AAA"] and rows[0]["ts"] == START and rows[1]["ts"] is None and rows[1]["close"] is None
    (tmp_path / "bbb.csv").write_text("timestamp,open\n2024-01-01,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        read_csv(spark, f"{tmp_path}/bbb.csv")
