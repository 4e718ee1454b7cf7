"""Local models, the experiment run, prediction, explanation, and the commands."""

import json
import math

import numpy as np
import pytest

from tidewheel import cli
from tidewheel.config import ExperimentConfig, TargetConfig
from tidewheel.ml import local as L
from tidewheel.ml import run as R

FAST = {"RandomForest": {"n_estimators": 25}, "XGBoost": {"n_estimators": 40, "learning_rate": 0.1}, "LightGBM": {"n_estimators": 40, "learning_rate": 0.1}, "ARIMA": {}, "NaiveQuantiles": {}}


@pytest.fixture(scope="module")
def xy():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8))
    return x, 2 * x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * r.normal(size=500)


@pytest.mark.parametrize("name", FAST)
def test_model(name, xy, tmp_path):
    x, y = xy
    m = L.make(name, **FAST[name])
    with pytest.raises(RuntimeError):
        m.predict(x)
    with pytest.raises(RuntimeError):
        m.dumps()
    with pytest.raises(ValueError):
        m.fit(x[:0], y[:0])
    with pytest.raises(ValueError):
        m.fit(np.where(x > 2, np.nan, x), y)
    m.fit(x[:350], y[:350], x[350:400], y[350:400])
    lo, p, hi = m.predict(x[400:])
    assert (lo <= p).all() and (p <= hi).all() and len(p) == 100
    assert L.judged(y[400:], lo, p, hi)["picp"] >= 0.6
    m.save(f"{tmp_path}/m.json")
    again = L.LocalModel.load(f"{tmp_path}/m.json")
    assert all(np.array_equal(a, b) for a, b in zip(again.predict(x[400:]), (lo, p, hi), strict=True)) and again.get_params().keys() == m.get_params().keys()
    with pytest.raises(ValueError):
        m.predict(x[:, :3])
    two = L.make(name, **FAST[name]).fit(x[:200], np.stack([y[:200], -y[:200]], 1)).predict(x[:5])
    assert two[1].shape == (5, 2)


def test_registry_and_params():
    with pytest.raises(KeyError):
        L.make("none")
    with pytest.raises(TypeError):
        L.make("ARIMA", odd=1)
    assert L.make("XGBoost", max_depth=3).set_params(max_depth=4).get_params()["max_depth"] == 4

    class Mine(L.Baseline):
        name = "Mine"

    L.register(Mine)
    assert isinstance(L.make("Mine"), Mine)
    del L.REGISTRY["Mine"]


def test_learning(xy):
    """Trees learn what a constant cannot, and the forest's interval is made of its trees."""
    x, y = xy
    base = math.sqrt(((y[400:] - np.median(y[:400])) ** 2).mean())
    for name in ("RandomForest", "XGBoost", "LightGBM"):
        m = L.make(name, **FAST[name]).fit(x[:400], y[:400])
        lo, p, hi = m.predict(x[400:])
        assert L.judged(y[400:], lo, p, hi)["rmse"] < 0.7 * base
    forest = L.make("RandomForest", n_estimators=25).fit(x[:400], y[:400])
    all_ = forest.across(forest.state["models"][0], x[400:])
    lo, p, hi = forest.predict(x[400:])
    assert np.allclose(lo, np.percentile(all_, 5, axis=0)) and np.allclose(p, all_.mean(0)) and np.allclose(hi, np.percentile(all_, 95, axis=0))


def test_tree_is_the_best_split():
    """One split of one column against trying all of them."""
    r = np.random.default_rng(2)
    codes = r.integers(0, 20, (300, 1)).astype(np.uint8)
    y = np.where(codes[:, 0] > 12, 3.0, 0.0) + r.normal(size=300)
    t = L.Tree().fit(codes, y - y.mean(), lambda rows: float(y[rows].mean()), 64, r, 1, 2, 1)
    best = min(range(19), key=lambda c: sum(((y[s] - y[s].mean()) ** 2).sum() for s in (codes[:, 0] <= c, codes[:, 0] > c)))
    assert t.cut[0] == best and t.value[1] == pytest.approx(y[codes[:, 0] <= best].mean())


def test_autoregression():
    r = np.random.default_rng(3)
    y = [0.0, 0.0]
    for _ in range(2000):
        y.append(0.1 + 0.5 * y[-1] - 0.3 * y[-2] + 0.1 * r.normal())
    m = L.make("ARIMA").fit(np.zeros((2002, 1)), np.array(y))
    assert np.allclose(m.state["models"][0]["coef"], [0.1, 0.5, -0.3], atol=0.05)
    lo, p, hi = m.predict(np.zeros((200, 1)))
    assert p[-1] == pytest.approx(np.mean(y), abs=0.02) and (hi - lo)[-1] > (hi - lo)[0]
    walk = L.make("ARIMA", order=(1, 1, 0)).fit(np.zeros((2002, 1)), np.cumsum(y)).predict(np.zeros((3, 1)))
    assert abs(walk[1][0] - np.cumsum(y)[-1]) < 1


def test_reducer_and_scaler():
    r = np.random.default_rng(4)
    a = r.normal(size=200)
    x = np.stack([a, a + 1e-6 * r.normal(size=200), np.ones(200), r.normal(size=200)], 1)
    m = L.Reducer().fit(x, list("abcd"))
    assert m.low_variance == ["c"] and len(m.correlated) == 1 and "d" in m.kept and len(m.kept) == 2
    with pytest.raises(KeyError):
        m.columns(["a"])
    s = L.Scaler().fit(np.array([[1.0], [2], [10], [4], [5]]))
    assert s.center[0] == 4 and s.scale[0] == 3
    with pytest.raises(RuntimeError):
        L.Scaler().transform(x)
    with pytest.raises(ValueError):
        L.fold_ends(9)
    assert L.fold_ends(100) == [(60, 70), (70, 80), (80, 90), (90, 100)]


@pytest.fixture(scope="module")
def features(spark):
    import datetime as dt

    r, rows = np.random.default_rng(5), []
    for s in ("AAA", "BBB", "SHORT"):
        p = 100.0
        for i in range(8 if s == "SHORT" else 160):
            f = float(r.normal())
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), p, f, 2 * f, 1.0))
            p *= math.exp(0.02 * f + 0.002 * float(r.normal()))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, f double, g double, one double")


@pytest.fixture(scope="module")
def config():
    return ExperimentConfig(target=TargetConfig(horizons=[1, 3], steps_per_day=1), models=["NaiveQuantiles", "LightGBM"], model_params={"LightGBM": {"n_estimators": 30, "learning_rate": 0.1, "min_child_samples": 5}})


def test_run(spark, features, config, tmp_path):
    path = f"{tmp_path}/out"
    from dataclasses import replace

    found = R.run(features, replace(config, coins=["AAA", "BBB", "SHORT", "NONE"]), path, "exp_001", at_once=2).cache()
    status = {(r["symbol"], r["model"], r["horizon"]): (r["status"], r["message"]) for r in found.collect()}
    assert len(status) == 16 and status["AAA", "LightGBM", 1][0] == "ok"
    assert status["NONE", "LightGBM", 1] == ("failed", "no feature rows") and "too few rows" in status["SHORT", "LightGBM", 3][1]
    r = found.where("symbol = 'AAA' and model = 'LightGBM' and horizon = 1").first()
    assert json.loads(r["reducer"])["low_variance"] == ["one"] and len(json.loads(r["reducer"])["correlated"]) == 1
    assert json.loads(r["meta"])["model_name"] == "LightGBM" and r["n_folds"] >= 4 and r["rmse"] < 0.02
    n = R.results(spark, path).count()
    R.run(features, config, path, "exp_001")  # only what is not finished runs again
    again = R.results(spark, path)
    assert again.count() == n + 4 and again.where("symbol = 'AAA'").count() == 4
    assert R.failures(R.latest(again)).select("symbol").distinct().count() == 2
    ranking = R.selected(found, config)
    win = {x["symbol"]: x["model"] for x in ranking.where("is_winner").collect()}
    assert win == {"AAA": "LightGBM", "BBB": "LightGBM"}
    best, rest = R.production(found, ranking)
    assert best.count() == rest.count() == 4
    out = {x["symbol"]: x for x in R.predicted(best, features, 1).collect()}
    assert set(out) == {"AAA", "BBB"}
    x = out["AAA"]
    assert x["lower_price"] <= x["median_price"] <= x["upper_price"] and x["median_price"] == pytest.approx(x["ref_price"] * math.exp(x["point"]))
    # the same by hand
    a = best.where("symbol = 'AAA' and horizon = 1").first()
    last = features.where("symbol = 'AAA'").orderBy("ts").collect()[-1]
    kept, sc = json.loads(a["reducer"])["kept"], json.loads(a["scaler"])
    z = (np.array([[last[k] for k in kept]]) - np.array(sc["center"])) / np.array(sc["scale"])
    assert x["point"] == pytest.approx(float(L.LocalModel.loads(bytes(a["artifact"])).predict(z)[1][0]))
    assert {r["symbol"] for r in R.missing_models(best, features, 1).collect()} == {"SHORT"}
    with pytest.raises(ValueError):
        R.selected(found.where("status = 'none'"))
    why = R.explained(best.where("symbol = 'AAA'"), features, config, 1, groups={"signal": ["f", "g"], "price": ["close"]})
    got = {(r["kind"], r["name"]): r["value"] for r in why.collect()}
    signal = next(v for (k, n), v in got.items() if k == "permutation" and n in ("f", "g"))
    assert signal > 5 * abs(got["permutation", "close"]) and got["ablation", "signal"] > got["ablation", "price"]
    t = R.tuned(features.where("symbol = 'AAA'"), config, "LightGBM", 1, 4, {"n_estimators": ("int", 5, 30), "learning_rate": ("log_float", 0.01, 0.3), "subsample": ("float", 0.5, 1.0)})
    assert t.count() == 4 and t.where("rmse > 0").count() == 4


def test_spaces():
    rng = np.random.default_rng(6)
    for name, space in R.SEARCH_SPACES.items():
        for _ in range(20):
            d = R.drawn(space, rng)
            assert all(lo <= d[k] <= hi and isinstance(d[k], int if kind == "int" else float) for k, (kind, lo, hi) in space.items()), name


def test_commands(spark, features, tmp_path):
    out, hour = str(tmp_path / "out"), 3_600_000
    (tmp_path / "src" / "klines").mkdir(parents=True)
    usd = lambda p: [{"name": "USD", "price": p}]
    (tmp_path / "src" / "listing.json").write_text(json.dumps({"data": {"cryptoCurrencyList": [{"cmcRank": i, "id": i, "name": s, "symbol": s, "slug": s, "quotes": usd(1.0)} for i, s in enumerate(("BTC", "USDT", "XYZ"), 1)]}}))
    (tmp_path / "src" / "exchangeInfo.json").write_text(json.dumps({"symbols": [{"symbol": "BTCUSDT", "baseAsset": "BTC", "quoteAsset": "USDT", "status": "TRADING"}]}))
    (tmp_path / "src" / "24hr.json").write_text(json.dumps([{"symbol": "BTCUSDT", "quoteVolume": "2000000", "lastPrice": "5", "count": 3, "priceChangePercent": "1.5"}]))
    r = np.random.default_rng(7)
    closes = 100 * np.exp(np.cumsum(0.01 * r.normal(size=300)))
    rows = [[hour * i, str(c), str(c * 1.01), str(c * 0.99), str(c), "5", hour * (i + 1) - 1, "9", 4, "0", "0", "0"] for i, c in enumerate(closes)]
    (tmp_path / "src" / "klines" / "BTCUSDT.json").write_text(json.dumps(rows))
    text = cli.main(["map", "--source", str(tmp_path / "src"), "--out", out], spark)
    assert "Ready : 1" in text and "NOT_LISTED" in text
    got = cli.main(["ingest", "--source", str(tmp_path / "src"), "--out", out, "--mapping", f"{out}/coin_mapping", "--start", "0", "--end", str(hour * 299)], spark)
    assert got["candles"] == 300 and got["ok"] == 1
    made = cli.main(["features", "--candles", f"{out}/candles", "--out", out, "--context", "BTCUSDT"], spark)
    assert made["rows"] == 251 == cli.main(["features", "--candles", f"{out}/candles", "--out", out, "--context", "BTCUSDT"], spark)["rows"]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "BTC.csv").write_text("timestamp,open,high,low,close,volume,quote_volume,trades\n2024-01-01 00:00:00,1,2,1,2,1,1,1\n")
    assert cli.main(["validate", "--folder", str(tmp_path / "files"), "--mapping", f"{out}/coin_mapping", "--out", f"{out}/v", "--fix"], spark) == {"PASS": 1}
    features.write.partitionBy("symbol").parquet(f"{out}/f")
    (tmp_path / "c.yaml").write_text("target: {horizons: [1], steps_per_day: 1}\nmodels: [NaiveQuantiles, ARIMA]\n")
    common = ["--config", str(tmp_path / "c.yaml"), "--out", out]
    got = cli.main(["train", *common, "--features", f"{out}/f"], spark)
    assert got == {"experiment": "exp_001", "ok": 4, "failed": 2}
    assert cli.main(["run-all", *common, "--features", f"{out}/f", "--no-resume", "--coin", "AAA", "--model", "ARIMA", "--horizon", "1"], spark) == {"experiment": "exp_002", "ok": 1, "failed": 0}
    assert cli.main(["select", *common], spark) == {"AAA": "ARIMA"}
    p = cli.main(["predict", *common, "--features", f"{out}/f", "--coin", "AAA"], spark)
    assert p["symbol"] == "AAA" and p["lower_price"] < p["upper_price"]
    with pytest.raises(FileNotFoundError):
        cli.main(["predict", *common, "--features", f"{out}/f", "--coin", "ZZZ"], spark)
    assert cli.main(["explain", *common, "--features", f"{out}/f", "--coin", "AAA"], spark)
    assert cli.main(["report", *common], spark) == {"models": 1}
    with pytest.raises(SystemExit):
        cli.main(["none"], spark)
