"""Models, sinks and progress."""

import random

import pytest

from tidewheel.ml.models import FitResult, Forecaster, RandomForest, make, walk_forward
from tidewheel.operators.quality import gaps
from tidewheel.sinks import Progress, config_hash, drop_tail, feature_summary, gap_text, verify, write_table

SCHEMA = "symbol string, ts timestamp_ntz, feature_0 double, feature_1 double, constant double, target double"


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = random.Random(5), []
    import datetime as dt

    for i in range(200):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append(("AAA", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i + (i > 90)), a, b, 1.0, 2 * a + 0.1 * rng.gauss(0, 1)))
    return spark.createDataFrame(rows, SCHEMA)


def test_forest(spark, data, tmp_path):
    m = RandomForest(trees=10)
    with pytest.raises(RuntimeError):
        m.predict(data)
    with pytest.raises(ValueError):
        m.fit(data.limit(0), ["feature_0"], "target")
    with pytest.raises(ValueError):
        m.fit(data.selectExpr("symbol", "ts", "if(feature_0 > 1, null, feature_0) as feature_0", "target"), ["feature_0"], "target")
    r = m.fit(data, ["feature_0", "feature_1"], "target")
    assert isinstance(r, FitResult) and r.model_size_bytes > 0
    out = m.predict(data)
    assert out.where("lower <= point and point <= upper").count() == 200
    # the mean of the trees is the forest's own prediction
    own = [x["_p"] for x in m.model.transform(data).orderBy("ts").collect()]
    assert [x["point"] for x in out.orderBy("ts").collect()] == pytest.approx(own)
    assert m.set_params(trees=3).get_params()["trees"] == 3


@pytest.mark.parametrize(("name", "params"), [("NaiveQuantiles", {}), ("RandomForest", {"trees": 5}), ("GradientBoosting", {"rounds": 3})])
def test_saved_models(data, tmp_path, name, params):
    m = make(name, **params)
    with pytest.raises(RuntimeError):
        m.save(f"{tmp_path}/m")
    m.fit(data, ["feature_0", "feature_1"], "target")
    m.save(f"{tmp_path}/m")
    again = Forecaster.load(f"{tmp_path}/m")
    want, got = (sorted((r["ts"], r["lower"], r["point"], r["upper"]) for r in x.predict(data).collect()) for x in (m, again))
    assert want == got and again.name == name and again.get_params() == m.get_params()


def test_registry():
    with pytest.raises(KeyError):
        make("none")
    assert make("GradientBoosting", rounds=3).get_params() == {"rounds": 3}


def test_walk_forward(data):
    folds, mean = walk_forward(data, "AAA", "NaiveQuantiles", ["feature_0", "feature_1", "constant"], "target")
    assert folds.count() == 4
    r = mean.first()
    assert r["model_size_bytes"] == 24 and 0 <= r["picp"] <= 1 and r["rmse"] > 0


def test_sinks(spark, data, tmp_path):
    write_table(data, f"{tmp_path}/t")
    write_table(data.limit(0), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 200
    assert drop_tail(data).count() == 199 and feature_summary(data).first()["n_columns"] == 6
    assert gaps(data).count() == 1 and gap_text(data).count("\n") == 1 and gap_text(data, verbose=0).count("\n") == 0
    assert config_hash({"a": 1, "b": 2}) == config_hash({"b": 2, "a": 1})


def test_progress(spark, tmp_path):
    p = Progress(spark, f"{tmp_path}/done")
    p.add("e", "A", "m1")
    p.add("e", "A", "m2", "failed", "why")
    assert sorted(tuple(r) for r in p.left("e", ["A", "B"], ["m1", "m2"]).collect()) == [("A", "m2"), ("B", "m1"), ("B", "m2")]
    kinds = [("A", k) for k in ("model", "scaler", "reducer", "meta", "metrics")] + [("B", "model"), ("B", "model")]
    assert {r["symbol"]: r["verified"] for r in verify(spark.createDataFrame(kinds, "symbol string, kind string")).collect()} == {"A": True, "B": False}
