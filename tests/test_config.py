"""Settings, ids, signals, notices and exports."""

import json
import os
import signal

import pytest

from tidewheel import config as C
from tidewheel import ops


def test_layers(tmp_path, caplog):
    (tmp_path / "defaults").mkdir()
    (tmp_path / "defaults" / "XGBoost.yaml").write_text("max_depth: 6\nlearning_rate: 0.05\n")
    (tmp_path / "e.yaml").write_text("name: small\ntarget:\n  horizons: [1, 7]\nunknown: 3\nscoring:\n  odd: 1\nmodel_params:\n  XGBoost:\n    max_depth: 3\n")
    c = C.load(str(tmp_path / "e.yaml"), {"coins": ["BTC"], "models": None, "target": {"price_column": "open"}}, str(tmp_path / "defaults"))
    assert (c.name, c.target.horizons, c.target.price_column, c.coins, c.models) == ("small", [1, 7], "open", ["BTC"], None)
    assert c.model_params["XGBoost"] == {"max_depth": 3, "learning_rate": 0.05}
    assert "unknown" in caplog.text and "scoring.odd" in caplog.text
    assert C.load().target.horizons == [1, 7, 14, 30, 90]
    with pytest.raises(FileNotFoundError):
        C.load(str(tmp_path / "none.yaml"))


@pytest.mark.parametrize("bad", [{"target": {"horizons": []}}, {"target": {"horizons": [0]}}, {"target": {"target_type": "price"}}, {"reduction": {"correlation_threshold": 0}}, {"reduction": {"variance_threshold": -1}}, {"validation": {"min_train_ratio": 0.95}}, {"scaling": {"method": "z"}}, {"scaling": {"quantile_range": [75, 25]}}, {"scoring": {"accuracy_weight": 0.5}}, {"scoring": {"confidence_level": 1}}])
def test_wrong_settings_raise(bad):
    with pytest.raises(ValueError):
        C.load(None, bad)


def test_snapshot_and_hash(tmp_path):
    c = C.load(None, {"name": "a"})
    C.snapshot(c, f"{tmp_path}/x/config.yaml")
    again = C.load(f"{tmp_path}/x/config.yaml")
    assert C.to_dict(again) == C.to_dict(c) and C.config_hash(again) == C.config_hash(c) != C.config_hash(C.load(None, {"name": "b"}))
    assert len(C.config_hash(c)) == 16 and len(C.config_hash(c, "md5")) == 32


def test_experiment_ids(tmp_path):
    assert C.next_experiment(str(tmp_path)) == "exp_001" == C.next_experiment(str(tmp_path), resume=True)
    for n in ("exp_001", "exp_009", "exp_010", "exp_x"):
        (tmp_path / n).mkdir()
    assert C.next_experiment(str(tmp_path)) == "exp_011" and C.next_experiment(str(tmp_path), resume=True) == "exp_010"
    assert [C.elapsed(x) for x in (5.25, 245, 3600 * 3 + 125)] == ["5.2s", "4m05s", "3h02m"]


def test_signals_and_notices(tmp_path):
    with ops.StopFlag((signal.SIGUSR1,)) as flag:
        assert not flag()
        os.kill(os.getpid(), signal.SIGUSR1)
        assert flag()
        with pytest.raises(KeyboardInterrupt):
            os.kill(os.getpid(), signal.SIGUSR1)
            signal.sigpending()
    n = ops.FileNotifier(f"{tmp_path}/n/events.jsonl")
    n.send("done", symbol="BTC"), ops.Notifier().send("done"), ops.LogNotifier().send("done", a=1)
    assert json.loads((tmp_path / "n" / "events.jsonl").read_text()) == {"event": "done", "symbol": "BTC"}
    assert ops.seed_all(3).random() == ops.seed_all(3).random()
    assert ops.zipped(str(tmp_path), f"{tmp_path}/all.zip") == 1
    assert len(ops.logging_to(f"{tmp_path}/logs", name="t").handlers) == len(ops.logging_to(f"{tmp_path}/logs", name="t").handlers) == 2


def test_shrinking_and_discovery(tmp_path):
    tried = []

    def call(n):
        tried.append(n)
        if n > 10:
            raise MemoryError
        return n

    assert ops.shrinking(call, 64) == 8 and tried == [64, 32, 16, 8]
    with pytest.raises(MemoryError):
        ops.shrinking(call, 64, least=16)
    (tmp_path / "a" / "features").mkdir(parents=True)
    (tmp_path / "a" / "features" / "BTC_features.csv").write_text("")
    (tmp_path / "a" / "coin_mapping.csv").write_text("")
    assert ops.discovered(str(tmp_path)) == {"features": f"{tmp_path}/a/features", "mapping": f"{tmp_path}/a/coin_mapping.csv", "config": None}
