"""Settings of an experiment: defaults, then a YAML file, then overrides.

The names of sections and keys are those of the YAML files that users have.
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

log = logging.getLogger(__name__)


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass
class PathConfig:
    features_dir: str = "features"
    models_dir: str = "models"
    archive_dir: str = "archive"
    evaluation_dir: str = "evaluation"
    predictions_dir: str = "predictions"
    experiments_dir: str = "experiments"
    logs_dir: str = "logs"


@dataclass
class TargetConfig:
    horizons: list[int] = field(default_factory=lambda: [1, 7, 14, 30, 90])
    price_column: str = "close"
    target_type: str = "log_return"
    steps_per_day: int = 24

    def __post_init__(self):
        require(bool(self.horizons) and min(self.horizons) > 0, f"horizons must be positive, not {self.horizons}")
        require(self.target_type == "log_return", f"no target type {self.target_type}")
        require(self.steps_per_day > 0, "steps_per_day must be positive")


@dataclass
class ReductionConfig:
    correlation_threshold: float = 0.95
    variance_threshold: float = 1e-6

    def __post_init__(self):
        require(0 < self.correlation_threshold <= 1, "correlation_threshold must lie in (0, 1]")
        require(self.variance_threshold >= 0, "variance_threshold must not be negative")


@dataclass
class ValidationConfig:
    min_train_ratio: float = 0.6
    val_size_ratio: float = 0.1
    step_size_ratio: float = 0.1

    def __post_init__(self):
        require(0 < self.min_train_ratio < 1 and 0 < self.val_size_ratio < 1 and self.step_size_ratio > 0, "ratios must lie in (0, 1)")
        require(self.min_train_ratio + self.val_size_ratio <= 1, "min_train_ratio and val_size_ratio exceed the data")


@dataclass
class ScalingConfig:
    method: str = "robust"
    quantile_range: tuple[float, float] = (25.0, 75.0)

    def __post_init__(self):
        self.quantile_range = tuple(self.quantile_range)
        lo, hi = self.quantile_range
        require(self.method == "robust", f"no scaling {self.method}")
        require(0 <= lo < hi <= 100, f"quantile_range {self.quantile_range} is no range")


@dataclass
class ScoringConfig:
    accuracy_weight: float = 0.40
    interval_weight: float = 0.35
    directional_weight: float = 0.20
    efficiency_weight: float = 0.05
    confidence_level: float = 0.90

    def __post_init__(self):
        require(abs(sum(self.weights().values()) - 1) <= 1e-6, "scoring weights must sum to 1")
        require(0 < self.confidence_level < 1, "confidence_level must lie in (0, 1)")

    def weights(self) -> dict[str, float]:
        return {"accuracy": self.accuracy_weight, "interval": self.interval_weight, "direction": self.directional_weight, "efficiency": self.efficiency_weight}


@dataclass
class TrainingConfig:
    seed: int = 42
    n_jobs: int = 1
    verbose: bool = True
    save_all_folds: bool = False
    resume: bool = True


@dataclass
class ExperimentConfig:
    name: str = "default"
    paths: PathConfig = field(default_factory=PathConfig)
    target: TargetConfig = field(default_factory=TargetConfig)
    reduction: ReductionConfig = field(default_factory=ReductionConfig)
    validation: ValidationConfig = field(default_factory=ValidationConfig)
    scaling: ScalingConfig = field(default_factory=ScalingConfig)
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    model_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    coins: list[str] | None = None
    models: list[str] | None = None


def merged(base: dict, over: dict) -> dict:
    """over on top of base; sections that both have are merged in turn."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def built(kind: type, values: dict, at: str = ""):
    """An instance of a dataclass; unknown keys are reported and left out."""
    known = {f.name: f for f in fields(kind)}
    out = {}
    for k, v in (values or {}).items():
        if k not in known:
            log.warning("unknown setting %s%s is ignored", at, k)
            continue
        made = known[k].default_factory() if callable(known[k].default_factory) else None
        out[k] = built(type(made), v, f"{at}{k}.") if is_dataclass(made) else v
    return kind(**out)


def model_defaults(folder: str | None) -> dict[str, dict]:
    """Parameters of models from <folder>/<model>.yaml, by file name."""
    return {p.stem: read_yaml(str(p)) for p in sorted(Path(folder).glob("*.yaml"))} if folder else {}


def read_yaml(path: str) -> dict:
    import yaml

    found = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    require(found is None or isinstance(found, dict), f"{path} is no mapping")
    return found or {}


def load(path: str | None = None, overrides: dict | None = None, defaults_dir: str | None = None) -> ExperimentConfig:
    """Defaults, the file at path if it is given (a missing one raises), and overrides that are not None."""
    base = {"model_params": model_defaults(defaults_dir)}
    values = merged(base, read_yaml(path)) if path else base
    given = {k: v for k, v in (overrides or {}).items() if v is not None}
    return built(ExperimentConfig, merged(values, given))


def to_dict(config: ExperimentConfig) -> dict:
    out = asdict(config)
    out["scaling"]["quantile_range"] = list(config.scaling.quantile_range)
    return out


def config_hash(config: ExperimentConfig | dict, method: str = "sha256") -> str:
    """16 hexadecimal digits of SHA-256, or all 32 of MD5, of the settings in order."""
    text = json.dumps(config if isinstance(config, dict) else to_dict(config), sort_keys=True, default=str).encode()
    require(method in ("sha256", "md5"), f"no hash {method}")
    return hashlib.sha256(text).hexdigest()[:16] if method == "sha256" else hashlib.md5(text, usedforsecurity=False).hexdigest()


def snapshot(config: ExperimentConfig, path: str) -> None:
    """Write the settings as YAML."""
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(to_dict(config), sort_keys=True), encoding="utf-8")


def experiment_ids(folder: str) -> list[str]:
    """exp_NNN of the folder, in order."""
    found = [p.name for p in Path(folder).glob("exp_*") if p.is_dir() and p.name[4:].isdigit()]
    return sorted(found, key=lambda x: int(x[4:]))


def next_experiment(folder: str, resume: bool = False) -> str:
    """The latest experiment to go on with, or the id after it."""
    ids = experiment_ids(folder)
    if resume and ids:
        return ids[-1]
    return f"exp_{(int(ids[-1][4:]) if ids else 0) + 1:03d}"


def elapsed(seconds: float) -> str:
    """12.3s, 4m05s or 3h02m."""
    if seconds < 60:
        return f"{seconds:.1f}s"
    m = int(seconds) // 60
    return f"{m}m{int(seconds) % 60:02d}s" if m < 60 else f"{m // 60}h{m % 60:02d}m"
