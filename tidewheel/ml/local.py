"""Models of one symbol's rows in numpy: what a task of the experiment run fits and stores.

A symbol's history is a few ten thousand hours, so one fit has bounded memory; runs
are parallel over symbols.  Every model gives (lower, point, upper) and is stored as JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np

CONFIDENCE = 0.90
LOW, HIGH = 0.05, 0.95


def checked(x: np.ndarray, y: np.ndarray | None = None) -> None:
    if not len(x):
        raise ValueError("no rows")
    if not np.isfinite(x).all() or y is not None and not np.isfinite(y).all():
        raise ValueError("missing values")


# ---- preparation, on training rows alone --------------------------------------------------------------------------


class Reducer:
    """Drops columns that hardly vary, then one of each pair that is highly correlated."""

    def __init__(self, least_variance: float = 1e-6, most_correlation: float = 0.95):
        self.least_variance, self.most_correlation = least_variance, most_correlation
        self.kept: list[str] | None = None
        self.low_variance: list[str] = []
        self.correlated: list[str] = []

    def fit(self, x: np.ndarray, names: list[str]) -> Reducer:
        var = x.var(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
        left = [i for i in range(len(names)) if var[i] > self.least_variance] or ([int(var.argmax())] if names else [])
        self.low_variance = [names[i] for i in range(len(names)) if i not in left]
        with np.errstate(divide="ignore", invalid="ignore"):
            r = np.nan_to_num(np.abs(np.atleast_2d(np.corrcoef(x[:, left], rowvar=False))), nan=0.0)
        mean, gone = r.mean(1), set()
        for i, j in zip(*np.nonzero(np.triu(r, 1) > self.most_correlation), strict=True):
            if i not in gone and j not in gone:
                gone.add(i if mean[i] >= mean[j] else j)
        self.correlated = [names[left[i]] for i in sorted(gone)]
        self.kept = [names[k] for i, k in enumerate(left) if i not in gone]
        return self

    def columns(self, names: list[str]) -> list[int]:
        if self.kept is None:
            raise RuntimeError("fit the reducer first")
        if missing := [c for c in self.kept if c not in names]:
            raise KeyError(f"missing columns: {missing}")
        return [names.index(c) for c in self.kept]


class Scaler:
    """(x - median) / range between two percentiles; a range of 0 counts as 1."""

    def __init__(self, quantile_range: tuple[float, float] = (25.0, 75.0)):
        self.quantile_range = tuple(quantile_range)
        self.center: np.ndarray | None = None

    def fit(self, x: np.ndarray) -> Scaler:
        lo, self.center, hi = np.percentile(x, [self.quantile_range[0], 50.0, self.quantile_range[1]], axis=0)
        self.scale = np.where(hi - lo == 0, 1.0, hi - lo)
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        if self.center is None:
            raise RuntimeError("fit the scaler first")
        return (x - self.center) / self.scale


def fold_ends(n: int, train: float = 0.6, val: float = 0.1, step: float = 0.1) -> list[tuple[int, int]]:
    """(end of training, end of validation) of expanding walk-forward folds."""
    t, v, s = int(n * train), int(n * val), int(n * step)
    if n < 10 or min(t, v, s) < 1 or t + v > n:
        raise ValueError(f"too few rows: {n}")
    return [(i, i + v) for i in range(t, n - v + 1, s)]


def judged(y: np.ndarray, lower: np.ndarray, point: np.ndarray, upper: np.ndarray) -> dict[str, float]:
    """Point, interval and direction metrics."""
    e, up, said = point - y, y > 0, point > 0
    div = lambda a, b: float(a / b) if b else 0.0
    nonzero = y != 0
    precision, recall = div((up & said).sum(), said.sum()), div((up & said).sum(), up.sum())
    return {
        "rmse": float(np.sqrt((e**2).mean())),
        "mae": float(np.abs(e).mean()),
        "median_ae": float(np.median(np.abs(e))),
        "mape": float(np.abs(e[nonzero] / y[nonzero]).mean()) if nonzero.any() else 0.0,
        "picp": float(((lower <= y) & (y <= upper)).mean()),
        "mpiw": float((upper - lower).mean()),
        "direction_accuracy": float((np.sign(y) == np.sign(point)).mean()),
        "direction_precision": precision,
        "direction_recall": recall,
        "direction_f1": div(2 * precision * recall, precision + recall),
    }


# ---- trees --------------------------------------------------------------------------------------------------------


class Binner:
    """Columns as codes of up to `bins` quantile bins."""

    def __init__(self, bins: int = 64):
        self.bins = bins

    def fit(self, x: np.ndarray) -> Binner:
        self.edges = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1).astype(np.uint8) if self.edges else np.zeros((len(x), 0), np.uint8)


class Tree:
    """A regression tree on codes; splits go to the leaf that gains most (leafwise) or level by level."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]

    def _best(self, codes, g, rows, columns, bins, least, l2):
        out = (0.0, -1, 0)
        total, n = g[rows].sum(), len(rows)
        if n < 2 * least:
            return out
        base = total**2 / (n + l2)
        for c in columns:
            code = codes[rows, c]
            cg, cn = np.cumsum(np.bincount(code, g[rows], bins))[:-1], np.cumsum(np.bincount(code, minlength=bins))[:-1]
            ok = (cn >= least) & (n - cn >= least)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, cg**2 / (cn + l2) + (total - cg) ** 2 / (n - cn + l2) - base, 0.0)
            k = int(gain.argmax())
            if gain[k] > out[0] + 1e-12:
                out = (float(gain[k]), int(c), k)
        return out

    def fit(self, codes, g, value: Callable[[np.ndarray], float], bins: int, rng, depth: int = 6, leaves: int = 31, least: int = 3, l2: float = 0.0, columns: float = 1.0, leafwise: bool = False) -> Tree:
        """g: what splits separate; value: a leaf's value from its rows."""
        m = codes.shape[1]
        pick = lambda: rng.choice(m, max(1, math.ceil(m * columns)), replace=False) if columns < 1 else np.arange(m)
        rows = np.arange(len(g))
        self.value[0] = value(rows)
        open_ = [(self._best(codes, g, rows, pick(), bins, least, l2), 0, rows, 0)] if m else []
        n_leaves = 1
        while open_ and n_leaves < leaves:
            i = max(range(len(open_)), key=lambda j: open_[j][0][0]) if leafwise else 0
            (gain, c, k), node, rows, at = open_.pop(i)
            if gain <= 0 or at >= depth:
                continue
            go = codes[rows, c] <= k
            parts = rows[go], rows[~go]
            self.feature[node], self.cut[node] = c, k
            self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
            for part in parts:
                self.feature.append(-1), self.cut.append(0), self.left.append(-1), self.right.append(-1), self.value.append(value(part))
                open_.append((self._best(codes, g, part, pick(), bins, least, l2), len(self.feature) - 1, part, at + 1))
            n_leaves += 1
        return self

    def predict(self, codes: np.ndarray) -> np.ndarray:
        feature, cut, left, right, value = (np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(codes), np.int64)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = np.where(codes[inner, feature[node]] <= cut[node], left[node], right[node])


# ---- models -------------------------------------------------------------------------------------------------------


class LocalModel:
    """fit(x, y), predict(x) -> (lower, point, upper), get_params, set_params, dumps and loads."""

    name = "base"
    extension = "json"
    defaults: dict = {}

    def __init__(self, **params):
        if unknown := set(params) - set(self.defaults):
            raise TypeError(f"{self.name} has no parameters {sorted(unknown)}")
        self.params = {**self.defaults, **params}
        self.state: dict | None = None

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params) -> LocalModel:
        self.__init__(**{**self.params, **params})
        return self

    def fit(self, x: np.ndarray, y: np.ndarray, x_val: np.ndarray | None = None, y_val: np.ndarray | None = None) -> LocalModel:
        """y may have several columns (one model each)."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        checked(x, y)
        val = (None, None) if x_val is None or not len(x_val) else (np.asarray(x_val, float), np.asarray(y_val, float))
        if val[0] is not None:
            checked(*val)
        columns = y.T if y.ndim == 2 else [y]
        vals = [None] * len(columns) if val[1] is None else (val[1].T if y.ndim == 2 else [val[1]])
        self.state = {"width": x.shape[1], "outputs": 0 if y.ndim == 1 else y.shape[1], "models": [self._fit(x, c, val[0], v) for c, v in zip(columns, vals, strict=True)]}
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.state is None:
            raise RuntimeError("fit the model first")
        x = np.asarray(x, float)
        checked(x)
        if x.shape[1] != self.state["width"]:
            raise ValueError(f"{x.shape[1]} columns, fitted on {self.state['width']}")
        parts = [self._predict(m, x) for m in self.state["models"]]
        parts = [(np.minimum(lo, p), p, np.maximum(hi, p)) for lo, p, hi in parts]
        return parts[0] if not self.state["outputs"] else tuple(np.stack([p[i] for p in parts], 1) for i in range(3))

    def dumps(self) -> bytes:
        if self.state is None:
            raise RuntimeError("fit the model first")
        return json.dumps({"name": self.name, "params": self.params, "state": self.state}).encode()

    @staticmethod
    def loads(raw: bytes) -> LocalModel:
        found = json.loads(raw)
        m = REGISTRY[found["name"]](**found["params"])
        m.state = found["state"]
        return m

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.dumps())

    @staticmethod
    def load(path: str) -> LocalModel:
        with open(path, "rb") as f:
            return LocalModel.loads(f.read())


class Baseline(LocalModel):
    """The quantiles of the training targets."""

    name = "NaiveQuantiles"

    def _fit(self, x, y, x_val, y_val):
        return np.quantile(y, [LOW, 0.5, HIGH]).tolist()

    def _predict(self, m, x):
        return tuple(np.full(len(x), v) for v in m)


def binned(m: dict, x: np.ndarray) -> np.ndarray:
    b = Binner()
    b.edges = [np.array(e) for e in m["edges"]]
    return b.transform(x)


def tree_from(t: dict) -> Tree:
    out = Tree()
    out.__dict__.update(t)
    return out


class Forest(LocalModel):
    """Trees on bootstrap samples; the point is their mean, the interval the percentiles across trees."""

    name = "RandomForest"
    defaults = {"n_estimators": 500, "max_depth": None, "min_samples_split": 5, "min_samples_leaf": 3, "max_features": "sqrt", "bootstrap": True, "random_state": 42, "n_jobs": 1}

    def _fit(self, x, y, x_val, y_val):
        p, rng = self.params, np.random.default_rng(self.params["random_state"])
        b = Binner().fit(x)
        codes, n, m = b.transform(x), len(x), x.shape[1]
        share = {"sqrt": math.sqrt(m) / m if m else 1.0, None: 1.0}.get(p["max_features"], p["max_features"])
        trees = []
        for _ in range(p["n_estimators"]):
            rows = rng.integers(0, n, n) if p["bootstrap"] else np.arange(n)
            c, t = codes[rows], y[rows]
            g = t - t.mean()
            least = max(p["min_samples_leaf"], p["min_samples_split"] // 2)
            trees.append(Tree().fit(c, g, lambda r, t=t: float(t[r].mean()), 64, rng, p["max_depth"] or 64, n, least, 0.0, share).__dict__)
        return {"edges": [e.tolist() for e in b.edges], "trees": trees}

    def across(self, m: dict, x: np.ndarray) -> np.ndarray:
        """Predictions of every tree: trees x rows."""
        codes = binned(m, x)
        return np.stack([tree_from(t).predict(codes) for t in m["trees"]])

    def _predict(self, m, x):
        all_ = self.across(m, x)
        lo, hi = np.percentile(all_, [100 * LOW, 100 * HIGH], axis=0)
        return lo, all_.mean(0), hi


class QuantileBoosting(LocalModel):
    """Three boosted ensembles, one for each quantile: trees split on the loss's sign, and leaves hold the quantile of what is left."""

    name = "XGBoost"
    leafwise = False
    defaults = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_weight": 5, "reg_lambda": 1.0, "early_stopping_rounds": 50, "quantile_alpha": (LOW, 0.5, HIGH), "random_state": 42}

    def _shape(self) -> dict:
        p = self.params
        return {"depth": p["max_depth"], "leaves": 1 << 30, "least": int(p["min_child_weight"])}

    def _fit(self, x, y, x_val, y_val):
        b = Binner().fit(x)
        codes = b.transform(x)
        val = None if x_val is None else (b.transform(x_val), y_val)
        return {"edges": [e.tolist() for e in b.edges], "parts": [self._one(codes, y, val, a) for a in self.params["quantile_alpha"]]}

    def _one(self, codes, y, val, alpha):
        p, rng = self.params, np.random.default_rng(self.params["random_state"])
        base = float(np.quantile(y, alpha))
        f, trees, best, since = np.full(len(y), base), [], (np.inf, 0), 0
        fv = None if val is None else np.full(len(val[1]), base)
        for i in range(p["n_estimators"]):
            rest = y - f
            rows = rng.random(len(y)) < p["subsample"] if p["subsample"] < 1 else np.ones(len(y), bool)
            rows = rows if rows.any() else np.ones(len(y), bool)
            g, left = np.where(rest[rows] > 0, alpha, alpha - 1), rest[rows]
            t = Tree().fit(codes[rows], g, lambda r, left=left: float(p["learning_rate"] * np.quantile(left[r], alpha)), 64, rng, **self._shape(), l2=p["reg_lambda"], columns=p["colsample_bytree"], leafwise=self.leafwise)
            trees.append(t.__dict__)
            f += t.predict(codes)
            if fv is not None:
                fv += t.predict(val[0])
                e = val[1] - fv
                loss = float(np.maximum(alpha * e, (alpha - 1) * e).mean())
                best, since = ((loss, i + 1), 0) if loss < best[0] - 1e-12 else (best, since + 1)
                if since >= p["early_stopping_rounds"]:
                    break
        return {"base": base, "trees": trees if fv is None else trees[: max(1, best[1])]}

    def _predict(self, m, x):
        codes = binned(m, x)
        return tuple(part["base"] + sum((tree_from(t).predict(codes) for t in part["trees"]), np.zeros(len(x))) for part in m["parts"])


class LeafwiseBoosting(QuantileBoosting):
    """The same with leaf-wise trees."""

    name = "LightGBM"
    leafwise = True
    defaults = {"n_estimators": 300, "max_depth": -1, "learning_rate": 0.05, "num_leaves": 31, "subsample": 0.8, "colsample_bytree": 0.8, "min_child_samples": 20, "reg_lambda": 0.1, "early_stopping_rounds": 50, "quantile_alpha": (LOW, 0.5, HIGH), "random_state": 42}

    def _shape(self):
        p = self.params
        return {"depth": 1 << 30 if p["max_depth"] < 0 else p["max_depth"], "leaves": p["num_leaves"], "least": p["min_child_samples"]}


class AutoRegression(LocalModel):
    """Least squares on the target's own lags and a constant; features are not looked at.

    It stands in for an ARIMA of the same order without moving-average terms.  After the
    training series, each forecast is fed back as the next lag; the interval is the
    normal one of the forecast's variance.
    """

    name = "ARIMA"
    defaults = {"order": (2, 0, 0), "trend": "c"}

    def _fit(self, x, y, x_val, y_val):
        p, d = self.params["order"][0], self.params["order"][1]
        z = np.diff(y, d) if d else y
        constant = self.params["trend"] == "c"
        if len(z) < 2 * p + 3:
            raise ValueError("too few rows")
        a = np.column_stack([*([np.ones(len(z) - p)] if constant else []), *(z[p - k - 1 : len(z) - k - 1] for k in range(p))])
        coef, *_ = np.linalg.lstsq(a, z[p:], rcond=None)
        e = z[p:] - a @ coef
        return {"coef": coef.tolist(), "sigma": float(np.sqrt((e**2).sum() / max(1, len(e) - len(coef)))), "last": z[len(z) - p :].tolist(), "tails": [float(np.diff(y, k)[-1]) for k in range(d)], "constant": constant}

    def _predict(self, m, x):
        p, last = len(m["last"]), list(m["last"])
        c, phi = (m["coef"][0], m["coef"][1:]) if m["constant"] else (0.0, m["coef"])
        psi, out, spread, var = [1.0], [], [], 0.0
        for _ in range(len(x)):
            last.append(c + sum(w * last[-k - 1] for k, w in enumerate(phi)))
            out.append(last[-1])
            var += psi[-1] ** 2
            spread.append(m["sigma"] * math.sqrt(var))
            psi.append(sum(w * psi[-k - 1] for k, w in enumerate(phi) if k < len(psi)))
        point, half = np.array(out), 1.6448536269514722 * np.array(spread)
        for tail in reversed(m["tails"]):
            point = tail + np.cumsum(point)
        assert len(last) == p + len(x)
        return point - half, point, point + half


REGISTRY: dict[str, type[LocalModel]] = {m.name: m for m in (Baseline, Forest, QuantileBoosting, LeafwiseBoosting, AutoRegression)}


def make(name: str, **params) -> LocalModel:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


def register(model: type[LocalModel]) -> None:
    """Make another model known by its name."""
    REGISTRY[model.name] = model
