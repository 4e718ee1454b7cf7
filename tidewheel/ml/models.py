"""Forecasting models behind one interface, their registry, and the walk-forward run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.ml.evaluate import average_folds, metrics
from tidewheel.ml.prepare import FeatureReducer, RobustScaler, fold_table, folded, valid_rows

CONFIDENCE = 0.90


@dataclass
class FitResult:
    training_time_seconds: float
    model_size_bytes: int


def checked(df: DataFrame, columns: list[str]) -> None:
    """Raise on an empty table or a missing value."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in columns)).first()
    if not row["n"]:
        raise ValueError("no rows")
    if missing := [c for c in columns if row[c]]:
        raise ValueError(f"missing values in {missing}")


class Forecaster:
    """fit, predict (point, lower, upper), save and load."""

    name = "base"

    def __init__(self, **params):
        self.params = dict(params)
        self.model = None

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params) -> Forecaster:
        self.params |= params
        return self

    def fit(self, train: DataFrame, features: list[str], target: str) -> FitResult:
        checked(train, [*features, target])
        began = time.time()
        self._fit(train, features, target)
        return FitResult(time.time() - began, self.size())

    def predict(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the model first")
        return self._predict(df)

    def size(self) -> int:
        return 0

    def save(self, path: str) -> None:
        """Model, parameters, features and interval in a folder of their own, on any storage that Spark writes to."""
        if self.model is None:
            raise RuntimeError("fit the model first")
        meta = {"name": self.name, "params": self.params, "features": getattr(self, "features", []), "model": self._state()}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        self._save_model(f"{path}/model")

    @staticmethod
    def load(path: str) -> Forecaster:
        """The model that was saved at path, whatever its kind."""
        meta = json.loads(SparkSession.getActiveSession().read.text(f"{path}/meta").first()["value"])
        m = make(meta["name"], **meta["params"])
        m.features = meta["features"]
        m.model = m._load_model(f"{path}/model", meta["model"])
        return m

    def _state(self):
        return self.model

    def _save_model(self, path: str) -> None:
        pass

    def _load_model(self, path: str, state):
        return state


class NaiveQuantiles(Forecaster):
    """The quantiles of the training targets."""

    name = "NaiveQuantiles"

    def _fit(self, train, features, target):
        a = (1 - CONFIDENCE) / 2
        q = train.agg(F.percentile(target, F.array(F.lit(a), F.lit(0.5), F.lit(1 - a)))).first()[0]
        self.model = {"lower": q[0], "point": q[1], "upper": q[2]}

    def _predict(self, df):
        return df.withColumns({k: F.lit(v) for k, v in self.model.items()})

    def size(self) -> int:
        return 24


class Trees(Forecaster):
    """A Spark ML regressor on assembled features; the interval is the range of training residuals around the point.

    With `conformal` rows held back at the end of training (a share), the
    residuals are those of rows that the model has not seen.
    """

    def _regressor(self, target):
        raise NotImplementedError

    def _fit(self, train, features, target):
        self.features = list(features)
        assembler = VectorAssembler(inputCols=self.features, outputCol="_x")
        share = self.params.get("conformal", 0.2)
        cut = train.select(F.percentile(F.unix_micros(F.col("ts").cast("timestamp")), 1 - share)).first()[0] if "ts" in train.columns else None
        when = F.unix_micros(F.col("ts").cast("timestamp")) if cut is not None else None
        early = train.where(when <= cut) if cut is not None else train
        late = train.where(when > cut) if cut is not None else train
        stage = self._regressor(target).fit(assembler.transform(early))
        self.model = PipelineModel([assembler, stage])
        a = (1 - CONFIDENCE) / 2
        q = self.model.transform(late).agg(F.percentile(F.col(target) - F.col("_p"), F.array(F.lit(a), F.lit(1 - a)))).first()[0] or [0.0, 0.0]
        self.params |= {"low": min(q[0], 0.0), "high": max(q[1], 0.0)}

    def _predict(self, df):
        out = self.model.transform(df).withColumnRenamed("_p", "point")
        return out.withColumns({"lower": F.col("point") + self.params["low"], "upper": F.col("point") + self.params["high"]}).drop("_x")

    def size(self) -> int:
        return sum(t.numNodes for t in self.model.stages[-1].trees) * 32

    def _state(self):
        return None

    def _save_model(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def _load_model(self, path: str, state):
        return PipelineModel.load(path)


class RandomForest(Trees):
    """A forest; the interval holds the middle 90 percent of the trees' own predictions."""

    name = "RandomForest"

    def _regressor(self, target):
        return RandomForestRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", numTrees=self.params.get("trees", 50), maxDepth=self.params.get("depth", 6), seed=self.params.get("seed", 42))

    def _predict(self, df):
        """The forest as arrays of nodes, walked for each row in Arrow batches: a value for each tree, and their percentiles."""
        trees, features = [nodes_of(t._java_obj.rootNode()) for t in self.model.stages[-1].trees], list(self.features)
        low, high = 50 * (1 - CONFIDENCE), 100 - 50 * (1 - CONFIDENCE)

        def ask(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for cols in columns:
                x = np.stack([c.to_numpy(float) for c in cols], 1)
                all_ = np.stack([walked(t, x) for t in trees])
                lo, hi = np.percentile(all_, [low, high], axis=0)
                p = all_.mean(0)
                yield pd.DataFrame({"point": p, "lower": np.minimum(lo, p), "upper": np.maximum(hi, p)})

        udf = F.pandas_udf(ask, "point double, lower double, upper double")
        return df.withColumn("_f", udf(*(F.col(f"`{c}`").cast("double") for c in features))).select(*(F.col(f"`{c}`") for c in df.columns), "_f.*")


def nodes_of(node, out: list | None = None) -> list[tuple[int, float, int, int, float]]:
    """A tree of Spark ML as rows (feature, threshold, left, right, value); feature -1 for leaves."""
    out = [] if out is None else out
    at = len(out)
    out.append((-1, 0.0, -1, -1, node.prediction()))
    if node.subtreeDepth() > 0:
        split = node.split()
        left = len(out)
        nodes_of(node.leftChild(), out)
        right = len(out)
        nodes_of(node.rightChild(), out)
        out[at] = (split.featureIndex(), split.threshold(), left, right, node.prediction())
    return out


def walked(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """Each row's value in a tree of nodes_of."""
    feature, threshold, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return value[at]
        node = at[inner]
        at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])


class GradientBoosting(Trees):
    name = "GradientBoosting"

    def _regressor(self, target):
        return GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", maxIter=self.params.get("rounds", 30), maxDepth=self.params.get("depth", 4), seed=self.params.get("seed", 42))


REGISTRY: dict[str, Callable[..., Forecaster]] = {m.name: m for m in (NaiveQuantiles, RandomForest, GradientBoosting)}


def make(name: str, **params) -> Forecaster:
    if name not in REGISTRY:
        raise KeyError(f"unknown model {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


def register(name: str, factory: Callable[..., Forecaster]) -> None:
    REGISTRY[name] = factory


def walk_forward(df: DataFrame, symbol: str, model: str, features: list[str], target: str, params: dict | None = None, embargo: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and judge one model of one symbol on every fold: (metrics by fold, their average).

    Reducer and scaler are fitted on the fold's training rows alone.
    """
    spark = df.sparkSession
    rows = valid_rows(df.where(F.col("symbol") == symbol), features, target)
    sizes = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    folds = folded(rows, fold_table(sizes, embargo=embargo)).cache()
    out = []
    for k in sorted(r["fold"] for r in folds.select("fold").distinct().collect()):
        train, val = (folds.where((F.col("fold") == k) & (F.col("part") == p)) for p in ("train", "val"))
        reducer = FeatureReducer().fit(train, features)
        scaler = RobustScaler().fit(train, reducer.kept)
        m = make(model, **(params or {}))
        fitted = m.fit(scaler.transform(train), reducer.kept, target)
        began = time.time()
        r = metrics(m.predict(scaler.transform(val)).withColumnRenamed(target, "y"), ["symbol"]).first().asDict()
        out.append(r | {"fold": k, "model": model, "training_time_seconds": fitted.training_time_seconds, "inference_time_seconds": time.time() - began, "model_size_bytes": fitted.model_size_bytes})
    folds.unpersist()
    by_fold = spark.createDataFrame(out)
    return by_fold, average_folds(by_fold, ["symbol", "model"], "fold")
