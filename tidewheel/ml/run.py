"""The experiment: every symbol, model and horizon, with artifacts in a table; selection, prediction and explanation from it.

A task takes the rows of one symbol and one model.  It returns a row for each horizon:
metrics averaged over walk-forward folds, and the model, scaler and reducer refitted on
all rows.  A failure is a row too.  Finished pairs of symbol and model are found in the
table, so a run that was stopped goes on with the others.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.config import ExperimentConfig, config_hash
from tidewheel.ml import local
from tidewheel.ml.evaluate import average_folds, composite_score, price_interval, ranked
from tidewheel.ml.prepare import targets
from tidewheel.sources.candles import read_or_empty

#: fixed values: the metrics of a record, and their names in metric functions
METRICS = {"rmse": "rmse", "mae": "mae", "median_ae": "median_ae", "mape": "mape", "picp": "picp", "mpiw": "mpiw", "dir_accuracy": "direction_accuracy", "dir_precision": "direction_precision", "dir_recall": "direction_recall", "dir_f1": "direction_f1"}
RECORD = "experiment string, timestamp string, symbol string, model string, horizon int, " + ", ".join(f"{c} double" for c in METRICS) + ", train_time_s double, inference_time_s double, model_size_bytes bigint"
RESULT = RECORD + ", status string, message string, n_rows bigint, n_folds int, meta string, artifact binary, scaler string, reducer string"
#: columns of feature tables that are no features
KEYS = ("symbol", "ts", "ref_price")


def scrubbed(message: str) -> str:
    """One line without commas."""
    return " ".join(message.replace(",", ";").split())[:500]


def prepared(x: np.ndarray, names: list[str], c: ExperimentConfig):
    reducer = local.Reducer(c.reduction.variance_threshold, c.reduction.correlation_threshold).fit(x, names)
    at = reducer.columns(names)
    return reducer, at, local.Scaler(c.scaling.quantile_range).fit(x[:, at])


def run_one(x: np.ndarray, y: np.ndarray, names: list[str], model: str, c: ExperimentConfig) -> dict:
    """Folds, averages and the refitted model of one symbol, model and horizon; rows without a value are left out."""
    ok = np.isfinite(y) & np.isfinite(x).all(1)
    x, y = x[ok], y[ok]
    if not len(y):
        raise ValueError("no row has the target and all features")
    v, out, trained, asked, size = c.validation, [], 0.0, [], 0
    params = {k: p for k, p in (c.model_params.get(model) or {}).items() if k in local.REGISTRY[model].defaults} if model in local.REGISTRY else {}
    for end, stop in local.fold_ends(len(y), v.min_train_ratio, v.val_size_ratio, v.step_size_ratio):
        _, at, scaler = prepared(x[:end], names, c)
        train, val = scaler.transform(x[:end][:, at]), scaler.transform(x[end:stop][:, at])
        began = time.perf_counter()
        m = local.make(model, **params).fit(train, y[:end], val, y[end:stop])
        trained += time.perf_counter() - began
        began = time.perf_counter()
        out.append(local.judged(y[end:stop], *m.predict(val)))
        asked.append(time.perf_counter() - began)
        size = len(m.dumps())
    reducer, at, scaler = prepared(x, names, c)
    final = local.make(model, **params).fit(scaler.transform(x[:, at]), y)
    return {
        **{k: float(np.mean([f[source] for f in out])) for k, source in METRICS.items()},
        "train_time_s": trained,
        "inference_time_s": float(np.mean(asked)),
        "model_size_bytes": size,
        "n_rows": len(y),
        "n_folds": len(out),
        "artifact": final.dumps(),
        "scaler": json.dumps({"range": list(scaler.quantile_range), "center": scaler.center.tolist(), "scale": scaler.scale.tolist()}),
        "reducer": json.dumps({"kept": reducer.kept, "low_variance": reducer.low_variance, "correlated": reducer.correlated}),
    }


def feature_names(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in KEYS and not c.startswith("log_return_") and t in ("double", "float", "int", "bigint")]


def trained(features: DataFrame, pairs: DataFrame, config: ExperimentConfig, experiment: str) -> DataFrame:
    """Results (columns RESULT) of pairs (symbol, model) over the configured horizons.  features: symbol, ts, price and features."""
    names = feature_names(features)
    rows = targets(features, tuple(config.target.horizons), config.target.steps_per_day, config.target.price_column, check=False).drop("ref_price")
    rows = rows.select("symbol", "ts", *(F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)), *(f"log_return_{h}d" for h in config.target.horizons))
    columns = [x.split()[0] for x in RESULT.split(", ")]
    whole = config_hash(config)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, model = key
        pdf = pdf.sort_values("ts")
        x, out = pdf[[f"x{i}" for i in range(len(names))]].to_numpy(float), []
        for h in config.target.horizons:
            row = dict.fromkeys(columns) | {"experiment": experiment, "timestamp": datetime.now(timezone.utc).isoformat(), "symbol": symbol, "model": model, "horizon": h, "status": "ok", "message": ""}
            try:
                row |= run_one(x, pdf[f"log_return_{h}d"].to_numpy(float), names, model, config)
                row["meta"] = json.dumps({"symbol": symbol, "model_name": model, "horizon": h, "features": names, "confidence_level": config.scoring.confidence_level, "config_hash": whole})
            except Exception as e:  # one pair's failure is its row; the others go on
                row |= {"status": "failed", "message": scrubbed(f"{type(e).__name__}: {e}")}
            out.append(row)
        return pd.DataFrame(out, columns=columns)

    few = F.broadcast(pairs.select(F.col("symbol").alias("_s"), "model"))  # names only: symbols x models
    return rows.join(few, rows["symbol"] == few["_s"]).drop("_s").groupBy("symbol", "model").applyInPandas(work, RESULT)


def results(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, f"{path}/results", RESULT)


def run(features: DataFrame, config: ExperimentConfig, path: str, experiment: str, at_once: int = 64) -> DataFrame:
    """Train what is left of an experiment, `at_once` symbols at a time, and return all its results so far.

    A pair is finished when every horizon is ok; failed ones are tried again.  Symbols
    that are configured but have no rows get a failed row.
    """
    spark = features.sparkSession
    models = config.models or sorted(local.REGISTRY)
    have = {r["symbol"] for r in features.select("symbol").distinct().collect()}  # a name for each symbol
    wanted = config.coins or sorted(have)
    done = results(spark, path).where((F.col("experiment") == experiment) & (F.col("status") == "ok")).groupBy("symbol", "model").agg(F.countDistinct("horizon").alias("n"))
    finished = {(r["symbol"], r["model"]) for r in done.where(F.col("n") >= len(config.target.horizons)).collect()}
    left = [(s, m) for s in wanted for m in models if (s, m) not in finished]
    lost = [(experiment, s, m, h, "failed", "no feature rows") for s, m in left if s not in have for h in config.target.horizons]
    if lost:
        gone = spark.createDataFrame(lost, "experiment string, symbol string, model string, horizon int, status string, message string")
        read_or_empty(spark, f"{path}/none", RESULT).unionByName(gone, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(f"{path}/results")
    symbols = sorted({s for s, _ in left if s in have})
    for i in range(0, len(symbols), at_once):
        some = set(symbols[i : i + at_once])
        pairs = spark.createDataFrame([p for p in left if p[0] in some], "symbol string, model string")
        trained(features.where(F.col("symbol").isin(*some)), pairs, config, experiment).write.mode("append").parquet(f"{path}/results")
    return latest(results(spark, path).where(F.col("experiment") == experiment))


def latest(found: DataFrame) -> DataFrame:
    """The newest row of each symbol, model and horizon, an ok one first."""
    w = Window.partitionBy("symbol", "model", "horizon").orderBy((F.col("status") == "ok").desc(), F.col("timestamp").desc_nulls_last())
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def failures(found: DataFrame) -> DataFrame:
    return found.where("status <> 'ok'").select("experiment", "timestamp", "symbol", "model", "horizon", "message")


def selected(found: DataFrame, config: ExperimentConfig | None = None) -> DataFrame:
    """Models of each symbol by composite score of their metrics averaged over horizons: place and is_winner.

    No finished result raises.
    """
    config = config or ExperimentConfig()
    ok = found.where("status = 'ok'")
    if ok.isEmpty():
        raise ValueError("no results to select from")
    m = ok.select("symbol", "model", "horizon", *(F.col(k).alias(v) for k, v in METRICS.items()), F.col("train_time_s").alias("training_time_seconds"), F.col("inference_time_s").alias("inference_time_seconds"), "model_size_bytes")
    mean = average_folds(m, ["symbol", "model"], "horizon")
    return ranked(composite_score(mean, ["symbol"], config.scoring.confidence_level, config.scoring.weights()), ["symbol"])


def production(found: DataFrame, ranking: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The winners' results, and those of the others, to be archived."""
    best = ranking.where("is_winner").select(F.col("symbol").alias("_s"), F.col("model").alias("_m"))
    j = found.where("status = 'ok'").join(best, (F.col("symbol") == F.col("_s")) & (F.col("model") == F.col("_m")), "left").withColumn("_w", F.col("_s").isNotNull()).drop("_s", "_m")
    return j.where("_w").drop("_w"), j.where("not _w").drop("_w")


def predicted(winners: DataFrame, features: DataFrame, horizon: int, price: str = "close") -> DataFrame:
    """symbol, model, horizon, ts, ref_price, lower, point, upper and prices, from each symbol's last row with all features.

    A symbol without a model of the horizon has no row; see `missing_models`.
    """
    names = feature_names(features)
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    whole = features.na.drop("any", subset=names)
    last = whole.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    cells = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{n}`").cast("double") for n in names)))
    last = last.select(F.col("symbol").alias("_s"), "ts", F.col(price).cast("double").alias("ref_price"), cells.alias("cells"))
    own = winners.where(F.col("horizon") == horizon).select("symbol", "model", "horizon", "artifact", "scaler", "reducer")
    rows = own.join(last, own["symbol"] == last["_s"]).drop("_s")

    def ask(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                kept, scale = json.loads(r.reducer)["kept"], json.loads(r.scaler)
                cells = dict(r.cells)
                x = (np.array([[cells[k] for k in kept]]) - np.array(scale["center"])) / np.array(scale["scale"])
                lo, point, hi = local.LocalModel.loads(r.artifact).predict(x)
                out.append((r.symbol, r.model, r.horizon, r.ts, r.ref_price, float(lo[-1]), float(point[-1]), float(hi[-1])))
            yield pd.DataFrame(out, columns=["symbol", "model", "horizon", "ts", "ref_price", "lower", "point", "upper"])

    return price_interval(rows.mapInPandas(ask, "symbol string, model string, horizon int, ts timestamp_ntz, ref_price double, lower double, point double, upper double"))


def missing_models(winners: DataFrame, symbols: DataFrame, horizon: int) -> DataFrame:
    """The symbols that have no model of the horizon."""
    return symbols.select("symbol").distinct().join(winners.where(F.col("horizon") == horizon).select("symbol"), "symbol", "left_anti")


# ---- explanation --------------------------------------------------------------------------------------------------

#: fixed values: groups of features that are left out one at a time
GROUPS = {"ohlcv": ["open", "high", "low", "close", "volume"], "returns": ["Return_1h", "Return_3h", "Return_6h", "Return_12h", "Return_24h"], "trend": ["SMA_10", "SMA_20", "SMA_50", "EMA_20", "EMA_50"]}
EXPLAINED = "symbol string, model string, kind string, name string, value double"


def explained(winners: DataFrame, features: DataFrame, config: ExperimentConfig, horizon: int, repeats: int = 3, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """By symbol: permutation importance of each kept feature (kind 'permutation') and the loss from each group left out ('ablation').

    Importance is the growth of the root mean square error over the last fold's rows
    when a feature's values are shuffled (seeded).  A group's value is the growth when the
    model is fitted without its features.
    """
    names, groups, h = feature_names(features), groups or GROUPS, horizon
    rows = targets(features, (h,), config.target.steps_per_day, config.target.price_column, check=False)
    rows = rows.select("symbol", "ts", *(F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)), F.col(f"log_return_{h}d").alias("y"))
    own = winners.where(F.col("horizon") == horizon).select(F.col("symbol").alias("_s"), "model")

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, model = key
        pdf = pdf.sort_values("ts").dropna()
        x, y = pdf[[f"x{i}" for i in range(len(names))]].to_numpy(float), pdf["y"].to_numpy(float)
        v = config.validation
        end, stop = local.fold_ends(len(y), v.min_train_ratio, v.val_size_ratio, v.step_size_ratio)[-1]
        params = {k: p for k, p in (config.model_params.get(model) or {}).items() if k in local.REGISTRY[model].defaults}

        def fitted(columns: list[int]):
            own = [names[i] for i in columns]
            reducer, at, scaler = prepared(x[:end][:, columns], own, config)
            at = [columns[i] for i in at]
            m = local.make(model, **params).fit(scaler.transform(x[:end][:, at]), y[:end])
            return m, at, scaler

        loss = lambda m, z: float(np.sqrt(((m.predict(z)[1] - y[end:stop]) ** 2).mean()))
        m, at, scaler = fitted(list(range(len(names))))
        val = scaler.transform(x[end:stop][:, at])
        base, out, rng = loss(m, val), [], np.random.default_rng(config.training.seed)
        for k, i in enumerate(at):
            worse = []
            for _ in range(repeats):
                z = val.copy()
                z[:, k] = rng.permutation(z[:, k])
                worse.append(loss(m, z) - base)
            out.append((symbol, model, "permutation", names[i], float(np.mean(worse))))
        for g, members in groups.items():
            rest = [i for i, n in enumerate(names) if n not in members]
            if rest and len(rest) < len(names):
                m2, at2, s2 = fitted(rest)
                out.append((symbol, model, "ablation", g, loss(m2, s2.transform(x[end:stop][:, at2])) - base))
        return pd.DataFrame(out, columns=["symbol", "model", "kind", "name", "value"])

    return rows.join(F.broadcast(own), rows["symbol"] == own["_s"]).drop("_s").groupBy("symbol", "model").applyInPandas(work, EXPLAINED)


# ---- search -------------------------------------------------------------------------------------------------------

#: fixed values: kind and range of each parameter
SEARCH_SPACES = {
    "XGBoost": {
        "n_estimators": ("int", 100, 3000),
        "max_depth": ("int", 3, 12),
        "learning_rate": ("log_float", 0.005, 0.3),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.3, 1.0),
        "min_child_weight": ("int", 1, 30),
        "reg_alpha": ("log_float", 1e-8, 10.0),
        "reg_lambda": ("log_float", 1e-8, 10.0),
    },
    "LightGBM": {
        "n_estimators": ("int", 100, 3000),
        "max_depth": ("int", -1, 15),
        "learning_rate": ("log_float", 0.005, 0.3),
        "num_leaves": ("int", 15, 255),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.3, 1.0),
        "min_child_samples": ("int", 5, 100),
        "reg_alpha": ("log_float", 1e-8, 10.0),
        "reg_lambda": ("log_float", 1e-8, 10.0),
    },
    "RandomForest": {
        "n_estimators": ("int", 100, 1000),
        "min_samples_split": ("int", 2, 20),
        "min_samples_leaf": ("int", 1, 10),
    },
    "TFT": {
        "hidden_size": ("int", 16, 128),
        "learning_rate": ("log_float", 1e-4, 1e-2),
        "dropout": ("float", 0.05, 0.3),
    },
    "PatchTST": {
        "d_model": ("int", 32, 128),
        "n_heads": ("int", 2, 8),
        "learning_rate": ("log_float", 1e-4, 1e-2),
    },
}


def drawn(space: dict[str, tuple], rng: np.random.Generator) -> dict:
    """One random choice from a space."""
    out = {}
    for k, (kind, lo, hi) in space.items():
        if kind == "int":
            out[k] = int(rng.integers(lo, hi + 1))
        else:
            out[k] = float(np.exp(rng.uniform(np.log(lo), np.log(hi))) if kind == "log_float" else rng.uniform(lo, hi))
    return out


def tuned(features: DataFrame, config: ExperimentConfig, model: str, horizon: int, trials: int = 20, space: dict[str, tuple] | None = None) -> DataFrame:
    """symbol, trial, params (JSON), rmse of random choices from the model's space, judged on walk-forward folds; trials run in parallel."""
    known = local.REGISTRY[model].defaults
    rng = np.random.default_rng(config.training.seed)
    space = {k: v for k, v in (space or SEARCH_SPACES[model]).items() if k in known}
    choices = F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(json.dumps(drawn(space, rng))).alias("params")) for i in range(trials)))
    names = feature_names(features)
    rows = targets(features, (horizon,), config.target.steps_per_day, config.target.price_column, check=False)
    rows = rows.select("symbol", "ts", *(F.col(f"`{n}`").cast("double").alias(f"x{i}") for i, n in enumerate(names)), F.col(f"log_return_{horizon}d").alias("y"))

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        symbol, trial, params = key
        pdf = pdf.sort_values("ts")
        from dataclasses import replace

        own = replace(config, model_params={model: {**(config.model_params.get(model) or {}), **json.loads(params)}})
        try:
            r = run_one(pdf[[f"x{i}" for i in range(len(names))]].to_numpy(float), pdf["y"].to_numpy(float), names, model, own)["rmse"]
        except ValueError:  # a choice that does not fit the data has no score
            r = None
        return pd.DataFrame([(symbol, trial, params, r)], columns=["symbol", "trial", "params", "rmse"])

    return rows.withColumn("c", F.explode(choices)).select("*", "c.*").drop("c").groupBy("symbol", "trial", "params").applyInPandas(work, "symbol string, trial int, params string, rmse double")
