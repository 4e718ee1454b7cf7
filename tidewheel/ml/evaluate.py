"""Forecast metrics, scores and the choice of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: weights of the composite score
WEIGHTS = {"accuracy": 0.40, "interval": 0.35, "direction": 0.20, "efficiency": 0.05}


def metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """Point, interval and direction metrics of rows with y, point, lower and upper."""
    e = F.col("point") - F.col("y")
    up, said = F.col("y") > 0, F.col("point") > 0
    tp, fp, fn = F.count_if(up & said), F.count_if(~up & said), F.count_if(up & ~said)
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    d = pred.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.percentile(F.abs(e), 0.5).alias("median_ae"),
        F.avg(F.abs(e / F.nullif(F.col("y"), F.lit(0.0)))).alias("mape"),
        F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("picp"),
        F.avg(F.col("upper") - F.col("lower")).alias("mpiw"),
        F.avg((F.signum("y") == F.signum("point")).cast("double")).alias("direction_accuracy"),
        div(tp, tp + fp).alias("direction_precision"),
        div(tp, tp + fn).alias("direction_recall"),
    )
    p, r = F.col("direction_precision"), F.col("direction_recall")
    return d.withColumn("direction_f1", div(2 * p * r, p + r))


def average_folds(m: DataFrame, by: list[str], order: str) -> DataFrame:
    """Means over folds or horizons; training times are added up and the last model's size counts."""
    special = {"training_time_seconds": F.sum("training_time_seconds"), "model_size_bytes": F.max_by("model_size_bytes", order)}
    numbers = [c for c, t in m.dtypes if t in ("double", "float", "bigint", "int") and c not in [*by, order, *special]]
    return m.groupBy(*by).agg(*(F.avg(c).alias(c) for c in numbers), *(x.alias(k) for k, x in special.items() if k in m.columns))


def composite_score(m: DataFrame, group: list[str], confidence: float = 0.90, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Add score: each part is scaled to 0..1 among the models of a group (1 is best; 1 for all if they are equal)."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    w = Window.partitionBy(*group)

    def best(c, low: bool):
        c = c if not isinstance(c, str) else F.col(c)
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        x = (c - lo) / F.nullif(hi - lo, F.lit(0.0))
        return F.coalesce(1 - x if low else x, F.lit(1.0))

    miss = F.abs(F.col("picp") - confidence)
    parts = {
        "accuracy": (best("rmse", True) + best("mae", True)) / 2,
        "interval": (best(miss, True) + best("mpiw", True)) / 2,
        "direction": best("direction_accuracy", False),
        "efficiency": best("training_time_seconds", True),
    }
    return m.withColumn("score", sum((parts[k] * v for k, v in weights.items()), F.lit(0.0)))


def ranked(m: DataFrame, group: list[str]) -> DataFrame:
    """Add place and is_winner, the best score first and equal ones by model name."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "model")
    return m.withColumn("place", F.row_number().over(w)).withColumn("is_winner", F.col("place") == 1)


def price_interval(df: DataFrame, price: str = "ref_price") -> DataFrame:
    """Prices from log returns: lower, median and upper."""
    return df.withColumns({f"{k}_price": F.col(price) * F.exp(F.col(c)) for k, c in (("lower", "lower"), ("median", "point"), ("upper", "upper"))})


def naive_quantiles(train: DataFrame, target: str, by: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The baseline forecast: quantiles of the training targets."""
    q = F.percentile(target, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return train.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("lower"), F.col("q")[1].alias("point"), F.col("q")[2].alias("upper"))
