"""Targets, walk-forward folds, feature reduction and robust scaling."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (1, 7, 14, 30, 90)


def targets(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, steps_per_day: int = 24, price: str = "close", check: bool = True) -> DataFrame:
    """Add log_return_{h}d, the log return to h days ahead, and ref_price.

    Horizons and steps have to be positive and the price column has to be there;
    with check, prices at or below zero raise with their count (an action).
    Without, they give null.
    """
    if not horizons or min(horizons) <= 0 or steps_per_day <= 0:
        raise ValueError("horizons and steps_per_day must be positive")
    if price not in df.columns:
        raise KeyError(f"no column {price}")
    if check and (bad := df.where(F.col(price) <= 0).count()):
        raise ValueError(f"{bad} prices are not positive")
    w = Window.partitionBy("symbol").orderBy("ts")
    p = F.when(F.col(price) > 0, F.col(price))
    df = df.withColumn("ref_price", F.col(price))
    return df.withColumns({f"log_return_{h}d": F.ln(F.lead(p, h * steps_per_day).over(w) / p) for h in horizons})


def valid_rows(df: DataFrame, features: list[str], target: str, check: bool = False) -> DataFrame:
    """Rows whose target and features are all there; with check, none left raises (an action)."""
    out = df.na.drop("any", subset=[*features, target])
    if check and out.isEmpty():
        raise ValueError(f"no row has {target} and all of {len(features)} features")
    return out


def fold_table(sizes: DataFrame, train: float | int = 0.6, val: float | int = 0.1, step: float | int = 0.1, embargo: int = 0) -> DataFrame:
    """Expanding walk-forward folds of each symbol (symbol, n): fold, train_end, val_start, val_end as row numbers.

    Shares below 1 are taken of n and rounded down.  Fewer than 10 rows, or a
    training set, validation set or step without rows, raise.  embargo rows
    before the validation set are left out of training.
    """
    if isinstance(train, float) and isinstance(val, float) and train + val > 1:
        raise ValueError("train and val exceed the data")
    n = F.col("n")
    take = lambda x: F.floor(n * x) if isinstance(x, float) else F.lit(x).cast("bigint")
    s = sizes.select("symbol", "n", take(train).alias("t"), take(val).alias("v"), take(step).alias("s"))
    ok = (n >= 10) & (F.col("t") >= 1) & (F.col("v") >= 1) & (F.col("s") >= 1) & (F.col("t") + F.col("v") <= n)
    s = s.withColumn("t", F.when(ok, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("too few rows: "), F.col("symbol"))).cast("bigint")))
    f = s.select("symbol", "v", F.posexplode(F.sequence(F.col("t"), n - F.col("v"), F.col("s"))).alias("fold", "end"))
    return f.select("symbol", "fold", (F.col("end") - embargo).alias("train_end"), F.col("end").alias("val_start"), (F.col("end") + F.col("v")).alias("val_end"))


def folded(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Every row in every fold that uses it, with part 'train' or 'val'.  The folds are few rows a symbol."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    d = df.withColumn("_i", i)
    f = folds.withColumnRenamed("symbol", "_s")
    j = d.join(f, (d["symbol"] == f["_s"]) & (F.col("_i") < F.col("val_end")))
    part = F.when(F.col("_i") < F.col("train_end"), "train").when(F.col("_i") >= F.col("val_start"), "val")
    return j.withColumn("part", part).where("part is not null").drop("_s", "_i", "train_end", "val_start", "val_end")


def variances(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, variance (of a sample; null counts as 0)."""
    row = df.agg(*(F.coalesce(F.var_samp(c), F.lit(0.0)).alias(c) for c in features))
    return row.select(F.expr(f"stack({len(features)}, " + ", ".join(f"'{c}', `{c}`" for c in features) + ") as (feature, variance)"))


def product_sums(df: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows without a missing feature, their means, sums of products around the means, and a shift; one pass.

    Each Arrow batch gives one row with its own means and products, which are put together
    pairwise here: a row for each task, of a size that follows from the features alone.
    """
    k = len(features)

    def run(batches):
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns], 1)
            n, mean, m2 = merged_sums((n, mean, m2), (len(x), x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)))) if len(x) else (n, mean, m2)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([m2.ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "m2"])

    whole = df.select(*(F.col(f"`{c}`").cast("double") for c in features)).na.drop()
    total = (0, np.zeros(k), np.zeros((k, k)))
    for r in whole.mapInArrow(run, "n bigint, mean array<double>, m2 array<double>").toLocalIterator():
        total = merged_sums(total, (r["n"], np.array(r["mean"]), np.array(r["m2"]).reshape(k, k)))
    return total


def merged_sums(a, b):
    """Rows, means and products of two sets of rows taken together."""
    (na, ma, ca), (nb, mb, cb) = a, b
    if not na or not nb:
        return b if nb else a
    n, d = na + nb, mb - ma
    return n, ma + d * nb / n, ca + cb + np.outer(d, d) * (na * nb / n)


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """Absolute Pearson correlations of all features over rows that miss none of them; 0 where one does not vary."""
    _, _, m2 = product_sums(df, features)
    sd = np.sqrt(np.diag(m2))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(m2 / np.outer(sd, sd))
    return np.where(np.isfinite(r), r, 0.0)


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """f1, f2, r: absolute Pearson correlations of all pairs f1 before f2, in one pass (0 where one does not vary)."""
    r = correlation_matrix(df, features) if features else np.zeros((0, 0))
    pairs = [(a, b, float(r[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame(pairs, "f1 string, f2 string, r double")


@dataclass
class FeatureReducer:
    """Drops features that hardly vary, then one of each pair that is highly correlated."""

    least_variance: float = 1e-6
    most_correlation: float = 0.95
    kept: list[str] = field(default_factory=list)
    low_variance: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str, float]] = field(default_factory=list)
    fitted: bool = False

    def fit(self, df: DataFrame, features: list[str]) -> FeatureReducer:
        var = {r["feature"]: r["variance"] for r in variances(df, features).collect()}
        self.low_variance = [c for c in features if var[c] <= self.least_variance]
        left = [c for c in features if c not in self.low_variance]
        if not left and features:
            best = max(features, key=lambda c: var[c])
            self.low_variance.remove(best)
            left = [best]
        m = correlation_matrix(df, left)
        r = {(a, b): float(m[i, j]) for i, a in enumerate(left) for j, b in enumerate(left) if i < j}
        mean = dict(zip(left, m.mean(1).tolist(), strict=True))
        gone: set[str] = set()
        self.pairs = []
        for (a, b), v in ((p, r[p]) for i, x in enumerate(left) for p in ((x, y) for y in left[i + 1 :])):
            if v > self.most_correlation:
                self.pairs.append((a, b, v))  # every pair above the threshold is on record
                if a not in gone and b not in gone:
                    gone.add(a if mean[a] >= mean[b] else b)
        self.correlated = [c for c in left if c in gone]
        self.kept = [c for c in left if c not in gone]
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise RuntimeError("fit the reducer first")
        if missing := [c for c in self.kept if c not in df.columns]:
            raise KeyError(f"missing columns: {missing}")
        return df.drop(*self.low_variance, *self.correlated)

    def fit_transform(self, df: DataFrame, features: list[str]) -> DataFrame:
        return self.fit(df, features).transform(df)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> FeatureReducer:
        return cls(**json.loads(text))


#: up to this many rows percentiles come from one aggregate, which holds every distinct value in one place
ONE_BUFFER = 2_000_000


def quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...]) -> dict[str, list[float] | None]:
    """Exact interpolated percentiles of each column; None for a column without values.

    Larger tables are cut into ranges of each column's values instead: the rows in
    each range say which one holds a wanted rank, and only that range is sorted.
    """
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in columns)).first()
    if counts["_n"] <= ONE_BUFFER:
        row = df.agg(*(F.percentile(c, F.array(*map(F.lit, points))).alias(c) for c in columns)).first()
        return {c: row[c] for c in columns}
    return {c: ranked_values(df.select(F.col(c).cast("double").alias("x")).where("x is not null"), counts[c], points) for c in columns}


def ranked_values(x: DataFrame, n: int, points: tuple[float, ...], bins: int = 4096) -> list[float] | None:
    """Percentiles of x by rank: values between neighbouring sketch points are counted, and the ranges that hold a rank are narrowed until few values are left."""
    if not n:
        return None
    at = sorted({k for p in points for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
    found = {}
    for k in at:
        r = x.agg(F.min("x"), F.max("x")).first()
        lo, hi, below = float(r[0]), float(r[1]), 0
        while True:
            inside = x.where(F.col("x").between(lo, hi))
            m = inside.count()
            if m <= ONE_BUFFER or lo == hi:
                break
            width = (hi - lo) / bins
            if lo + width == lo or not np.isfinite(width):
                break
            cell = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
            held = inside.groupBy(cell.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()  # bins rows
            for c in held:
                if below + c["n"] > k:
                    lo, hi = c["lo"], c["hi"]
                    break
                below += c["n"]
        if lo == hi:
            found[k] = lo
        else:
            values = inside.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").toLocalIterator()
            seen = below
            for v in values:
                seen += v["n"]
                if seen > k:
                    found[k] = v["x"]
                    break
    out = []
    for p in points:
        k, f = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
        out.append(found[k] + (found[min(k + 1, n - 1)] - found[k]) * f)
    return out


@dataclass
class RobustScaler:
    """(x - median) / interquartile range, exact percentiles of the training rows; a range of 0 counts as 1."""

    stats: dict[str, tuple[float, float]] | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> RobustScaler:
        columns = columns if columns is not None else [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
        q = quantiles(df, columns, (0.25, 0.5, 0.75))
        self.stats = {c: (q[c][1], (q[c][2] - q[c][0]) or 1.0) for c in columns if q[c] is not None}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.stats is None:
            raise RuntimeError("fit the scaler first")
        if missing := [c for c in self.stats if c not in df.columns]:
            raise KeyError(f"missing columns: {missing}")
        return df.withColumns({c: (F.col(c) - m) / iqr for c, (m, iqr) in self.stats.items()})

    def to_json(self) -> str:
        return json.dumps(self.stats)

    @classmethod
    def from_json(cls, text: str) -> RobustScaler:
        return cls({k: tuple(v) for k, v in json.loads(text).items()})
