"""The feature plan: groups in an order that their inputs allow, each a DataFrame transform."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators import indicators, structure
from tidewheel.operators.quality import warmed_up

Transform = Callable[[DataFrame], DataFrame]

#: name, groups it needs, transform
GROUPS: list[tuple[str, tuple[str, ...], Transform]] = [
    ("returns", (), indicators.returns),
    ("trend", (), indicators.trend),
    ("momentum", (), indicators.momentum),
    ("volatility", (), indicators.volatility),
    ("volume", (), indicators.volume),
    ("candle", (), indicators.candle),
    ("clock", (), indicators.clock),
    ("rolling_stats", (), indicators.rolling_stats),
    ("relative_strength", (), indicators.relative_strength),
    ("fibonacci", (), indicators.fibonacci),
    ("swings", (), structure.swings),
    ("trend_state", ("swings",), structure.trend_state),
    ("order_blocks", ("volatility", "swings"), structure.order_blocks),
    ("fair_value_gaps", (), structure.fair_value_gaps),
    ("liquidity", (), structure.liquidity),
]


#: groups that join tables of their own: they are computed beside the others, on no more columns than they need
JOINED = {"order_blocks", "fair_value_gaps", "liquidity"}


def compute(candles: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All feature groups, or those named and what they need.  Candles have one row for each symbol and time.

    Window groups are one chain over one exchange.  Joining groups start from the
    candles again and come in by key, so that no join repeats the chain.
    """
    table = {name: (deps, transform) for name, deps, transform in GROUPS}
    wanted, todo = set(), list(table if only is None else only)
    while todo:
        name = todo.pop()
        if name not in table:
            raise KeyError(f"unknown feature group {name}")
        wanted.add(name)
        todo += [] if name in JOINED else table[name][0]
    out = candles
    for name, _, transform in GROUPS:
        if name in wanted and name not in JOINED:
            out = out.transform(transform)
    for name in (g for g, _, _ in GROUPS if g in wanted and g in JOINED):
        deps, transform = table[name]
        side = candles
        for dep in deps:
            side = side.transform(table[dep][1])
        made = side.transform(transform)
        out = out.join(made.select("symbol", "ts", *(c for c in made.columns if c not in side.columns)), ["symbol", "ts"], "left")
    return out


def features(candles: DataFrame, context: str | None = "BTC", prefix: str = "BTC", trim: bool = True) -> DataFrame:
    """All features, the context symbol's columns, and without the rows that warm up."""
    out = compute(candles)
    if context is not None:
        out = structure.market_context(out, context, prefix)
    return warmed_up(out) if trim else out


def failures(candles: DataFrame, made: DataFrame) -> DataFrame:
    """symbol, n_rows, message of the symbols that a run made no feature row of; the others are not held up by them."""
    n = candles.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(made.select("symbol").distinct(), "symbol", "left_anti").withColumn("message", F.lit("no bar has all warm-up features"))


def incremental(candles: DataFrame, stored: DataFrame, **options) -> DataFrame:
    """Feature rows from each symbol's last stored time on (that row included, as its bar may have grown).

    Features that depend on all of the past (running sums, extremes, smoothed means, trend) are
    computed over the whole history, so the result equals a full run.
    """
    last = stored.groupBy("symbol").agg(F.max("ts").alias("_last")).withColumnRenamed("symbol", "_s")
    out = features(candles, **options)
    return out.join(last, out["symbol"] == last["_s"], "left").where(F.col("_last").isNull() | (F.col("ts") >= F.col("_last"))).drop("_s", "_last")
