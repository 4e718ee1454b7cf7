"""Sinks, and the records that make a long run resumable."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import mapping, quality
from tidewheel.sources.candles import read_or_empty


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",), mode: str = "overwrite") -> None:
    """A table partitioned by columns; overwrite replaces only the partitions that df has."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def drop_tail(df: DataFrame) -> DataFrame:
    """Without each symbol's last bar."""
    last = df.groupBy("symbol").agg(F.max("ts").alias("_t")).withColumnRenamed("symbol", "_s")
    return df.join(last, (df["symbol"] == last["_s"]) & (df["ts"] < last["_t"])).drop("_s", "_t")


def gap_lines(df: DataFrame, verbose: int = 500) -> DataFrame:
    """symbol, gap_no, line: a report of the gaps of a candle table, a block for each of a symbol's first `verbose` gaps and a line for the others."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    head = F.concat("symbol", F.lit(" gap "), F.col("gap_no").cast("string"), F.lit(": "), stamp("gap_start"), F.lit(" to "), stamp("gap_end"), F.lit(", "), F.col("missing_hours").cast("string"), F.lit(" missing"))
    more = F.concat(head, F.lit("\n  after "), stamp("previous_ts"), F.lit(", before "), stamp("next_ts"))
    return quality.gaps(df).select("symbol", "gap_no", F.when(F.col("gap_no") <= verbose, more).otherwise(head).alias("line"))


def gap_text(df: DataFrame, verbose: int = 500) -> str:
    """The same as one text; for a table of few gaps (`write_gap_text` writes any number)."""
    return "\n".join(r["line"] for r in gap_lines(df, verbose).orderBy("symbol", "gap_no").toLocalIterator())


def write_gap_text(df: DataFrame, path: str, verbose: int = 500) -> None:
    """The same as text files, symbols in ranges."""
    gap_lines(df, verbose).repartitionByRange("symbol", "gap_no").sortWithinPartitions("symbol", "gap_no").select("line").write.mode("overwrite").text(path)


def write_reports(df: DataFrame, folder: str, file_issues: DataFrame | None = None, fixed: bool = False) -> None:
    """Report, issues (by symbol), gaps and a gap text of a candle table (with row_idx), each in a folder of its own."""
    write_csv(quality.report(df, file_issues, fixed), f"{folder}/report")
    found = quality.issues(df).select("symbol", "code", "severity", "n")
    found = found if file_issues is None else found.unionByName(file_issues.select(*found.columns))
    found.write.mode("overwrite").option("header", True).partitionBy("symbol").csv(f"{folder}/issues")
    timed = df.where("ts is not null")
    write_csv(quality.gaps(timed), f"{folder}/gaps")
    write_gap_text(timed, f"{folder}/gap_text")


def write_mapping(mapped: DataFrame, folder: str) -> None:
    """All coins by rank, those to look at if there are any, and a summary."""
    _, review = mapping.split_review(mapped)
    write_csv(mapped.orderBy("rank", "symbol"), f"{folder}/coin_mapping")
    if not review.isEmpty():
        write_csv(review.orderBy("rank", "symbol"), f"{folder}/review")
    mapped.sparkSession.createDataFrame([(mapping.summary_text(mapped),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")


def write_features(df: DataFrame, path: str, whole: bool) -> None:
    """Feature rows by symbol: a whole run replaces the symbols it has, an incremental one adds rows."""
    write_table(df, path, mode="overwrite" if whole else "append")


def run_totals(results: DataFrame) -> DataFrame:
    """Totals of a run from a row for each symbol: status, candles, gaps_filled, corrected, rejected."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return results.agg(F.count(F.lit(1)).alias("coins"), n("OK"), n("SKIPPED"), n("FAILED"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("candles", "gaps_filled", "corrected", "rejected")))


def feature_summary(df: DataFrame) -> DataFrame:
    """Rows, first and last time, and number of columns by symbol."""
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.lit(len(df.columns)).alias("n_columns"))


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Progress:
    """A table of finished tasks: a run goes on with those that are not in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, "experiment string, symbol string, model string, status string, message string")

    def add(self, experiment: str, symbol: str, model: str, status: str = "ok", message: str = "") -> None:
        self.spark.createDataFrame([(experiment, symbol, model, status, message)], self.done().schema).coalesce(1).write.mode("append").parquet(self.path)

    def left(self, experiment: str, symbols: Iterable[str], models: Iterable[str]) -> DataFrame:
        """Tasks (symbol, model) that are not done; failed ones count as left."""
        s = self.spark.createDataFrame([(x,) for x in symbols], "symbol string")
        m = self.spark.createDataFrame([(x,) for x in models], "model string")
        tasks = s.join(m, how="cross")  # the grid itself: a few names on either side
        return tasks.join(self.done().where((F.col("experiment") == experiment) & (F.col("status") == "ok")), ["symbol", "model"], "left_anti")


def failure_log(failed: DataFrame, path: str) -> None:
    """Append failures (symbol, model, message) with line breaks and commas taken out."""
    clean = F.regexp_replace(F.regexp_replace("message", "[\\r\\n]+", " "), ",", ";")
    write_csv(failed.withColumn("message", clean), path, "append")


def verification_text(verified: DataFrame) -> str:
    """Counts of verified and failed symbols, and a line for each symbol that failed."""
    r = verified.agg(F.count_if("verified").alias("ok"), F.count_if(~F.col("verified")).alias("bad")).first()
    lines = [f"verified: {r['ok']}", f"failed: {r['bad']}"]
    lines += [f"{x['symbol']}: " + ", ".join(f"{k} {x[k]}" for k in ("model", "scaler", "reducer", "meta", "metrics")) for x in verified.where("not verified").orderBy("symbol").toLocalIterator()]
    return "\n".join(lines)


def comparison(tables: list[DataFrame]) -> DataFrame:
    """Rankings of all coins in one table, best model first."""
    if not tables:
        raise ValueError("nothing to compare")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy("symbol", "place")


def verify(artifacts: DataFrame) -> DataFrame:
    """Whether each symbol has exactly one model and at least one scaler, reducer, meta and metrics file (symbol, kind)."""
    kinds = ("scaler", "reducer", "meta", "metrics")
    n = {k: F.count_if(F.col("kind") == k) for k in ("model", *kinds)}
    ok = n["model"] == 1
    for k in kinds:
        ok &= n[k] >= 1
    return artifacts.groupBy("symbol").agg(*(x.alias(k) for k, x in n.items()), ok.alias("verified"))
