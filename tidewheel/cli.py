"""Commands: map, ingest, validate, features, run-all, train, select, predict, explain, report, live."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel import ops, sinks
from tidewheel.ml import run as R
from tidewheel.operators import mapping, quality
from tidewheel.plans.features import features as all_features
from tidewheel.plans.features import incremental
from tidewheel.session import session
from tidewheel.sources import files, klines, rest
from tidewheel.sources.candles import parse_klines, read_csv, read_or_empty


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidewheel")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=about)
        for flag, more in options:
            c.add_argument(flag, **more)

    config = ("--config", {"help": "YAML file"})
    coin = ("--coin", {"help": "one symbol"})
    out = ("--out", {"required": True, "help": "folder of the results"})
    symbol, limit = ("--symbol", {"help": "one symbol, in any case"}), ("--limit", {"type": int, "help": "the best-ranked coins"})
    source = ("--source", {"required": True, "help": "address of the exchange, or a folder of landed files"})
    command("map", "map ranked coins to markets", source, out, ("--cache", {}), ("--top", {"type": int, "default": 200}))
    command("ingest", "fetch, check and store candles", source, out, ("--mapping", {"required": True}), symbol, limit, ("--start", {"type": int, "required": True, "help": "ms"}), ("--end", {"type": int, "required": True, "help": "ms"}))
    command("validate", "check candle files", ("--folder", {"required": True}), ("--mapping", {"required": True}), out, symbol, limit, ("--fix", {"action": "store_true"}))
    command("features", "compute features of a candle table", ("--candles", {"required": True}), out, ("--full", {"action": "store_true"}), ("--context", {"default": "BTC"}))
    train = [config, coin, ("--model", {}), ("--horizon", {"type": int}), ("--features", {"required": True}), out, ("--top-n", {"type": int, "dest": "top_n"}), ("--ranking-file", {"dest": "ranking_file"})]
    for name in ("run-all", "train"):
        command(name, "train models on folds and store them", *train, ("--resume", {"action": argparse.BooleanOptionalAction, "default": None}))
    command("select", "rank models and choose winners", config, coin, out)
    command("predict", "price interval by the winner's model", config, ("--coin", {"required": True}), ("--horizon", {"type": int, "default": 1}), ("--features", {"required": True}), out)
    command("explain", "importance of features and groups", config, ("--coin", {"required": True}), ("--horizon", {"type": int, "default": 1}), ("--features", {"required": True}), out)
    command("report", "comparison of models over all coins", config, out)
    return p


def exchange(source: str) -> rest.Exchange:
    return rest.Exchange(rest.Http(source) if "://" in source and not source.startswith("file:") else rest.Landed(source))


def coins(spark: SparkSession, a) -> DataFrame:
    m = files.read_ranking(spark, a.mapping, ("rank", "symbol", "status")) if _lower(spark, a.mapping) else files.read_ranking(spark, a.mapping)
    return mapping.pick(mapping.ready_coins(m), a.symbol, a.limit)


def _lower(spark: SparkSession, path: str) -> bool:
    return "rank" in spark.read.option("header", True).csv(path).columns


def do_map(spark, a):
    e = exchange(a.source)
    ranked = rest.ranking(spark, e, a.top)
    found = rest.tickers(spark, e, a.cache)
    mapped = mapping.map_coins(ranked.select(F.col("Rank").alias("rank"), F.col("Symbol").alias("symbol")), rest.markets(spark, e, a.cache), found)
    sinks.write_csv(ranked, f"{a.out}/top_coins")
    sinks.write_mapping(mapping.listed_details(mapped, found), a.out)
    return mapping.summary_text(mapped)


def do_ingest(spark, a):
    klines.register(spark)
    own = coins(spark, a)
    markets = {r["market"]: r["symbol"] for r in own.select("market", "symbol").collect()}  # the coins asked for
    options = {"base": a.source} if "://" in a.source and not a.source.startswith("file:") else {"folder": f"{a.source}/klines"}
    raw = spark.read.format("klines").options(**options, symbols=",".join(markets), start=str(a.start), end=str(a.end)).load()
    numbered = raw.withColumn("row_idx", F.monotonically_increasing_id())

    def fetch(ranges: DataFrame) -> DataFrame:
        return parse_klines(klines.ranges_from(spark, ranges, options).withColumn("row_idx", F.monotonically_increasing_id()))

    good, bad, totals = quality.ingested(parse_klines(numbered), fetch)
    sinks.write_table(good, f"{a.out}/candles")
    sinks.write_csv(bad.select("symbol", "ts", "reason"), f"{a.out}/rejected")
    rows = own.select(F.col("market").alias("symbol")).join(totals, "symbol", "left").withColumn("status", F.when(F.col("candles") > 0, "OK").otherwise("FAILED"))
    return sinks.run_totals(rows.na.fill(0)).first().asDict()


def do_validate(spark, a):
    report, issues, candles = files.checked_folder(spark, a.folder, coins(spark, a).select("symbol"), a.fix)
    sinks.write_csv(report, f"{a.out}/report")
    issues.write.mode("overwrite").option("header", True).partitionBy("symbol").csv(f"{a.out}/issues")
    sinks.write_csv(quality.gaps(candles.where("ts is not null")), f"{a.out}/gaps")
    if a.fix:
        files.write_repaired(candles, report, f"{a.out}/repaired")
    return {r["status"]: r["n"] for r in report.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}


def do_features(spark, a):
    candles = spark.read.parquet(a.candles)
    stored = read_or_empty(spark, f"{a.out}/features", "symbol string, ts timestamp_ntz")
    whole = a.full or stored.isEmpty()
    made = all_features(candles, a.context) if whole else incremental(candles, stored, context=a.context)
    if whole:
        sinks.write_features(made, f"{a.out}/features", True)
    else:  # a symbol's last stored bar comes again, so only later ones are added
        last = stored.groupBy(F.col("symbol").alias("_s")).agg(F.max("ts").alias("_l"))
        new = made.join(last, made["symbol"] == last["_s"], "left").where(F.col("_l").isNull() | (F.col("ts") > F.col("_l"))).drop("_s", "_l")
        sinks.write_features(new, f"{a.out}/features", False)
    return {"rows": spark.read.parquet(f"{a.out}/features").count()}


def settings(a) -> C.ExperimentConfig:
    over = {"coins": [a.coin] if getattr(a, "coin", None) else None, "models": [a.model] if getattr(a, "model", None) else None}
    if getattr(a, "horizon", None) and a.command in ("train", "run-all"):
        over["target"] = {"horizons": [a.horizon]}
    return C.load(getattr(a, "config", None), over)


def do_train(spark, a):
    c = settings(a)
    feats = spark.read.parquet(a.features)
    if a.top_n:
        if not a.ranking_file:
            raise ValueError("--top-n needs --ranking-file")
        ranking = files.read_ranking(spark, a.ranking_file)
        chosen = mapping.select_top(ranking, a.top_n, feats.select("symbol").distinct())
        c.coins = [r["symbol"] for r in chosen.where("available").orderBy("selection_order").collect()]
    resume = c.training.resume if a.resume is None else a.resume
    name = C.next_experiment(f"{a.out}/{c.paths.experiments_dir}", resume)
    C.snapshot(c, f"{a.out}/{c.paths.experiments_dir}/{name}/config.yaml")
    ops.seed_all(c.training.seed)
    found = R.run(feats, c, a.out, name)
    failed = R.failures(found)
    if not failed.isEmpty():
        sinks.failure_log(failed, f"{a.out}/failures")
    return {"experiment": name, "ok": found.where("status = 'ok'").count(), "failed": failed.count()}


def newest(spark, a, c) -> DataFrame:
    ids = C.experiment_ids(f"{a.out}/{c.paths.experiments_dir}")
    if not ids:
        raise FileNotFoundError(f"no experiment in {a.out}")
    found = R.latest(R.results(spark, a.out).where(F.col("experiment") == ids[-1]))
    return found.where(F.col("symbol").isin(*c.coins)) if c.coins else found


def do_select(spark, a):
    c = settings(a)
    found = newest(spark, a, c)
    ranking = R.selected(found, c)
    best, rest_ = R.production(found, ranking)
    sinks.write_table(best, f"{a.out}/{c.paths.models_dir}")
    sinks.write_table(rest_, f"{a.out}/{c.paths.archive_dir}")
    return {r["symbol"]: r["model"] for r in ranking.where("is_winner").select("symbol", "model").collect()}


def do_predict(spark, a):
    c = settings(a)
    winners = read_or_empty(spark, f"{a.out}/{c.paths.models_dir}", R.RESULT).where(F.col("symbol") == a.coin)
    r = R.predicted(winners, spark.read.parquet(a.features).where(F.col("symbol") == a.coin), a.horizon, c.target.price_column).first()
    if r is None:
        raise FileNotFoundError(f"no model of {a.coin} for {a.horizon} days")
    return r.asDict()


def do_explain(spark, a):
    c = settings(a)
    winners = read_or_empty(spark, f"{a.out}/{c.paths.models_dir}", R.RESULT).where(F.col("symbol") == a.coin)
    out = R.explained(winners, spark.read.parquet(a.features).where(F.col("symbol") == a.coin), c, a.horizon)
    sinks.write_csv(out, f"{a.out}/explained")
    return [tuple(r) for r in spark.read.option("header", True).csv(f"{a.out}/explained").orderBy(F.col("value").cast("double").desc()).limit(10).collect()]


def do_report(spark, a):
    c = settings(a)
    ranking = R.selected(newest(spark, a, c), c)
    sinks.write_csv(sinks.comparison([ranking]), f"{a.out}/{c.paths.evaluation_dir}/all_model_results")
    ranking.write.mode("overwrite").option("header", True).partitionBy("symbol").csv(f"{a.out}/{c.paths.evaluation_dir}/model_comparison")
    return {"models": ranking.count()}


DO = {"map": do_map, "ingest": do_ingest, "validate": do_validate, "features": do_features, "run-all": do_train, "train": do_train, "select": do_select, "predict": do_predict, "explain": do_explain, "report": do_report}


def main(args: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(args)
    with ops.StopFlag():
        out = DO[a.command](spark or session("tidewheel"), a)
    print(out)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
