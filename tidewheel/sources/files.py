"""Folders of candle and feature files: what is there, what cannot be read, and loading all that can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators import quality
from tidewheel.sources.candles import read_csv

#: columns of a candle file
NEED = ["timestamp", *quality.NUMBERS]
ISSUE = "symbol string, code string, severity string, n bigint, message string"


def listed(spark: SparkSession, folder: str, ending: str = ".csv") -> DataFrame:
    """symbol, path, size of the files <SYMBOL><ending> of a folder; contents are not read.  A row for each coin, listed by the driver."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{ending}")
    found = glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob) or []
    rows = [(x.getPath().getName()[: -len(ending)].upper(), x.getPath().toString(), x.getLen()) for x in found if x.isFile()]
    return spark.createDataFrame(rows, "symbol string, path string, size bigint")


def heads(spark: SparkSession, folder: str, ending: str = ".csv") -> DataFrame:
    """symbol, header, lines and widest (most fields in a line) of each file that has a line."""
    lines = spark.read.option("pathGlobFilter", f"*{ending}").text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    symbol = F.upper(F.regexp_extract("path", rf"([^/]+){ending.replace('.', chr(92) + '.')}$", 1))
    line = F.monotonically_increasing_id()
    found = lines.withColumn("line", line).where(F.length(F.trim("value")) > 0).groupBy(symbol.alias("symbol")).agg(
        F.min_by("value", F.struct("at", "line")).alias("header"),
        F.count(F.lit(1)).alias("lines"),
        F.max(F.size(F.split("value", ","))).alias("widest"),
        F.max((~F.is_valid_utf8("value")).cast("int")).alias("garbled"),
    )
    return found


def file_issues(spark: SparkSession, folder: str, symbols: DataFrame) -> DataFrame:
    """Files of the symbols that cannot be checked, columns ISSUE; one row for each.

    In this order: FILE_MISSING, FILE_EMPTY (no bytes), FILE_UNREADABLE (bytes that are
    no text, or lines with more fields than the header), NO_DATA_ROWS (a header alone)
    and MISSING_COLUMNS.
    """
    want = symbols.select(F.upper("symbol").alias("symbol")).distinct()
    files = listed(spark, folder).groupBy("symbol").agg(F.sum("size").alias("size"))
    head = heads(spark, folder) if not files.isEmpty() else spark.createDataFrame([], "symbol string, header string, lines bigint, widest int, garbled int")
    d = want.join(files, "symbol", "left").join(head, "symbol", "left")
    names = F.transform(F.split("header", ","), lambda x: F.trim(x))
    lost = F.array_except(F.array(*map(F.lit, NEED)), names)
    size = F.coalesce("size", F.lit(-1))
    code = (
        F.when(size < 0, "FILE_MISSING")
        .when((size == 0) | F.col("header").isNull(), "FILE_EMPTY")
        .when((F.col("garbled") == 1) | (F.col("widest") > F.size(names)), "FILE_UNREADABLE")
        .when(F.col("lines") < 2, "NO_DATA_ROWS")
        .when(F.size(lost) > 0, "MISSING_COLUMNS")
    )
    message = F.when(F.col("code") == "MISSING_COLUMNS", F.concat(F.lit("missing: "), F.array_join(lost, ", "))).otherwise(F.col("code"))
    return d.withColumn("code", code).where("code is not null").select("symbol", "code", F.lit("CRITICAL").alias("severity"), F.lit(1).cast("bigint").alias("n"), message.alias("message"))


def checked_folder(spark: SparkSession, folder: str, symbols: DataFrame, fixed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Report, issues and candles of a folder of candle files: files that cannot be checked are rows of report and issues."""
    bad = file_issues(spark, folder, symbols)
    good = symbols.select(F.upper("symbol").alias("symbol")).distinct().join(bad, "symbol", "left_anti")
    names = [r["symbol"] for r in good.collect()]  # the symbols asked for
    if not names:
        candles = spark.createDataFrame([], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, row_idx bigint")
    else:
        paths = [r["path"] for r in listed(spark, folder).where(F.col("symbol").isin(names)).collect()]
        candles = read_csv(spark, paths).drop("_corrupt_record")
    issues = bad.unionByName(quality.issues(candles).withColumn("message", F.col("code")))
    return quality.report(candles, bad, fixed), issues, candles


def write_repaired(candles: DataFrame, report: DataFrame, path: str) -> DataFrame:
    """Write the repaired candles of the symbols that a repair changes to a new table; return their symbols."""
    changed = report.where("fixes_applied <> ''").select("symbol")
    quality.repair(candles).drop("row_idx").join(changed, "symbol", "left_semi").write.mode("errorifexists").partitionBy("symbol").parquet(path)
    return changed


# ---- feature files ------------------------------------------------------------------------------------------------

FEATURES = "_features.csv"


def read_ranking(spark: SparkSession, path: str, need: tuple[str, ...] = ("Rank", "Symbol", "Status")) -> DataFrame:
    """A ranking or mapping CSV with lower-case names; a missing file or column raises."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    if missing := [c for c in need if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.withColumnsRenamed({c: c.lower() for c in df.columns})


def feature_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """The symbols that have a feature file, in order."""
    return listed(spark, folder, FEATURES).select("symbol").distinct().orderBy("symbol")


def load_features(spark: SparkSession, folder: str, symbols: list[str] | None = None, price: str = "close") -> tuple[DataFrame, DataFrame]:
    """Feature rows of all files, and the files that failed (symbol, message).

    One row for each symbol and time (the first), infinite values null, times that do
    not parse left out.  A file without timestamp or price column fails, one that is
    not there fails too, and the others load.
    """
    files = listed(spark, folder, FEATURES)
    if symbols is not None:
        wanted = spark.createDataFrame([(s.upper(),) for s in symbols], "symbol string")
        files = wanted.join(files, "symbol", "left")
    rows = files.collect()  # a row for each symbol
    missing = [(r["symbol"], "no file") for r in rows if r["path"] is None]
    head = {r["symbol"]: [x.strip() for x in r["header"].split(",")] for r in heads(spark, folder, FEATURES).collect()} if len(rows) > len(missing) else {}
    groups: dict[tuple, list[str]] = {}
    for r in rows:
        if r["path"] is None:
            continue
        names = head.get(r["symbol"], [])
        if lost := [c for c in ("timestamp", price) if c not in names]:
            missing.append((r["symbol"], f"missing columns: {lost}"))
        else:
            groups.setdefault(tuple(names), []).append(r["path"])
    out = None
    for names, paths in groups.items():  # files of one header are read together
        schema = ", ".join(f"`{c}` {'string' if c in ('timestamp', 'symbol') else 'double'}" for c in names)
        d = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(paths)
        symbol = F.upper(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_features\.csv$", 1))
        d = d.select(symbol.alias("symbol"), F.try_to_timestamp("timestamp").cast("timestamp_ntz").alias("ts"), *(F.col(f"`{c}`") for c in names if c not in ("timestamp", "symbol")), F.monotonically_increasing_id().alias("row_idx"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    failed = spark.createDataFrame(missing, "symbol string, message string")
    if out is None:
        return spark.createDataFrame([], f"symbol string, ts timestamp_ntz, {price} double"), failed
    numbers = [c for c in out.columns if c not in ("symbol", "ts", "row_idx")]
    return quality.finite(quality.keep_first(out.where("ts is not null")).drop("row_idx"), numbers), failed


def dataset_summary(features: DataFrame) -> DataFrame:
    """symbol, n_rows, n_features, first_ts, last_ts."""
    n = len([c for c in features.columns if c not in ("symbol", "ts")])
    return features.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.lit(n).alias("n_features"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
