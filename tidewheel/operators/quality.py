"""Data quality of candle tables: checks, gaps, repairs and cleaning.

Checks that depend on the order of rows in a file read it from a row_idx column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]
NUMBERS = [*PRICES, "volume", "quote_volume", "trades"]
CANDLE = ["symbol", "ts", *NUMBERS]
JUMP = 0.50
#: fixed values: severities, worst last
CRITICAL = {
    "BAD_TIMESTAMP_FORMAT",
    "DUPLICATE_ROWS",
    "DUPLICATE_TIMESTAMPS",
    "OUT_OF_ORDER_TIMESTAMPS",
    "NAN_VALUES",
    "INFINITE_VALUES",
    "NEGATIVE_PRICES",
    "NEGATIVE_VOLUME",
    "NEGATIVE_TRADES",
    "OHLC_INCONSISTENT",
}
WARNING = {"MISSING_HOURLY_CANDLES", "LARGE_PRICE_JUMPS"}


def infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == F.lit(float("inf"))


def inconsistent() -> Column:
    o, h, l, c = (F.col(x) for x in PRICES)
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def row_number(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def mark_duplicates(df: DataFrame) -> DataFrame:
    """Add dup_row (an equal row stands earlier) and dup_ts (an earlier row has the symbol's time)."""
    return df.withColumns({"dup_row": row_number(CANDLE, ["row_idx"]) > 1, "dup_ts": row_number(["symbol", "ts"], ["row_idx"]) > 1})


#: codes of the checks on rows, in the order of the report
CODES = ["BAD_TIMESTAMP_FORMAT", "DUPLICATE_ROWS", "DUPLICATE_TIMESTAMPS", "OUT_OF_ORDER_TIMESTAMPS", "MISSING_HOURLY_CANDLES", "NAN_VALUES", "INFINITE_VALUES", "NEGATIVE_PRICES", "NEGATIVE_VOLUME", "NEGATIVE_TRADES", "OHLC_INCONSISTENT", "LARGE_PRICE_JUMPS"]


def next_on_grid(order: str = "ts") -> tuple[Column, Column]:
    """Whether a bar is on its symbol's hourly grid, and the grid's next bar (past its end for the last one)."""
    lo, hi = F.expr("min(ts) over (partition by symbol)"), F.expr("max(ts) over (partition by symbol)")
    on = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(lo.cast("timestamp")), F.lit(3_600_000_000)) == 0
    past = lo + F.expr("make_dt_interval(0, 1)") * (F.expr("timestampdiff(HOUR, min(ts) over (partition by symbol), max(ts) over (partition by symbol))") + 1)
    return on, F.coalesce(F.expr(f"lead(if(_on, ts, null), 1) ignore nulls over (partition by symbol order by {order})"), past)


def profile(df: DataFrame) -> DataFrame:
    """One row for each symbol: counts of all row checks, rows, span and gaps.

    All windows share one exchange, by symbol.  Rows without a time are counted and
    take no part in other checks.
    """
    order = Window.partitionBy("symbol").orderBy("ts", "row_idx")
    d = mark_duplicates(df.repartition("symbol"))
    on, after = next_on_grid("ts, row_idx")
    d = d.withColumns({"_last": F.expr("lag(ts, 1) ignore nulls over (partition by symbol order by row_idx)"), "_close": F.lag(F.when(F.col("ts").isNotNull(), F.struct("close"))).over(order), "_on": on})
    d = d.withColumn("_next", after)
    timed = F.col("ts").isNotNull()
    gap = F.when(timed & F.col("_on"), F.expr("timestampdiff(HOUR, ts, _next)") - 1)
    d = d.withColumns({"_gap": F.when(gap > 0, gap), "_jump": F.abs(F.col("close") / F.nullif(F.col("_close.close"), F.lit(0.0)) - 1)})
    bad = {
        "BAD_TIMESTAMP_FORMAT": ~timed,
        "DUPLICATE_ROWS": timed & F.col("dup_row"),
        "DUPLICATE_TIMESTAMPS": timed & F.col("dup_ts"),
        "OUT_OF_ORDER_TIMESTAMPS": F.col("ts") < F.col("_last"),
        "NEGATIVE_PRICES": timed & (F.least(*PRICES) < 0),
        "NEGATIVE_VOLUME": timed & (F.least("volume", "quote_volume") < 0),
        "NEGATIVE_TRADES": timed & (F.col("trades") < 0),
        "OHLC_INCONSISTENT": timed & inconsistent(),
        "LARGE_PRICE_JUMPS": timed & (F.col("_jump") > JUMP),
    }
    null = sum(((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("int") for c in NUMBERS), F.lit(0))
    inf = sum((F.coalesce(infinite(F.col(c)), F.lit(False)).cast("int") for c in NUMBERS), F.lit(0))
    counts = {k: F.count_if(F.coalesce(x, F.lit(False))) for k, x in bad.items()}
    counts |= {"NAN_VALUES": F.coalesce(F.sum(F.when(timed, null)), F.lit(0)), "INFINITE_VALUES": F.coalesce(F.sum(F.when(timed, inf)), F.lit(0)), "MISSING_HOURLY_CANDLES": F.coalesce(F.sum("_gap"), F.lit(0))}
    first = F.struct(F.col("_gap"), -F.unix_micros(F.col("ts").cast("timestamp")))
    return d.groupBy("symbol").agg(
        *(counts[k].cast("bigint").alias(k) for k in CODES),
        F.count("ts").alias("row_count"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        F.count("_gap").alias("gap_count"),
        F.max("_gap").cast("bigint").alias("largest_gap"),
        F.max_by(F.expr("ts + interval 1 hour"), F.when(F.col("_gap").isNotNull(), first)).alias("largest_start"),
        F.max_by(F.expr("_next - interval 1 hour"), F.when(F.col("_gap").isNotNull(), first)).alias("largest_end"),
        F.max(F.when(timed, F.col("_jump"))).alias("largest_jump"),
    )


def severity_of(code: Column) -> Column:
    return F.when(code.isin(*sorted(WARNING)), "WARNING").otherwise("CRITICAL")


def issues(df: DataFrame) -> DataFrame:
    """symbol, code, severity and count of all row checks; codes that count nothing are left out."""
    pairs = ", ".join(f"'{k}', {k}" for k in CODES)
    long = profile(df).select("symbol", F.expr(f"stack({len(CODES)}, {pairs}) as (code, n)"))
    return long.where("n > 0").withColumn("severity", severity_of(F.col("code")))


def missing_by_column(df: DataFrame) -> DataFrame:
    """symbol, column, nulls, infinite: the detail behind NAN_VALUES and INFINITE_VALUES."""
    null = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    inf = lambda c: F.count_if(F.coalesce(infinite(F.col(c)), F.lit(False)))
    wide = df.where("ts is not null").groupBy("symbol").agg(*(x for c in NUMBERS for x in (null(c).alias(f"n_{c}"), inf(c).alias(f"i_{c}"))))
    return wide.select("symbol", F.expr(f"stack({len(NUMBERS)}, " + ", ".join(f"'{c}', n_{c}, i_{c}" for c in NUMBERS) + ") as (column, nulls, infinite)"))


def gaps(df: DataFrame) -> DataFrame:
    """Runs of missing hours: gap_no, gap_start, gap_end, missing_hours, previous_ts, next_ts.

    The grid starts at a symbol's first bar and ends at its last; a run lies between two
    bars that follow each other on it.
    """
    on, after = next_on_grid()
    d = df.select("symbol", "ts").withColumn("_on", on).withColumn("_next", after).where("_on and _next > ts + interval 1 hour")
    no = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    hours = F.expr("timestampdiff(HOUR, ts, _next)") - 1
    ends = {"gap_start": "ts + interval 1 hour", "gap_end": "_next - interval 1 hour", "previous_ts": "ts", "next_ts": "_next"}
    d = d.withColumns({"gap_no": no, "missing_hours": hours.cast("bigint")} | {k: F.expr(x) for k, x in ends.items()})
    return d.select("symbol", "gap_no", "gap_start", "gap_end", "missing_hours", "previous_ts", "next_ts")


def missing_hours(df: DataFrame) -> DataFrame:
    """symbol and ts of the hours, from a symbol's first bar to its last, that have no bar."""
    return gaps(df).select("symbol", F.explode(F.sequence("gap_start", "gap_end", F.expr("interval 1 hour"))).alias("ts"))


def gap_rollup(df: DataFrame) -> DataFrame:
    """Missing candles, gaps and the largest gap (the first of equals) by symbol."""
    first = F.struct(F.col("missing_hours"), -F.unix_timestamp(F.col("gap_start").cast("timestamp")))
    return gaps(df).groupBy("symbol").agg(F.sum("missing_hours").alias("missing_candles"), F.count(F.lit(1)).alias("gap_count"), F.max("missing_hours").alias("largest_gap"), F.max_by("gap_start", first).alias("largest_start"))


def summary(df: DataFrame) -> DataFrame:
    """Rows, first and last time, and percent of the hours between them that the rows would fill (over 100 with duplicates)."""
    s = df.where("ts is not null").groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    hours = F.expr("timestampdiff(HOUR, start_ts, end_ts)") + 1
    return s.withColumn("coverage", F.round(F.col("row_count") * 100.0 / hours, 3))


#: fixed values: columns of the validation report
REPORT = ["symbol", "status", "rows", "start", "end", "coverage_pct", "missing_candles", "gap_count", "largest_gap", "largest_gap_start", "largest_gap_end", "critical_issues", "warning_issues", "issue_codes", "fixes_applied"]
#: repairs and the checks that ask for them
FIXES = {"DUPLICATE_ROWS": "dropped duplicate rows", "DUPLICATE_TIMESTAMPS": "dropped duplicate timestamps", "OUT_OF_ORDER_TIMESTAMPS": "sorted by timestamp"}


def report(df: DataFrame, file_issues: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """One row for each symbol, columns REPORT; status FAIL (any critical issue), WARN or PASS.

    file_issues: symbol, code, severity of files that could not be checked; their
    symbols have a row without rows.  fixed: name the repairs that `repair` makes.
    """
    p = profile(df)
    has = lambda k: F.col(k) > 0
    n = lambda names: sum((has(k).cast("int") for k in names), F.lit(0))
    hours = F.expr("timestampdiff(HOUR, start_ts, end_ts)") + 1
    codes = F.array_join(F.array_compact(F.array(*(F.when(has(k), k) for k in sorted(CODES)))), ";")
    fixes = F.array_join(F.array_compact(F.array(*(F.when(has(k), x) for k, x in FIXES.items()))), ";") if fixed else F.lit("")
    out = p.withColumns({"critical_issues": n(c for c in CODES if c in CRITICAL), "warning_issues": n(WARNING), "issue_codes": codes, "fixes_applied": fixes})
    out = out.withColumns({"rows": F.col("row_count"), "start": F.col("start_ts"), "end": F.col("end_ts"), "coverage_pct": F.round(F.col("row_count") * 100.0 / hours, 3), "missing_candles": F.col("MISSING_HOURLY_CANDLES"), "largest_gap_start": F.col("largest_start"), "largest_gap_end": F.col("largest_end")})
    status = F.when(F.col("critical_issues") > 0, "FAIL").when(F.col("warning_issues") > 0, "WARN").otherwise("PASS")
    if file_issues is not None:
        f = file_issues.groupBy("symbol").agg(F.count_if(F.col("severity") == "CRITICAL").cast("int").alias("critical_issues"), F.count_if(F.col("severity") == "WARNING").cast("int").alias("warning_issues"), F.array_join(F.array_sort(F.collect_set("code")), ";").alias("issue_codes"))
        zero = {c: F.lit(0).cast("bigint") for c in ("rows", "missing_candles", "gap_count")}
        f = f.withColumns(zero | {"fixes_applied": F.lit("")}).join(out.select(F.col("symbol").alias("_s")), F.col("symbol") == F.col("_s"), "left_anti")
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("status", status).select(*REPORT)


def repair(df: DataFrame) -> DataFrame:
    """The three repairs: drop rows without time, equal rows, and later rows of a time.  Order is left to sinks."""
    return keep_first(df.where("ts is not null"))


def keep_first(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", row_number(["symbol", "ts"], ["row_idx"])).where("_n = 1").drop("_n")


def keep_last(df: DataFrame) -> DataFrame:
    return df.withColumn("_n", row_number(["symbol", "ts"], [F.desc("row_idx")])).where("_n = 1").drop("_n")


def numeric_valid(zero_prices: bool = False) -> Column:
    """Finite numbers, prices above zero (or from zero on), nothing else below zero."""
    ok = F.lit(True)
    for x in NUMBERS:
        v = F.col(x)
        low = v > 0 if x in PRICES and not zero_prices else v >= 0
        ok &= F.coalesce(low & ~infinite(v) & ~F.isnan(v.cast("double")), F.lit(False))
    return ok


def accepted(df: DataFrame) -> DataFrame:
    """Rows that pass ingestion: valid numbers and consistent prices."""
    return df.where(numeric_valid() & ~F.coalesce(inconsistent(), F.lit(True)))


def rejected(df: DataFrame) -> DataFrame:
    """Rows that do not pass, with the reason: invalid numbers before inconsistent prices."""
    reason = F.when(~numeric_valid(), "INVALID_NUMBER").when(F.coalesce(inconsistent(), F.lit(True)), "OHLC_INCONSISTENT")
    return df.withColumn("reason", reason).where("reason is not null")


def suspicious(df: DataFrame) -> DataFrame:
    """Bars without any trade whose prices all equal the close before: to be fetched again."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = df.withColumn("_close", F.lag("close").over(w))
    flat = (F.col("open") == F.col("_close")) & (F.col("high") == F.col("_close")) & (F.col("low") == F.col("_close")) & (F.col("close") == F.col("_close"))
    return d.where((F.col("volume") == 0) & (F.col("quote_volume") == 0) & (F.col("trades") == 0) & flat).drop("_close")


def replace_rows(df: DataFrame, fresh: DataFrame) -> DataFrame:
    """Take the fetched row wherever there is one for the symbol and time."""
    new = fresh.select(F.col("symbol").alias("_s"), F.col("ts").alias("_t"), *(F.col(c).alias(f"_{c}") for c in NUMBERS))
    j = df.join(new, (df["symbol"] == new["_s"]) & (df["ts"] == new["_t"]), "left")
    return j.select("symbol", "ts", *(F.when(F.col("_s").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in NUMBERS))


def internal_gaps(df: DataFrame) -> DataFrame:
    """Ranges to fetch: where the next bar is more than an hour away."""
    w = Window.partitionBy("symbol").orderBy("ts")
    d = df.select("symbol", "ts", F.lead("ts").over(w).alias("next_ts"))
    d = d.where("next_ts > ts + interval 1 hour")
    return d.select("symbol", F.expr("ts + interval 1 hour").alias("fetch_start"), F.expr("next_ts - interval 1 hour").alias("fetch_end"))


def merge_tables(old: DataFrame, new: DataFrame, prefer_new: bool = False) -> DataFrame:
    """Union of two candle tables, one row for each symbol and time; the old row wins unless told otherwise.

    Of several rows of one side the first by row_idx counts if both sides have it, and
    then the one with the least hash of all columns, so that the choice is the same each time.
    """
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_p") if prefer_new else F.asc("_p"), *(["row_idx"] if "row_idx" in both.columns else [])]
    return both.withColumn("_n", row_number(["symbol", "ts"], [*order, F.xxhash64(*sorted(c for c in both.columns if c != "_p"))])).where("_n = 1").drop("_n", "_p")


def warmed_up(df: DataFrame, subset: tuple[str, ...] = ("SMA_50", "ATR_14", "RSI_14")) -> DataFrame:
    return df.na.drop(subset=list(subset))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite values become null."""
    return df.withColumns({c: F.when(~infinite(F.col(c)), F.col(c)) for c in columns})


def infinite_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """symbol, ts, column, value of each infinite value: what `finite` takes out."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns))).alias("x")
    return df.select("symbol", "ts", cells).select("symbol", "ts", "x.column", "x.value").where(infinite(F.col("value")))


def fetched(df: DataFrame, ranges: DataFrame, fetch) -> DataFrame:
    """df and the bars that `fetch` returns for ranges (symbol, fetch_start, fetch_end), one row for each symbol and time; df's own win."""
    return merge_tables(df, fetch(ranges).select(*df.columns))


def ingested(df: DataFrame, fetch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candles as they are stored, the rows rejected, and totals by symbol.

    In order: one row for each time, gaps filled from `fetch` (a function from
    ranges of time to candles), bars without activity fetched again and replaced if
    they differ, rows with invalid numbers or inconsistent prices rejected (they leave
    a gap).  Totals: candles, gaps_filled, corrected, rejected.  The same steps repair
    a stored table.
    """
    own = keep_first(df) if "row_idx" in df.columns else df
    own = own.select(*CANDLE)
    whole = fetched(own, internal_gaps(own), fetch)
    doubt = suspicious(whole).select("symbol", F.col("ts").alias("fetch_start"), F.col("ts").alias("fetch_end"))
    fresh = fetch(doubt).select(*CANDLE)
    keys = ["symbol", "ts"]
    checked = replace_rows(whole, fresh)
    same = whole.select(*CANDLE).withColumn("_old", F.xxhash64(*NUMBERS)).select(*keys, "_old")
    changed = fresh.withColumn("_new", F.xxhash64(*NUMBERS)).join(same, keys).where("_old <> _new").groupBy("symbol").agg(F.count(F.lit(1)).alias("corrected"))
    out, bad = accepted(checked), rejected(checked)
    count = lambda d, name: d.groupBy("symbol").agg(F.count(F.lit(1)).alias(name))
    totals = count(out, "candles").join(count(whole.join(own.select(*keys), keys, "left_anti"), "gaps_filled"), "symbol", "full").join(changed, "symbol", "full").join(count(bad, "rejected"), "symbol", "full")
    return out, bad, totals.na.fill(0)


def lookback(df: DataFrame, hours: int = 730) -> DataFrame:
    """The bars of each symbol's last `hours` hours."""
    last = Window.partitionBy("symbol")
    d = df.withColumn("_last", F.max("ts").over(last))
    return d.where(F.expr(f"ts >= _last - make_dt_interval(0, {hours})")).drop("_last")
