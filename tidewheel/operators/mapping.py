"""Mapping ranked coins to exchange markets, and choosing coins to train on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: quote assets, best first, and symbols that are not mapped
QUOTE_PRIORITY = ["USDT", "FDUSD", "USDC", "BTC", "ETH", "BNB", "TRY", "EUR", "BRL"]
STABLECOINS = ["USDT", "USDC", "USDS", "USDE", "DAI", "FDUSD", "PYUSD", "FRAX", "TUSD", "USDG"]


def rank_of(quote: Column, priority: list[str]) -> Column:
    """Place in the priority list from 1; null if it is not there."""
    return F.nullif(F.array_position(F.array(*map(F.lit, priority)), quote), F.lit(0))


def best_markets(markets: DataFrame, priority: list[str] = QUOTE_PRIORITY) -> DataFrame:
    """Of each base asset's trading markets (symbol, base, quote, status, idx) the one with the best quote, else the first."""
    m = markets.where("status = 'TRADING'")
    w = Window.partitionBy("base").orderBy(rank_of(F.col("quote"), priority).asc_nulls_last(), "idx")
    return m.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def available(markets: DataFrame) -> DataFrame:
    """base and all its trading markets' symbols in order, joined by semicolons."""
    m = markets.where("status = 'TRADING'")
    return m.groupBy("base").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ";").alias("available_markets"))


#: fixed values: points and labels of a match's parts, and the scores from which a match is high and medium
POINTS = {"SYMBOL": 50, "FIRST_QUOTE": 20, "STABLE_QUOTE": 15, "TRADING": 10, "HIGH_VOLUME": 10, "GOOD_VOLUME": 5}
HIGH_VOLUME, GOOD_VOLUME = 1_000_000, 100_000
HIGH_SCORE, MEDIUM_SCORE = 90, 75


def confidence(symbol: Column, base: Column, quote: Column, status: Column, volume: Column, priority: list[str] = QUOTE_PRIORITY, stable: tuple[str, ...] = ("FDUSD", "USDC")) -> dict[str, Column]:
    """Score, level and reasons of a match."""
    first = quote == priority[0]
    same = F.upper(symbol) == F.upper(base)
    parts = [
        (same, POINTS["SYMBOL"], "SYMBOL"),
        (first, POINTS["FIRST_QUOTE"], priority[0]),
        (~first & quote.isin(*stable), POINTS["STABLE_QUOTE"], "STABLE_QUOTE"),
        (status == "TRADING", POINTS["TRADING"], "TRADING"),
        (volume > HIGH_VOLUME, POINTS["HIGH_VOLUME"], "HIGH_VOLUME"),
        ((volume > GOOD_VOLUME) & (volume <= HIGH_VOLUME), POINTS["GOOD_VOLUME"], "GOOD_VOLUME"),
    ]
    yes = lambda x: F.coalesce(x, F.lit(False))
    place = rank_of(quote, priority)
    score = sum((F.when(yes(x), n).otherwise(0) for x, n, _ in parts), F.greatest(F.lit(0), F.coalesce(11 - place, F.lit(0))))
    level = F.when(score >= HIGH_SCORE, "HIGH").when(score >= MEDIUM_SCORE, "MEDIUM").otherwise("LOW")
    reasons = F.array_join(F.array(*(F.when(yes(x), name) for x, _, name in parts)), ",")
    return {"score": score.cast("int"), "level": level, "reason": reasons}


def map_coins(ranking: DataFrame, markets: DataFrame, tickers: DataFrame, priority: list[str] = QUOTE_PRIORITY, stablecoins: list[str] = STABLECOINS) -> DataFrame:
    """Status and market of each ranked coin (rank, symbol).

    tickers: symbol, quote_volume (string or number; what is not a number counts as none).
    """
    best = best_markets(markets, priority).select(F.col("base"), F.col("symbol").alias("market"), "quote", F.col("status").alias("market_status"))
    t = tickers.select(F.col("symbol").alias("_t"), F.try_to_number(F.col("quote_volume"), F.lit("S999999999999D999999")).cast("double").alias("volume")) if dict(tickers.dtypes)["quote_volume"] == "string" else tickers.select(F.col("symbol").alias("_t"), F.col("quote_volume").cast("double").alias("volume"))
    j = ranking.join(best, F.upper(ranking["symbol"]) == best["base"], "left").join(available(markets).withColumnRenamed("base", "_b"), F.col("base") == F.col("_b"), "left")
    j = j.join(t, F.col("market") == F.col("_t"), "left")
    skip = F.upper(F.col("symbol")).isin(*stablecoins)
    c = confidence(F.col("symbol"), F.col("base"), F.col("quote"), F.col("market_status"), F.col("volume"), priority)
    none = F.col("market").isNull()
    status = F.when(skip, "STABLECOIN_SKIP").when(none, "NOT_LISTED").when(F.col("quote") == priority[0], "READY").otherwise(f"NON_{priority[0]}_PAIR")
    reason = F.when(skip, "Stablecoin").when(none, "No Spot Market").otherwise(c["reason"])
    own = ~skip & ~none
    return j.select(
        "rank",
        "symbol",
        status.alias("status"),
        F.when(own, c["score"]).alias("score"),
        F.when(own, c["level"]).alias("level"),
        reason.alias("reason"),
        F.when(own, F.col("market")).alias("market"),
        F.when(own, F.col("quote")).alias("quote"),
        F.when(own, F.col("available_markets")).alias("available_markets"),
    )


def listed_details(mapped: DataFrame, tickers: DataFrame) -> DataFrame:
    """mapped with last_price, volume_24h, trades_24h and price_change_24h of the market (null where none is listed)."""
    number = lambda c: F.col(c).cast("string").try_cast("double")
    t = tickers.select(F.col("symbol").alias("_t"), number("last_price").alias("last_price"), number("quote_volume").alias("volume_24h"), F.col("trades").cast("bigint").alias("trades_24h"), number("price_change_percent").alias("price_change_24h"))
    return mapped.join(t, mapped["market"] == t["_t"], "left").drop("_t")


def split_review(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coins that are mapped to a market, and those to look at: not listed, or skipped."""
    review = F.col("status").isin("NOT_LISTED", "STABLECOIN_SKIP")
    return mapped.where(~review), mapped.where(review)


def summary_text(mapped: DataFrame) -> str:
    """Totals, and the coins to look at by status; a line for each status."""
    ready, review = split_review(mapped)
    n, m = ready.count(), review.count()
    lines = [f"Total coins : {n + m}", f"Ready : {n}", f"Review : {m}"]
    if m:
        lines += ["", "Review by status"] + [f"{r['status']:<25}{r['n']}" for r in status_counts(review).collect()]
    return "\n".join(lines)


def pick(mapped: DataFrame, symbol: str | None = None, limit: int | None = None) -> DataFrame:
    """The coin with this symbol (in any case), and the best-ranked `limit` coins."""
    out = mapped if symbol is None else mapped.where(F.upper("symbol") == symbol.upper())
    return out if limit is None else out.orderBy("rank", "symbol").limit(limit)


def ready_coins(mapped: DataFrame) -> DataFrame:
    """Coins with status READY, best rank first."""
    return mapped.where("status = 'READY'").orderBy("rank", "symbol")


def with_rank_info(selected: DataFrame, mapped: DataFrame) -> DataFrame:
    """selected (symbol) with rank, status and market of the coin's first row by rank."""
    info = mapped.groupBy(F.col("symbol").alias("_s")).agg(F.min_by(F.struct("rank", "status", "market"), "rank").alias("i"))
    return selected.join(info, selected["symbol"] == info["_s"], "left").select(*(selected[c] for c in selected.columns), "i.rank", "i.status", "i.market")


def status_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status")


def select_top(mapped: DataFrame, n: int, have: DataFrame | None = None) -> DataFrame:
    """The best-ranked n coins that are READY, numbered, with whether data is at hand; n is clamped."""
    if n < 1:
        raise ValueError("n must be at least 1")
    ready = mapped.where("status = 'READY'")
    if ready.isEmpty():
        raise ValueError("no READY coin")
    top = ready.orderBy("rank", "symbol").limit(n)
    top = top.withColumn("selection_order", F.row_number().over(Window.orderBy("rank", "symbol")))  # n rows
    if have is None:
        return top.withColumn("available", F.lit(True))
    h = have.select(F.upper("symbol").alias("_h")).distinct()
    return top.join(h, F.upper(top["symbol"]) == h["_h"], "left").withColumn("available", F.col("_h").isNotNull()).drop("_h")


def snapshot(mapped: DataFrame, selected: DataFrame) -> DataFrame:
    """The ranking with a flag for the coins selected."""
    s = selected.select(F.col("symbol").alias("_s")).distinct()
    return mapped.join(s, mapped["symbol"] == s["_s"], "left").withColumn("selected", F.col("_s").isNotNull()).drop("_s")


def set_first_candle(mapped: DataFrame, firsts: DataFrame) -> DataFrame:
    """Update the first candle's time by market where it is newly known."""
    f = firsts.select(F.col("market").alias("_m"), F.col("first_candle").alias("_f"))
    base = mapped if "first_candle" in mapped.columns else mapped.withColumn("first_candle", F.lit(None).cast("timestamp"))
    return base.join(f, base["market"] == f["_m"], "left").withColumn("first_candle", F.coalesce("_f", "first_candle")).drop("_m", "_f")
