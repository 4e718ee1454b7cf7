"""Live tickers: two streams merged into the latest state of each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.operators.quality import merge_tables
from tidewheel.sources.candles import read_or_empty

#: field names differ in case alone, so the data are a map
ENVELOPE = "stream string, data map<string, string>"
MINI = {"last_price": "c", "open": "o", "high": "h", "low": "l", "volume": "v", "quote_volume": "q"}
BOOK = {"bid_price": "b", "bid_qty": "B", "ask_price": "a", "ask_qty": "A"}
FIELDS = [*MINI, *BOOK]
OUT = "symbol string, event_ms bigint, seq bigint, " + ", ".join(f"{f} string" for f in FIELDS)


def messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parsed messages; malformed lines, unknown streams and messages without a symbol are left out.

    lines has the JSON text, seq (order of arrival) and ingest_ms, which stands in for a missing event time.
    """
    field = lambda k: F.try_element_at(F.col("m.data"), F.lit(k))
    d = lines.select(F.from_json(column, ENVELOPE).alias("m"), "seq", "ingest_ms").where(field("s").isNotNull())
    kind = F.when(F.col("m.stream").endswith("@miniTicker"), "mini").when(F.col("m.stream").endswith("@bookTicker"), "book")
    d = d.withColumn("kind", kind).where("kind is not null")
    pick = [F.when(F.col("kind") == kind_, F.coalesce(field(k), F.lit(""))).alias(f) for kind_, names in (("mini", MINI), ("book", BOOK)) for f, k in names.items()]
    return d.select(F.upper(field("s")).alias("symbol"), "kind", F.coalesce(field("E").try_cast("bigint"), "ingest_ms").alias("event_ms"), "seq", *pick)


def merged_batch(msgs: DataFrame, emit_on: str = "any") -> DataFrame:
    """The state after each message, from the first message on by which both streams have reported.

    emit_on: "any" message, or only "mini" ones.
    """
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    d = msgs.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in FIELDS})
    d = d.where("last_price is not null and bid_price is not null")
    d = d if emit_on == "any" else d.where("kind = 'mini'")
    return d.select("symbol", "event_ms", "seq", *FIELDS)


def merged_stream(msgs: DataFrame, emit_on: str = "any", idle_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream: state by symbol, dropped after idle_ms without a message."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        m = pd.concat(list(frames)).sort_values("seq")
        held = pd.DataFrame([state.get if state.exists else (None,) * len(FIELDS)], columns=FIELDS, dtype=object)
        # the last value of each field so far, the state's coming before the batch's
        whole = pd.concat([held, m[FIELDS].astype(object)], ignore_index=True).ffill()
        now = whole.iloc[1:].reset_index(drop=True)
        state.update(tuple(None if pd.isna(v) else v for v in whole.iloc[-1]))
        state.setTimeoutDuration(idle_ms)
        said = now["last_price"].notna() & now["bid_price"].notna()
        if emit_on != "any":
            said &= (m["kind"] == "mini").to_numpy()
        yield pd.concat([m[["event_ms", "seq"]].reset_index(drop=True), now], axis=1)[said].assign(symbol=key[0])[["symbol", "event_ms", "seq", *FIELDS]]

    schema = ", ".join(f"{f} string" for f in FIELDS)
    return msgs.groupBy("symbol").applyInPandasWithState(step, OUT, schema, "append", GroupStateTimeout.ProcessingTimeTimeout)


def sampled(states: DataFrame, seconds: int = 1) -> DataFrame:
    """The last state of each symbol in each interval."""
    tick = F.floor(F.col("event_ms") / (1000 * seconds))
    return states.groupBy("symbol", tick.alias("tick")).agg(*(F.max_by(f, "seq").alias(f) for f in FIELDS))


def append_candles(batches: DataFrame, path: str, checkpoint: str, hours: int = 730):
    """Incremental ingestion: each micro-batch is merged into the months it touches, and later runs go on from the checkpoint.

    The last bar of the table is written again with its new values, never dropped.
    """
    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("month", F.date_format("ts", "yyyy-MM"))
        months = [r["month"] for r in new.select("month").distinct().collect()]
        if not months:
            return
        old = read_or_empty(spark, path, new.schema).where(F.col("month").isin(months))
        # files that are replaced stay until the write commits, so lost tasks can read them again
        both = merge_tables(old.select(new.columns), new, prefer_new=True)
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

    return batches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
