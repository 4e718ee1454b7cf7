"""Quality rules whose thresholds adapt to each language and source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import kernels as K
from tidewheel.llm.store import written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: name, numerator, denominator, whether values under the fence fail too
RATES = [
    ("symbol_rate", "n_symbols", "n_words", False),
    ("dup_line_rate", "n_dup_lines", "n_words", False),
    ("repeat_rate", "n_repeat_words", "n_words", False),
    ("word_length", "word_chars", "n_words", True),
]
#: a rate in 1/1000; bins are exact to BIN_BITS binary digits, so that quantiles are off by 1/2**BIN_BITS at most
SCALE = 1000
BIN_BITS = 5
#: a group smaller than this takes the thresholds of its language, and a language of the whole corpus
LEAST_ROWS = 200
#: fences stand REACH spreads beyond the quartiles; a spread is at least LEAST_SPREAD (in 1/1000)
REACH = 4
LEAST_SPREAD = {"symbol_rate": 25, "dup_line_rate": 10, "repeat_rate": 50, "word_length": 1000}


def count_batches(batches):
    for rows, data, offsets in K.blocks(batches):
        c = K.text_counts(data, offsets)
        yield pa.RecordBatch.from_arrays([*rows.columns[:1], *rows.columns[2:], *(pa.array(c[k]) for k in COUNTS)], [rows.schema.names[0], *rows.schema.names[2:], *COUNTS])


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five base counts of each whole text (a null text has none)."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return d.mapInArrow(count_batches, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def bin_of(v):
    """The bin of a whole number: exact below 2**(BIN_BITS + 1), then BIN_BITS digits after the leading one.

    The digits dropped are counted by comparison, so that every engine agrees.
    """
    over = sum(((v >= (1 << (BIN_BITS + 1 + i))).cast("bigint") for i in range(1, 40)), (v >= (1 << (BIN_BITS + 1))).cast("bigint"))
    return over * (1 << BIN_BITS) + F.floor(v / F.pow(F.lit(2.0), over)).cast("bigint")


def value_of(b):
    """The least number of a bin."""
    over = F.greatest(F.floor(b / (1 << BIN_BITS)).cast("bigint") - 1, F.lit(0))
    return ((b - over * (1 << BIN_BITS)) * F.pow(F.lit(2.0), over)).cast("bigint")


def rates(counts: DataFrame) -> DataFrame:
    """The counts with each rate in whole thousandths; null where there are no words."""
    return counts.withColumns({name: F.when(F.col(d) > 0, F.floor(F.col(n) * SCALE / F.col(d)).cast("bigint")) for name, n, d, _ in RATES})


def sketches(rated: DataFrame) -> DataFrame:
    """One row for each lang, source, rate and bin: a quantile sketch that merges by adding counts."""
    names = ", ".join(f"'{r[0]}', {r[0]}" for r in RATES)
    long = rated.select("lang", "source", F.expr(f"stack({len(RATES)}, {names}) as (rate, value)")).where("value is not null")
    return long.groupBy("lang", "source", "rate", bin_of(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches up to `by` and read off the quartiles: columns q1, q3, rows."""
    from pyspark.sql import Window

    s = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rate")
    s = s.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bin")))
    q = lambda p: value_of(F.min(F.when(F.col("upto") * 4 >= F.col("rows") * p, F.col("bin"))))
    return s.groupBy(*by, "rate").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("rows").alias("rows"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and, for each rate, the least and the largest value that passes."""
    group = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch, ["lang"]).select("lang", "rate", *(F.col(c).alias(f"l_{c}") for c in ("q1", "q3", "rows")))
    whole = quartiles(sketch, []).select("rate", *(F.col(c).alias(f"w_{c}") for c in ("q1", "q3")))
    same = group["lang"].eqNullSafe(lang["lang"]) & (group["rate"] == lang["rate"])
    all_ = group.join(lang, same).select(group["*"], "l_q1", "l_q3", "l_rows").join(whole, "rate")
    pick = lambda c: F.when(F.col("rows") >= LEAST_ROWS, F.col(c)).when(F.col("l_rows") >= LEAST_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    spread = F.create_map(*[x for k, v in LEAST_SPREAD.items() for x in (F.lit(k), F.lit(v))])
    t = all_.select("lang", "source", "rate", pick("q1").alias("q1"), pick("q3").alias("q3"), F.element_at(spread, F.col("rate")).alias("least"))
    reach = F.greatest(F.col("q3") - F.col("q1"), F.col("least")) * REACH
    t = t.select("lang", "source", "rate", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))
    wide = [F.max(F.when(F.col("rate") == name, F.col(s))).alias(f"{name}_{s}") for name, *_ in RATES for s in ("lo", "hi")]
    return t.groupBy("lang", "source").agg(*wide)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge each document by rates of its base counts against fences of its language and source.

    Rates are summed up by sketches (counts by bins of bounded relative width)
    that merge exactly: lang and source, then lang, then the whole corpus.  A
    rate fails beyond REACH interquartile ranges from the quartiles of its group,
    so a clean group loses nothing; groups with fewer than LEAST_ROWS rows take
    their language's fences, then the corpus's.

    Returns doc_id, the base counts, base_failed (fewer than 10 words, or more
    than a fifth of the words in repeated windows), kept, and the rates.  A null
    text has no words and fails; null lang or source is a group like any other;
    an empty table gives no rows; rows with one id are judged one by one.
    """
    counts = rates(written(base_counts(docs), "rules-counts"))
    t = thresholds(sketches(counts)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = counts.join(t, counts["lang"].eqNullSafe(t["t_lang"]) & counts["source"].eqNullSafe(t["t_source"]), "left")
    base_failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    inside = F.lit(True)
    for name, _, _, both in RATES:
        inside &= F.coalesce(F.col(name) <= F.col(f"{name}_hi"), F.lit(True))
        if both:
            inside &= F.coalesce(F.col(name) >= F.col(f"{name}_lo"), F.lit(True))
    return joined.select("doc_id", *COUNTS, base_failed.alias("base_failed"), (~base_failed & inside).alias("kept"), *(r[0] for r in RATES))
