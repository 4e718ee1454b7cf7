"""Corpus preparation: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

A stage takes (spark, docs, sf_dir) and gives a DataFrame to write, which is the
next one's docs.  Every stage keeps the columns of documents (doc_id, text, lang,
source, n_chars; others are dropped) but for the last, which returns tokens.  Each
row is judged on its own: where doc_id does not name one row each, a stage numbers
the rows and joins its decisions on that number, so rows without a doc_id, and rows
that share one, are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.bpe import bpe_round_trip
from tidewheel.llm.decontam import contaminated
from tidewheel.llm.neardup import near_duplicates
from tidewheel.llm.queries import vocabulary
from tidewheel.llm.rules import quality_rules
from tidewheel.llm.store import discard, written
from tidewheel.llm.suffix import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `key`, a number for each row that rises with doc_id.

    That is doc_id itself where no row lacks it and no two share it.  Else rows are
    sorted by doc_id (null ids last) and numbered in a written table.
    """
    rows = docs.select(*COLUMNS)
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1)
    if not twice.count():
        return rows.withColumn("key", F.col("doc_id").cast("bigint"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def by_key(docs: DataFrame, *more: str) -> DataFrame:
    """docs as operators take them: the key is the id."""
    return docs.selectExpr("key as doc_id", "text", "lang", "source", *more)


def only(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose key is (left_semi) or is not (left_anti) a doc_id of keys."""
    keys = keys.select(F.col("doc_id").alias("k"))
    return docs.join(keys, docs["key"] == keys["k"], how).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, wordless and short texts, repetitive ones, and outliers of their language and source.

    Equal rows get the same verdict.  An empty table stays empty.
    """
    docs = keyed(docs)
    return only(docs, quality_rules(by_key(docs)).where("kept"), "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the first by doc_id (rows without one come last).

    Of repeated rows one stays.  Null and wordless texts are in no group and stay.
    """
    docs = keyed(docs)
    return only(docs, near_duplicates(by_key(docs), shingle=5, percent=80).where("kept"), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes that an earlier document has go; n_chars says what is left.

    A character that loses a byte goes with it.  One row for each row: a document
    that repeats others as a whole stays with an empty text, and so does a null text.
    """
    docs = keyed(docs)
    out = suffix_dedup(by_key(docs, "doc_id as id"), width=100, keep_text=True, carry=["id", "lang", "source"])
    return out.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 percent of a benchmark item go; null and short texts hold none."""
    docs = keyed(docs)
    pairs = contaminated(by_key(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=80)
    return only(docs, pairs.select("doc_id").distinct(), "left_anti")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids; a row for each row, null texts as empty ones."""
    return bpe_round_trip(docs, vocabulary(), keep_ids=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near), ("repeated_passages", passages), ("benchmark_leaks", leaks), ("tokens", tokens)]

#: the second, third and last stage are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next, which then deletes it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
