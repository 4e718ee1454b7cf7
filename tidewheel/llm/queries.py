"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidewheel.llm.bpe import bpe_round_trip
from tidewheel.llm.chat import perspectives
from tidewheel.llm.decontam import contaminated
from tidewheel.llm.fpindex import substring_dedup
from tidewheel.llm.gam import fit_quality, score_quality
from tidewheel.llm.langid import fit, predict
from tidewheel.llm.neardup import near_duplicates
from tidewheel.llm.rules import quality_rules
from tidewheel.llm.sql import SQL  # noqa: F401
from tidewheel.llm.suffix import suffix_dedup
from tidewheel.llm.warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The place of the byte-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fold(n: int, i: int):
    """Whether a document is in fold i of n; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == i, F.lit(False))


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = fit(docs.where(F.col("doc_id").isNotNull() & ~fold(4, 2)))
    out = predict(docs, filters)
    return out.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~fold(5, 0)))
    out = score_quality(docs, model, 0.3)
    return out.select("doc_id", fold(5, 0).alias("held_out"), "score", "predicted")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), width=100)


def op10_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_perspectives,
        op2_language_id,
        op3_quality_rules,
        op4_bpe_round_trip,
        op5_minhash_neardup,
        op6_benchmark_leaks,
        op7_warc_round_trip,
        op8_suffix_dedup,
        op9_quality_gam,
        op10_fingerprint_dedup,
    )
}
