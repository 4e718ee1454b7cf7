"""Samples whose size has a bound whatever the size of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = 2**63 - 1


def threshold(n: int, most: int) -> int:
    """The signed 64-bit hash up to which about 2 * most + 20 of n evenly spread hashes lie; ALL if there are no more."""
    wanted = 2 * most + 20
    return ALL if n <= wanted else -(2**63) + wanted * 2**64 // n


def least_hashed(df: DataFrame, of: Column, most: int, by: str, text: str = "text") -> DataFrame:
    """by, text: of each group of `by`, at most `most` rows, those with the least 64-bit hash `of`.

    Rows of a group with one hash count as one row, that with the least text.  A
    threshold that follows from the approximate number of hashes leaves about twice
    as many as are wanted, so that only those are sorted; groups come in at most a
    few thousand (the caller sees to it).
    """
    hashed = df.withColumn("_h", of)
    counts = {r[0]: r[1] for r in hashed.groupBy(by).agg(F.approx_count_distinct("_h")).collect()}
    if not counts:
        return df.select(by, text).limit(0)
    limits = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(threshold(n, most)))])
    few = hashed.where(F.col("_h") <= F.element_at(limits, F.col(by))).groupBy(by, "_h").agg(F.min(text).alias(text))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h"))
    return few.withColumn("_n", rank).where(F.col("_n") <= most).select(by, text)
