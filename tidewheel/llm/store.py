"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir()
    if kept:
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tidewheel-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def releasing(spark: SparkSession):
    """Shuffle files of what is written inside are deleted as soon as the write has ended, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a table of our own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The table stays until `discard` deletes it; a result that is read from it needs it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with releasing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` has made and nothing reads any more."""
    for t in tables:
        deleted(t.sparkSession, t.table_path)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text; two numbers."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("b")).first()
    return int(r["n"]), int(r["b"])


def parts_for(size: int, each: int = 16 << 20, least: int = 1) -> int:
    """Partitions of about `each` bytes."""
    return max(least, -(-size // each))


def tasks_for(size: int, each: int = 4 << 20, most_each: int = 128 << 20, aim: int = 20_000) -> int:
    """Partitions of about `each` bytes; once there are `aim` of them they grow instead, up to `most_each`."""
    return parts_for(size, max(each, min(most_each, size // aim)))
