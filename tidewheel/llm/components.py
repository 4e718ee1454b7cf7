"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.store import discard, written

#: a node's edges are dealt out over a part for each so many edges of the table, up to MOST_SALTS parts
EDGES_A_SALT = 4096
MOST_SALTS = 256


def salts_for(n: int) -> int:
    return max(1, min(MOST_SALTS, -(-n // EDGES_A_SALT)))


def star(e: DataFrame, large: bool, salts: int) -> DataFrame:
    """One round: link the neighbours of each node to the smallest of them.

    With more than one salt the edges of a node are spread by their other end: each
    part has its minimum, the minimum of those (a row for each part) is the node's,
    and goes back to the parts.  A hub of n edges puts n / salts of them in a task.
    """
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    if salts == 1:
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        joined = both.join(least, "u")
    else:
        both = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
        parts = both.groupBy("u", "s").agg(F.min("v").alias("p"))
        least = parts.groupBy("u").agg(F.least(F.col("u"), F.min("p")).alias("m"))
        joined = both.join(parts.select("u", "s").join(least, "u"), ["u", "s"])
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.unionByName(own).where("u > v").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 40) -> DataFrame:
    """Map each node of `edges` (a, b: bigint) to the smallest node reachable: columns node, component.

    Every round is native, and written to the shared folder; the round before it is
    deleted then.  Null ends and self-loops are ignored, repeated edges count once;
    other columns are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e = written(e, name)
    n, before = e.count(), None
    for _ in range(most_rounds):
        salts = salts_for(n)
        new = written(star(star(e, True, salts), False, salts), name)
        discard(e)
        e = new
        # A fixed point is a forest of stars: no node is both a child and a parent, and no child has two parents.
        r = e.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        n, now = r["n"], (r["n"], r["h"])
        if now == before or not n:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    children = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
