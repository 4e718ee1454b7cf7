"""Chat formatting: every participant's perspective on a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.store import parts_for, written

#: fixed values: the turn markers of the rendered format
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: messages in one rendered part
PART = 64
#: roles that set the scene and are nobody's perspective
CONTEXT = ("system",)


def positions(messages: DataFrame) -> DataFrame:
    """Number each conversation's messages from 0 by turn, role and text, whatever its length.

    The table is range-sorted, so a long conversation spans tasks; a message's
    number is its place in its task plus what earlier tasks hold of the
    conversation.  Equal messages are interchangeable and are spread out too.
    """
    rows = messages.count()
    keys = ["conv_id", "turn", "role", "text", "tie"]
    spread = messages.withColumn("tie", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    run = spread.repartitionByRange(parts_for(rows, 100_000), *keys).sortWithinPartitions(*keys)
    run = written(run.withColumns({"task": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "chat-sorted")
    held = run.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    joined = run.join(held, run["conv_id"].eqNullSafe(held["c"]) & (run["task"] == held["k"]))
    return joined.select("conv_id", "turn", "role", "text", (F.col("place") - F.col("first") + F.col("earlier")).alias("pos"))


def safe(text: Column) -> Column:
    """Text that cannot open or close a turn."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(messages: DataFrame, part: int = PART, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """Render each conversation once for every participant, who is its assistant; the others are users with names.

    Returns one row for each conversation, perspective and part of `part`
    consecutive messages: conv_id, perspective, part, n_messages, n_target (spoken
    by the perspective), rendered, mask ("start-end" ranges of code points of
    rendered that are learned: the assistant's words and end marker) and
    target_chars.  Parts in order make up the whole dialogue, so nothing is cut off and no
    conversation has to fit into one task.

    Messages are in order of turn, role, text, nulls first; repeated rows are
    repeated messages.  A null text is an empty message, a null role is "unknown",
    and rows without conv_id are one conversation.  Roles in `context` take part in
    every rendering but have no perspective; a conversation of them alone has none.
    Markers inside texts and names are broken up, and line breaks in names are spaces.  Empty tables give no rows; other columns
    are ignored.
    """
    m = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    m = positions(m)
    who = m.where(~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = m.join(who, m["conv_id"].eqNullSafe(who["c"])).drop("c")
    mine = F.col("role") == F.col("perspective")
    head = F.when(mine, F.lit("assistant")).when(F.col("role").isin(*context), F.col("role")).otherwise(F.concat(F.lit("user name="), F.translate(safe(F.col("role")), "\r\n", "  ")))
    seen = seen.select(
        "conv_id",
        "perspective",
        F.floor(F.col("pos") / part).alias("part"),
        "pos",
        mine.cast("int").alias("mine"),
        F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
        F.concat(safe(F.col("text")), F.lit(CLOSE)).alias("body"),
    )
    own = ["conv_id", "perspective", "part"]
    upto = Window.partitionBy(*own).orderBy("pos")
    size = F.length("head") + F.length("body") + 1
    seen = seen.withColumn("end", F.sum(size).over(upto) - 1)
    start = F.col("end") - F.length("body")
    line = F.struct("pos", F.concat("head", "body", F.lit("\n")).alias("line"), F.when(F.col("mine") == 1, F.concat_ws("-", start, F.col("end"))).alias("span"))
    whole = seen.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum("mine").cast("bigint").alias("n_target"),
        F.array_sort(F.collect_list(line)).alias("lines"),
        F.sum(F.col("mine") * F.length("body")).cast("bigint").alias("target_chars"),
    )
    return whole.select(*own, "n_messages", "n_target", F.array_join("lines.line", "").alias("rendered"), F.array_join("lines.span", ",").alias("mask"), "target_chars")
