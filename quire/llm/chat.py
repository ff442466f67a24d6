"""Perspective rotation of multi-party dialogues, in native expressions.

Each participant in turn is the assistant: its messages are rendered as the assistant's and trained on, the others' as
those of named users. System messages stay the system's and are nobody's perspective.

A dialogue is rendered whole unless `most` is given: then it is cut, in the order of its messages, into parts of that many,
so that no row and no group grows with the longest conversation there is. Messages of conversations that need cutting are
range-partitioned in their order; a message's number is its place in its partition's run of the conversation, plus the
sizes of the runs before. So a conversation that holds most of all rows is numbered by as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import materialise

# The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LAST_TURN = 2**63 - 1


ORDER = ["conv_id", "turn", "role", "text"]


def _broken(x: Column) -> Column:
    """A text in which no mark of the format stands."""
    return F.replace(x, F.lit("<|im_"), F.lit("<| im_"))


def _head(role: Column, speaker: Column) -> Column:
    user = F.concat(F.lit("user name="), _broken(F.translate(role, "\n\r", "  ")))
    name = F.when(role.eqNullSafe(speaker), "assistant").when(role == "system", "system").otherwise(F.coalesce(user, F.lit("user")))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def _cut(m: DataFrame, most: int) -> DataFrame:
    """m with part: the number of a message in its conversation, divided by most. Only conversations of more are numbered."""
    sizes = m.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    long = m.join(sizes, same, "left_semi")
    placed = long.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    placed = materialise(placed.withColumns({"run": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "messages")
    runs = placed.groupBy("conv_id", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), (before - F.col("first")).alias("shift"))
    numbered = placed.join(runs, same & (F.col("run") == F.col("r")))
    numbered = numbered.select(*ORDER, F.floor((F.col("at") + F.col("shift")) / most).cast("long").alias("part"))
    return m.join(sizes, same, "left_anti").select(*ORDER, F.lit(0).cast("long").alias("part")).unionByName(numbered)


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int | None = None) -> DataFrame:
    """conv_id, speaker, part, n_messages, rendered, masks: a row per conversation, speaker and part.

    masks are the spans (code points of rendered, end exclusive) of what is trained on: the speaker's messages with
    their closing mark. part is 0 unless the conversation has more than `most` messages; it then counts the parts in order.
    Marks inside texts and names are broken by a space, line breaks in names become spaces. Null and empty texts are empty
    messages, very long ones stay whole. Messages without a role are those of one speaker, null, shown as a user without a
    name. Null turns come last, and null conversations are one conversation. Rows repeated in full count once; ties in
    the turn go by role, null first, then by text. Other columns are ignored, whatever their names; no rows give no rows.
    """
    m = messages.select(
        messages[conv].alias("conv_id"),
        F.coalesce(messages[turn].cast("long"), F.lit(LAST_TURN)).alias("turn"),
        messages[role].cast("string").alias("role"),
        F.coalesce(messages[text].cast("string"), F.lit("")).alias("text"),
    ).distinct()
    m = m.withColumn("part", F.lit(0).cast("long")) if most is None else _cut(m, most)
    parts = m.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = m.where("role is null or role != 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    out = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    shown = F.transform("messages", lambda x: F.struct(x["role"].eqNullSafe(F.col("speaker")).alias("own"), _head(x["role"], F.col("speaker")).alias("head"), F.concat(_broken(x["text"]), F.lit(CLOSE)).alias("body")))
    out = out.withColumn("shown", shown)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))

    def step(done: Column, x: Column) -> Column:
        begin = done["at"] + F.length(x["head"])
        end = begin + F.length(x["body"])
        span = F.struct(begin.alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(done["masks"], F.array(span))).otherwise(done["masks"]).alias("masks"))

    rendered = F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"])), "")
    masks = F.aggregate("shown", start, step, lambda done: done["masks"])
    return out.select("conv_id", "speaker", "part", F.size("messages").alias("n_messages"), rendered.alias("rendered"), masks.alias("masks"))
