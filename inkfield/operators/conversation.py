"""Conversation prompts: the history of a session in front of its next message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns per block. Blocks bound what one task sorts and joins of a single session.
BLOCK_TURNS = 256


def line(role="role", text="text") -> Column:
    return F.concat(F.when(F.col(role) == "user", "User: ").otherwise("Assistant: "), F.col(text))


def conversation_prompts(
    messages: DataFrame, *, session: str = "session_id", turn: str = "turn", role: str = "role", text: str = "text",
    max_turns: int | None = None,
) -> DataFrame:
    """The prompt at each user message: earlier turns, then the message; alone it stands bare.

    A prompt holds the whole history, so the output of a session grows with the square of its turns;
    ``max_turns`` keeps the latest turns only. The work is cut into blocks of turns: history within a
    block by a window over the block, the blocks before by a window over one row per block. So a session
    that owns a large share of all messages is spread over many tasks.
    """
    rows = messages.select(
        F.col(session).alias("session_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"),
        F.col(text).alias("text"),
    ).withColumn("line", line("role", "text"))
    is_user = F.col("role") == "user"
    if max_turns is not None:
        w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-max_turns, -1)
        past = F.array_join(F.collect_list("line").over(w), "\n")
        return _prompt(rows.withColumn("past", F.nullif(past, F.lit(""))), is_user)
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    inside = Window.partitionBy("session_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.collect_list("line").over(inside))
    blocks = rows.groupBy("session_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda e: e["line"]), "\n").alias("whole")
    )
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = blocks.select("session_id", "block", F.collect_list("whole").over(before).alias("far"))
    # Most sessions have one block and nothing before it.
    # Histories grow beyond what the planner expects of their input, so they are not broadcast.
    far = far.where(F.size("far") > 0).hint("merge")
    joined = near.join(far, ["session_id", "block"], "left")
    parts = F.concat(F.coalesce("far", F.array().cast("array<string>")), F.col("near"))
    return _prompt(joined.withColumn("past", F.when(F.size(parts) > 0, F.array_join(parts, "\n"))), is_user)


def _prompt(rows: DataFrame, is_user: Column) -> DataFrame:
    prompt = F.when(F.col("past").isNull(), F.col("text")).otherwise(
        F.concat(F.col("past"), F.lit("\nUser: "), F.col("text"))
    )
    return rows.where(is_user).select("session_id", "turn", prompt.alias("prompt"))
