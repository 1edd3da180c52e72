"""Driver ``conversations`` -> logged runs: the assistant rows of a conversation
are the replies of one run, in order of (turn, text).

The table logs texts only, so calls are looked for in the text (JSON mode); a
NULL text is a failed reply.  Neither tokens nor times are logged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.schemas import MAX_TURNS

# Stand-in link to the scenarios: this many conversations in turn run the same one.
RUNS_PER_SCENARIO = 14


def turns(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """The ``TURNS`` table plus ``position`` (``turn`` of the conversation), the
    first ``max_turns`` replies of each conversation.  The limit on the row number
    reaches the tasks before the shuffle (at most ``max_turns`` rows of a
    conversation leave one), so a conversation of any length is cut over tasks.
    Rows without a ``conv_id`` belong to no run."""
    replies = conversations.where("role = 'assistant' AND conv_id IS NOT NULL").select("conv_id", "turn", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    first = replies.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_turns)
    none = F.lit(None)
    return first.select(
        F.col("conv_id").cast("string").alias("trajectory_id"),
        (F.floor(F.col("conv_id") / RUNS_PER_SCENARIO) + 1).cast("bigint").alias("scenario_id"),
        F.col("n").alias("turn"), F.lit(False).alias("use_tools"), F.col("text").isNull().alias("llm_failed"),
        F.col("text").alias("content"),
        F.array().cast("array<struct<id:string,name:string,arguments:string>>").alias("tool_calls"),
        none.cast("array<bigint>").alias("tool_result_ids"), none.cast("bigint").alias("prompt_tokens"),
        none.cast("bigint").alias("completion_tokens"), none.cast("timestamp").alias("ts"),
        F.col("turn").alias("position"))


def messages(conversations: DataFrame) -> DataFrame:
    """(trajectory_id, position, role, content) of every row of a conversation."""
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("string").alias("trajectory_id"), F.col("turn").alias("position"), "role",
        F.col("text").alias("content"))
