"""Reward and metric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.schemas import MAX_TURNS, RUBRIC_COUNTERS, RUBRIC_FLAGS

# Reward of each rubric outcome, first match wins.
REWARD_CANT_PARSE = -2.0
REWARD_BAD_NAME = -1.9
REWARD_BAD_ARGS = -1.8
REWARD_INVALID_READ = -1.7
REWARD_NO_ANSWER_OUT_OF_TURNS = -0.5
REWARD_NO_ANSWER = -0.3
REWARD_PARTIAL = 0.05
REWARD_CORRECT = 1.0
REWARD_EFFICIENCY = 0.2
REWARD_WRONG_RIGHT_CONTRACT = -1.0
REWARD_WRONG = -1.2


def reward(max_turns: int = MAX_TURNS) -> Column:
    """F15/F16 as one CASE over rubric columns."""
    c = F.col
    partial = (F.when(c("ever_found_correct_contract_in_search"), REWARD_PARTIAL).otherwise(0.0)
               + F.when(c("ever_read_correct_contract"), REWARD_PARTIAL).otherwise(0.0))
    return (F.when(c("cant_parse_tool_call"), F.lit(REWARD_CANT_PARSE))
            .when(c("bad_tool_call_name"), F.lit(REWARD_BAD_NAME))
            .when(c("bad_tool_call_args"), F.lit(REWARD_BAD_ARGS))
            .when(c("tried_to_read_invalid_contract"), F.lit(REWARD_INVALID_READ))
            .when(~c("attempted_answer"),
                  F.when(c("ran_out_of_turns"), REWARD_NO_ANSWER_OUT_OF_TURNS).otherwise(REWARD_NO_ANSWER) + partial)
            .when(c("clause_text_correct") & c("found_correct_contract"),
                  F.lit(REWARD_CORRECT) + F.lit(REWARD_EFFICIENCY) * (1 - c("num_turns") / F.lit(float(max_turns))))
            .otherwise(F.when(c("found_correct_contract"), REWARD_WRONG_RIGHT_CONTRACT).otherwise(REWARD_WRONG)
                       + partial))


def with_reward(rubric: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    return rubric.withColumn("reward", reward(max_turns))


def metrics(rubric: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Flags as 0/1, counters kept, plus duration and reward."""
    r = with_reward(rubric, max_turns)
    return r.select("trajectory_id", "scenario_id", "status",
                    *[F.col(f).cast("int").alias(f) for f in RUBRIC_FLAGS],
                    *[F.col(c).cast("bigint").alias(c) for c in RUBRIC_COUNTERS],
                    "duration", "reward")
