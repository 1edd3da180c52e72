"""Fold of logged turns into one row per run.

The turns are shuffled once, by run.  Where a run ends follows from its turns
alone, so the window for the first terminal turn and the fold share that
partitioning; only the kept turns' facts (at most ``max_turns`` of each) go on.
Target contract, verdict and existence of the ids read are then joined once per
run, not per turn: a scenario that a third of all runs share meets one short
row for each of them, and AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators.runs import decided_turns, kept_turns, verdict_of
from pactum.schemas import MAX_TURNS


def run_facts(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per run of what its own turns say: flags, token sums, the ids
    found and read, the answer, and where it ended.  One shuffle."""
    b = F.bool_or
    answer = F.struct("turn", "answer_text", "answer_contract_id", "f_dont_know", "judgeable")
    return kept_turns(decided_turns(turns, max_turns)).groupBy("trajectory_id").agg(
        F.first("scenario_id").alias("scenario_id"), F.first("use_tools").alias("use_tools"),
        F.max("_end").alias("_end"), F.max("_n").alias("_n"), F.max_by("outcome", "turn").alias("_last_outcome"),
        F.flatten(F.collect_list("found_ids")).alias("found_ids"), F.collect_set("read_id").alias("read_ids"),
        F.max(F.when(F.col("f_attempted"), answer)).alias("answer"),
        b("f_cant_parse").alias("cant_parse_tool_call"), b("f_bad_name").alias("bad_tool_call_name"),
        b("f_bad_args").alias("bad_tool_call_args"),
        F.sum("p_tokens").alias("prompt_tokens"), F.sum("c_tokens").alias("completion_tokens"),
        # independent of the session time zone (works on TIMESTAMP and TIMESTAMP_NTZ)
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("duration"))


def fold_runs(turns: DataFrame, scenarios: DataFrame, contract_ids: DataFrame,
              judge_replies: DataFrame | None = None, max_turns: int = MAX_TURNS) -> DataFrame:
    """The rubric of every run, equal to ``runs.rubric(runs.classified_turns(..))``:
    the 16 fields, ``status``, ``stop_reason`` and ``duration``.  (trajectory_id,
    turn) is a key of ``turns`` and of ``judge_replies``, ``scenario_id`` one of
    ``scenarios`` and ``contract_id`` one of ``contract_ids``.  A run whose
    scenario is missing has no target: it finds and reads nothing right."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    runs = run_facts(turns, max_turns)
    # The reads of ids that don't exist, as the runs that made them.
    reads = runs.select("trajectory_id", F.explode("read_ids").alias("contract_id"))
    invalid = (reads.join(contract_ids.select("contract_id"), "contract_id", "left_anti")
               .select("trajectory_id", F.lit(True).alias("_invalid")).distinct())
    runs = runs.join(invalid, "trajectory_id", "left")
    # A run has at most one answer; its reply is picked from the run's few.
    if judge_replies is not None:
        reply = F.struct("turn", "reply", "judge_prompt_tokens", "judge_completion_tokens")
        logged = (judge_replies.where(c("turn") <= max_turns).groupBy("trajectory_id")
                  .agg(F.collect_list(reply).alias("_replies")))
        runs = runs.join(logged, "trajectory_id", "left").withColumn(
            "_reply", F.try_element_at(F.filter("_replies", lambda r: r["turn"] == c("answer")["turn"]), F.lit(1)))
    else:
        runs = runs.withColumn("_reply", F.lit(None).cast(
            "struct<reply:string,judge_prompt_tokens:bigint,judge_completion_tokens:bigint>"))
    # The scenario, once per run.
    scen = scenarios.select("scenario_id", c("contract_id").alias("target"),
                            c("ground_truth_clause_text").alias("truth"))
    runs = runs.join(scen, "scenario_id", "left")
    answer = c("answer")
    judged = yes(answer["judgeable"]) & yes(F.length("truth") > 0)
    tokens = lambda n: F.when(judged, F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint")
    out_of_turns = c("_end").isNull() & (c("_n") >= max_turns)
    return runs.select(
        "trajectory_id", "scenario_id", "use_tools",
        F.when(c("_end").isNotNull() | out_of_turns, "valid").otherwise("incomplete").alias("status"),
        F.when(out_of_turns, "out_of_turns").when(c("_end").isNotNull(), c("_last_outcome"))
        .otherwise("incomplete").alias("stop_reason"),
        (judged & verdict_of(c("_reply")["reply"])).alias("clause_text_correct"),
        yes(~answer["f_dont_know"] & (answer["answer_contract_id"] == c("target"))).alias("found_correct_contract"),
        F.coalesce("_end", F.when(out_of_turns, F.lit(max_turns + 1)), "_n").cast("bigint").alias("num_turns"),
        answer.isNotNull().alias("attempted_answer"), yes(answer["f_dont_know"]).alias("returned_i_dont_know"),
        yes(F.array_contains("found_ids", c("target"))).alias("ever_found_correct_contract_in_search"),
        yes((c("target") > 0) & F.array_contains("read_ids", c("target"))).alias("ever_read_correct_contract"),
        (yes(c("_invalid")) | F.exists("read_ids", lambda x: x <= 0)).alias("tried_to_read_invalid_contract"),
        "cant_parse_tool_call", "bad_tool_call_name", "bad_tool_call_args", out_of_turns.alias("ran_out_of_turns"),
        "prompt_tokens", "completion_tokens",
        tokens(c("_reply")["judge_prompt_tokens"]).alias("judge_prompt_tokens"),
        tokens(c("_reply")["judge_completion_tokens"]).alias("judge_completion_tokens"),
        "duration")
