"""Trajectories as nested rows (P16) and their place in the training schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.operators.ids import group_row_number
from pactum.operators.search import stable_double

MEAN_PLACES = 9


def trajectories(messages: DataFrame, turns: DataFrame, metrics: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per run: its ordered ``messages`` up to the last turn that ran,
    ``metadata`` of its scenario (NULL fields if it is missing), ``metrics`` and
    ``reward``.  ``turns`` gives the position of each reply; messages behind the
    last one are dropped before they are shuffled into rows.  Equal positions are
    in order of (role, content)."""
    ran = metrics.select("trajectory_id", "num_turns")
    ends = (turns.join(ran, "trajectory_id").where(F.col("turn") <= F.col("num_turns"))
            .groupBy("trajectory_id").agg(F.max("position").alias("_last")))
    said = (messages.join(ends, "trajectory_id").where(F.col("position") <= F.col("_last"))
            .groupBy("trajectory_id")
            .agg(F.array_sort(F.collect_list(F.struct("position", "role", "content"))).alias("_m")))
    s = scenarios.select("scenario_id", "contract_id", "contract_title", "clause_type", "annotation_id")
    keys = ("trajectory_id", "scenario_id", "reward")
    meta = F.struct("scenario_id", "contract_id", "contract_title", F.col("clause_type").alias("target_clause_type"),
                    "annotation_id")
    return (metrics.join(said, "trajectory_id", "left").join(s, "scenario_id", "left").select(
        "trajectory_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
        .alias("messages"), meta.alias("metadata"),
        F.struct(*[c for c in metrics.columns if c not in keys]).alias("metrics"), "reward"))


def assign_runs(runs: DataFrame, schedule: DataFrame) -> DataFrame:
    """The i-th run of a scenario (by ``trajectory_id``) takes its i-th slot of the
    schedule (by ``global_step``, ``run_idx``).  Slots without a run have a NULL
    ``trajectory_id``, runs without a slot a NULL ``global_step``.  Runs are
    numbered without a window per scenario, which may hold any share of the runs;
    the slots of a scenario are bounded by epochs and runs per group."""
    numbered = group_row_number(runs.where("scenario_id IS NOT NULL").select("scenario_id", "trajectory_id"),
                                ["scenario_id"], ["trajectory_id"], "slot")
    order = Window.partitionBy("scenario_id").orderBy("global_step", "run_idx")
    slots = schedule.select("scenario_id", "global_step", "run_idx", F.row_number().over(order).cast("bigint").alias("slot"))
    loose = runs.where("scenario_id IS NULL").select("scenario_id", "trajectory_id", F.lit(None).cast("bigint").alias("global_step"),
                                                     F.lit(None).cast("bigint").alias("run_idx"))
    return slots.join(numbered, ["scenario_id", "slot"], "full").drop("slot").unionByName(loose)


def step_groups(assigned: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per (global_step, scenario_id) the slots, runs and missing runs, the mean
    reward and the runs in order of ``run_idx``.  Surplus runs are counted in the
    scenario's group with a NULL ``global_step``, whose list of runs is empty."""
    c = F.col
    in_slot = c("run_idx").isNotNull() & c("trajectory_id").isNotNull()
    rows = assigned.join(metrics.select("trajectory_id", "reward"), "trajectory_id", "left")
    return rows.groupBy("global_step", "scenario_id").agg(
        F.count("run_idx").alias("n_slots"), F.count("trajectory_id").alias("n_runs"),
        F.count_if(c("trajectory_id").isNull()).alias("n_missing"),
        stable_double(F.avg("reward"), MEAN_PLACES).alias("mean_reward"),
        F.transform(F.array_sort(F.collect_list(F.when(in_slot, F.struct("run_idx", "trajectory_id")))),
                    lambda r: r["trajectory_id"]).alias("runs"))
