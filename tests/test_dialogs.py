"""Runs from conversations, schedule slots, the counted load and the verdict cache on small fixtures."""

from pyspark.sql import functions as F

from pactum.functions import scoring
from pactum.operators import judge, tables
from pactum.operators import trajectories as traj
from pactum.operators.fold import fold_runs
from pactum.sources import dialogs

CONV = "conv_id bigint, turn bigint, role string, text string"
ANSWER = 'So: {"tool_name": "return_final_answer", "tool_args": {"extracted_clause_text": "x", "source_contract_id": 7}}'


def _scenarios(spark):
    return spark.createDataFrame([(1, 7, "t7", "c", 1, "truth")], "scenario_id bigint, contract_id bigint, "
                                 "contract_title string, clause_type string, annotation_id bigint, ground_truth_clause_text string")


def test_runs_of_conversations(spark):
    conv = spark.createDataFrame(
        [(0, 0, "user", "q"), (0, 1, "assistant", ANSWER), (0, 2, "user", "more"), (0, 3, "assistant", "late"),
         (1, 0, "assistant", None), (2, None, "user", "q"), (None, 0, "assistant", "x"), (20, 5, "assistant", "")], CONV)
    scen = _scenarios(spark)
    turns = dialogs.turns(conv)
    metrics = scoring.metrics(fold_runs(turns, scen, scen.select("contract_id")))
    got = {r.trajectory_id: r for r in traj.trajectories(dialogs.messages(conv), turns, metrics, scen).collect()}
    assert set(got) == {"0", "1", "20"}
    r = got["0"]
    assert [tuple(m) for m in r.messages] == [("user", "q"), ("assistant", ANSWER)]
    assert (r.metadata.contract_id, r.metadata.contract_title) == (7, "t7") and r.metrics.found_correct_contract == 1
    assert r.reward == -1.0  # right contract, no verdict
    assert [tuple(m) for m in got["1"].messages] == [("assistant", None)] and got["1"].metrics.bad_tool_call_name == 1
    assert got["20"].metadata.contract_id is None


def test_a_hot_conversation_is_cut_before_the_shuffle(spark):
    conv = spark.range(5000).select(F.floor(F.col("id") / 5000).alias("conv_id"), F.col("id").alias("turn"),
                                    F.lit("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turns = dialogs.turns(conv)
    assert "WindowGroupLimit" in turns._jdf.queryExecution().executedPlan().toString()
    assert [(r.turn, r.position) for r in turns.orderBy("turn").collect()] == [(i + 1, i) for i in range(10)]


def test_slots_missing_and_surplus_runs(spark):
    runs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 9), ("e", None), ("f", 2)], "trajectory_id string, scenario_id bigint")
    schedule = spark.createDataFrame([(1, 0, 1), (1, 5, 1), (2, 3, 2), (2, 3, 1), (3, 4, 1)],
                                     "scenario_id bigint, global_step bigint, run_idx bigint")
    metrics = runs.select("trajectory_id", F.when(F.col("trajectory_id") == "a", 1.0).otherwise(-2.0).alias("reward"))
    got = {(r.global_step, r.scenario_id): (r.n_slots, r.n_runs, r.n_missing, r.mean_reward, r.runs)
           for r in traj.step_groups(traj.assign_runs(runs, schedule), metrics).collect()}
    assert got == {(0, 1): (1, 1, 0, 1.0, ["a"]), (5, 1): (1, 1, 0, -2.0, ["b"]), (None, 1): (0, 1, 0, -2.0, []),
                   (3, 2): (2, 1, 1, -2.0, ["f"]), (4, 3): (1, 0, 1, None, []), (None, 9): (0, 1, 0, -2.0, []),
                   (None, None): (0, 1, 0, -2.0, [])}


def test_load_counts_equal_a_second_pass(spark, tmp_path):
    from pactum.schemas import CONTRACT_NESTED
    para = [{"context": "x", "qas": [{"question": "q", "qa_id": "1", "is_impossible": False, "answers": [{"text": "x", "answer_start": 0}] * 2},
                                     {"question": "q", "qa_id": "2", "is_impossible": True, "answers": [{"text": "x", "answer_start": 0}]}]}]
    good = spark.createDataFrame([(i, f"t{i}", para) for i in range(5)], CONTRACT_NESTED).selectExpr("*", "'ok' AS status", "CAST(NULL AS STRING) AS reason")
    bad = spark.createDataFrame([(9, "t", None)], CONTRACT_NESTED).selectExpr("*", "'rejected' AS status", "'bad_title' AS reason")
    got = tables.load_counted(good.union(bad), str(tmp_path / "out"))
    assert (got["n_read"], got["n_loaded"], got["n_skipped"], got["n_bad_title"], got["n_no_paragraphs"]) == (6, 5, 1, 1, 0)
    again = tables.load_counts(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (again.n_contracts, again.n_annotations) == (got["n_loaded"], got["n_annotations"])
    none = tables.load_counted(good.limit(0), str(tmp_path / "empty"))
    assert none["n_read"] == 0 and none["n_annotations"] == 0


def test_verdict_cache_asks_each_key_once(spark, tmp_path):
    schema = "request_key string, trajectory_id string, turn int, messages array<struct<role:string,content:string>>"
    cache = judge.VerdictCache(spark, str(tmp_path / "cache"))
    first = spark.createDataFrame([("k1", "r2", 1, []), ("k1", "r1", 3, []), ("k2", "r3", 1, [])], schema)
    asked = cache.pending(first, 0)
    assert sorted((r.request_key, r.trajectory_id) for r in asked.collect()) == [("k1", "r1"), ("k2", "r3")]
    cache.add(0, asked.withColumn("reply", F.lit("True")))
    second = cache.pending(spark.createDataFrame([("k2", "r9", 1, []), ("k3", "r9", 2, [])], schema), 1)
    for _ in range(2):  # a batch that is written again replaces itself
        cache.add(1, second.withColumn("reply", F.lit("False")))
    assert sorted((r.request_key, r.batch, r.reply) for r in cache.replies().collect()) == [
        ("k1", 0, "True"), ("k2", 0, "True"), ("k3", 1, "False")]
