"""Reward golden rows (FIXTURES.md section 6), means, tool-call classification."""

import pytest
from pyspark.sql import functions as F

from pactum.functions import scoring
from pactum.operators import benchmark as B
from pactum.operators import runs as R
from pactum.schemas import RUBRIC_COUNTERS, RUBRIC_FLAGS

FLAGS = RUBRIC_FLAGS


def rubric_row(num_turns=3, **flags):
    row = {f: False for f in FLAGS}
    row.update(flags)
    row.update({"num_turns": num_turns, "prompt_tokens": 0, "completion_tokens": 0,
                "judge_prompt_tokens": 0, "judge_completion_tokens": 0})
    return row


CASES = [
    (rubric_row(cant_parse_tool_call=True), -2.0),
    (rubric_row(bad_tool_call_name=True), -1.9),
    (rubric_row(bad_tool_call_args=True), -1.8),
    (rubric_row(tried_to_read_invalid_contract=True), -1.7),
    (rubric_row(tried_to_read_invalid_contract=True, attempted_answer=True, clause_text_correct=True,
                found_correct_contract=True), -1.7),
    (rubric_row(11, ran_out_of_turns=True), -0.5),
    (rubric_row(11, ran_out_of_turns=True, ever_found_correct_contract_in_search=True), -0.45),
    (rubric_row(11, ran_out_of_turns=True, ever_found_correct_contract_in_search=True,
                ever_read_correct_contract=True), -0.4),
    (rubric_row(), -0.3),
    (rubric_row(ever_found_correct_contract_in_search=True), -0.25),
    (rubric_row(1, attempted_answer=True, clause_text_correct=True, found_correct_contract=True), 1.18),
    (rubric_row(4, attempted_answer=True, clause_text_correct=True, found_correct_contract=True), 1.12),
    (rubric_row(10, attempted_answer=True, clause_text_correct=True, found_correct_contract=True), 1.0),
    (rubric_row(attempted_answer=True, found_correct_contract=True, ever_found_correct_contract_in_search=True,
                ever_read_correct_contract=True), -0.9),
    (rubric_row(attempted_answer=True, clause_text_correct=True), -1.2),
    (rubric_row(attempted_answer=True, returned_i_dont_know=True, ever_found_correct_contract_in_search=True), -1.15),
]


def test_reward_table(spark):
    schema = ", ".join([f"{f} BOOLEAN" for f in FLAGS] + [f"{c} BIGINT" for c in RUBRIC_COUNTERS])
    df = spark.createDataFrame([c[0] for c in CASES], schema)
    got = [r["reward"] for r in scoring.with_reward(df).collect()]
    assert got == pytest.approx([c[1] for c in CASES], abs=1e-12)


def test_benchmark_means(spark):
    rows = [(1, 1, "valid", 1.12, 4), (2, 1, "valid", -0.9, 6), (3, 2, "incomplete", 5.0, 2)]
    m = spark.createDataFrame(rows, "trajectory_id BIGINT, scenario_id BIGINT, status STRING, reward DOUBLE, num_turns BIGINT")
    r = B.benchmark_means(m).first()
    assert r["reward"] == pytest.approx(0.11)
    assert r["num_turns"] == pytest.approx(5.0)
    assert r["n_trajectories"] == 2
    none = B.benchmark_means(m.filter("status = 'incomplete'")).first()
    assert none["n_trajectories"] == 0


TURN_SCHEMA = ("trajectory_id BIGINT, scenario_id BIGINT, turn INT, use_tools BOOLEAN, llm_failed BOOLEAN, "
               "content STRING, tool_calls ARRAY<STRUCT<id:STRING,name:STRING,arguments:STRING>>, "
               "tool_result_ids ARRAY<BIGINT>, prompt_tokens BIGINT, completion_tokens BIGINT, ts TIMESTAMP")


def call(name, args, cid="c1"):
    return [(cid, name, args)]


@pytest.fixture(scope="module")
def classify(spark):
    import datetime

    def run(turns):
        ts = datetime.datetime(2024, 1, 1)
        rows = [(t[0], 7, i + 1, t[1], t[2], t[3], t[4], t[5], 10, 1, ts) for t_i, t in enumerate(turns)
                for i in [t[6]]]
        df = spark.createDataFrame(rows, TURN_SCHEMA)
        scen = spark.createDataFrame([(7, 3, "truth")], "scenario_id BIGINT, contract_id BIGINT, ground_truth_clause_text STRING")
        ids = spark.range(1, 6).select(F.col("id").alias("contract_id"))
        replies = spark.createDataFrame([(t[0], t[6] + 1, "  true ", 5, 1) for t in turns],
                                        "trajectory_id BIGINT, turn INT, reply STRING, judge_prompt_tokens BIGINT, judge_completion_tokens BIGINT")
        rub = R.rubric(R.classified_turns(df, scen, ids, replies))
        return {r["trajectory_id"]: r for r in rub.collect()}
    return run


def test_classification(classify):
    S = "search_contracts"
    turns = [
        # (trajectory, use_tools, llm_failed, content, tool_calls, hits, turn_idx)
        (1, True, True, None, [], None, 0),
        (2, True, False, None, call(S, '{"keywords": ["a"'), None, 0),
        (3, False, False, "no braces here", [], None, 0),
        (4, False, False, 'x {"tool_name": null, "tool_args": {}} y', [], None, 0),
        (5, True, False, "just text", [], None, 0),
        (6, True, False, None, call(S, '{"keywords": ["a"], "bogus": 1}'), None, 0),
        (7, True, False, None, call(S, '{"keywords": ["a"]}'), [1, 2, 3], 0),
        (7, True, False, None, call("read_contract", '{"contract_id": 3}'), None, 1),
        (7, True, False, None, call("return_final_answer",
                                   '{"extracted_clause_text": "x", "source_contract_id": 3}'), None, 2),
        (8, True, False, None, call("read_contract", '{"contract_id": "3"}'), None, 0),
        (9, True, False, None, call("read_contract", '{"contract_id": 99}'), None, 0),
        (9, True, False, None, call("return_final_answer",
                                   '{"extracted_clause_text": " I could not find the clause.\\n", "source_contract_id": 3}'), None, 1),
        (10, False, False, 'Call: {"tool_name": "search_contracts", "tool_args": {"keywords": []}} end', [], None, 0),
        (11, True, False, None, call("delete_contract", "{}"), None, 0),
        (12, True, False, None, call(S, '{"keywords": [], "max_results": "many"}'), [3], 0),
        (12, True, False, None, call(S, '{"keywords": ["a"], "max_results": "many"}'), [3], 1),
    ]
    r = classify(turns)
    assert r[1]["bad_tool_call_name"] and r[1]["num_turns"] == 1 and r[1]["prompt_tokens"] == 0
    assert r[2]["bad_tool_call_args"]
    assert r[3]["cant_parse_tool_call"]
    assert r[4]["cant_parse_tool_call"]
    assert r[5]["bad_tool_call_name"]
    assert r[6]["bad_tool_call_args"]
    t7 = r[7]
    assert (t7["ever_found_correct_contract_in_search"], t7["ever_read_correct_contract"], t7["attempted_answer"],
            t7["clause_text_correct"], t7["found_correct_contract"], t7["num_turns"]) == (True, True, True, True, True, 3)
    assert t7["judge_prompt_tokens"] == 5 and t7["prompt_tokens"] == 30
    assert r[8]["bad_tool_call_args"]
    assert r[9]["tried_to_read_invalid_contract"] and r[9]["returned_i_dont_know"] and not r[9]["clause_text_correct"]
    assert r[10]["stop_reason"] == "stop_after_tool" and not r[10]["bad_tool_call_args"]
    assert r[11]["bad_tool_call_name"]
    assert r[12]["stop_reason"] == "bad_arguments"  # falsy keywords pass, then a string max_results fails
    for t in (1, 2, 3, 7, 9):
        assert r[t]["status"] == "valid"


def test_runs_of_any_user_id(spark):
    """Run ids and targets don't overflow, and runs of different users stay apart."""
    from pactum.sources import runlog

    users = [21_474_837, 30_000_000, 2 ** 31, 2 ** 62, 2 ** 63 - 1]
    rows = [(i, i, u, "view", 1.0, '{"k": 9}') for i, u in enumerate(users * 13)]
    events = spark.createDataFrame(rows, "event_id bigint, ts bigint, user_id bigint, event_type string, value double, props string")
    got = runlog.event_actions(events, 1000).collect()
    assert {r.trajectory_id for r in got} == {f"{u}:{k}" for u in users for k in (0, 1)}
    assert {r.user_id: r.target for r in got} == {u: u * 7 % 1000 + 1 for u in users}
