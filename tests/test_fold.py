"""The fold per run against the per-turn rubric."""

from pyspark.sql import functions as F

from pactum.operators import runs
from pactum.operators.fold import fold_runs
from pactum.plans import common as C

from .conftest import SF_SMALL

TURNS = ("trajectory_id string, scenario_id bigint, turn int, use_tools boolean, llm_failed boolean, content string, "
         "tool_calls array<struct<id:string,name:string,arguments:string>>, tool_result_ids array<bigint>, "
         "prompt_tokens bigint, completion_tokens bigint, ts timestamp")


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def test_fold_equals_rubric_per_turn(spark):
    turns, scen, ids, replies = C.run_inputs(spark, SF_SMALL)
    want = runs.rubric(runs.classified_turns(turns, scen, ids, replies))
    assert _rows(fold_runs(turns, scen, ids, replies)) == _rows(want)
    assert _rows(fold_runs(turns, scen, ids, None, 3)) == _rows(runs.rubric(runs.classified_turns(turns, scen, ids, None, 3), 3))


def _turn(run, scenario, n, name, args, found=None, ids="c"):
    return (run, scenario, n, True, False, None, [(ids, name, args)], found, 5, 2, None)


def test_fold_of_hand_written_runs(spark):
    rows = [
        _turn("right", 1, 1, "search_contracts", '{"keywords": ["a"]}', [7, 8]),
        _turn("right", 1, 2, "read_contract", '{"contract_id": 7}'),
        _turn("right", 1, 3, "return_final_answer", '{"extracted_clause_text": "x", "source_contract_id": 7}'),
        _turn("right", 1, 4, "read_contract", '{"contract_id": 99}'),  # after the end: never ran
        _turn("lost", None, 1, "read_contract", '{"contract_id": 99}'),
        _turn("lost", None, 2, "return_final_answer", '{"extracted_clause_text": "x", "source_contract_id": -1}'),
        _turn("zero", 2, 1, "read_contract", '{"contract_id": 0}'),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    scen = spark.createDataFrame([(1, 7, "truth"), (2, 8, "")], "scenario_id bigint, contract_id bigint, ground_truth_clause_text string")
    ids = spark.createDataFrame([(7,), (8,)], "contract_id bigint")
    replies = spark.createDataFrame([("right", 3, " True", 11, 1), ("right", 4, "False", 1, 1), ("lost", 2, "True", 9, 9)],
                                    "trajectory_id string, turn int, reply string, judge_prompt_tokens bigint, judge_completion_tokens bigint")
    got = {r.trajectory_id: r for r in fold_runs(turns, scen, ids, replies).collect()}
    r = got["right"]
    assert (r.status, r.stop_reason, r.num_turns, r.prompt_tokens, r.judge_prompt_tokens) == ("valid", "answered", 3, 15, 11)
    assert r.clause_text_correct and r.found_correct_contract and r.ever_read_correct_contract
    assert r.ever_found_correct_contract_in_search and not r.tried_to_read_invalid_contract
    r = got["lost"]
    assert r.tried_to_read_invalid_contract and r.returned_i_dont_know and not r.found_correct_contract
    assert not r.clause_text_correct and r.judge_prompt_tokens == 0
    r = got["zero"]
    assert r.status == "incomplete" and r.tried_to_read_invalid_contract and not r.attempted_answer
    assert _rows(fold_runs(turns, scen, ids, replies)) == _rows(runs.rubric(runs.classified_turns(turns, scen, ids, replies)))


def test_empty_turns(spark):
    turns = spark.createDataFrame([], TURNS)
    scen = spark.createDataFrame([], "scenario_id bigint, contract_id bigint, ground_truth_clause_text string")
    assert fold_runs(turns, scen, scen.select("contract_id")).count() == 0
    assert fold_runs(turns.select("*", F.lit(1).alias("extra")), scen, scen.select("contract_id")).count() == 0
