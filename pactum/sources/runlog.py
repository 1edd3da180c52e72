"""Driver ``events`` -> logged agent runs (adapter, see FIXTURES.md section 2).

Turns: events of one user ordered by ``(ts, event_id)``; every 12 events
form one run (``trajectory_id`` is the text ``user_id:(rn - 1) div 12``,
``turn = (rn - 1) % 12 + 1``); ``scenario_id = user_id``; the target
contract is ``1 + (user_id * 7) % N`` of N contracts; runs of users with
``user_id % 10 = 9`` use JSON mode, the others tool calls.  ``k`` is
``props.k``.  Actions:

  error     value >= 60 -> model failure, else search
  signup    value >= 180 or JSON mode -> plain text reply, else search
  purchase  value >= 100 -> final answer, else search
  click     read contract k (1000000 + k when k % 25 = 24; 0 is invalid)
  view      k < 3 -> unknown tool, k < 6 -> broken arguments, else search

A search asks for keyword set ``k % 10`` of ``SEARCH_KEYWORDS`` and logs
hits ``k+1 .. k+10``.  A final answer gives the don't-know
sentence when ``k % 5 = 0``, else ``'clause ' || k``, with source id =
target when ``k`` is even, else ``k``; the judge replies 'True' unless
``k % 3 = 0``.  ``prompt_tokens = floor(value)``, ``completion_tokens = k``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.operators.ids import group_row_number

TURNS_PER_RUN = 12
DONT_KNOW_SENTENCE = "I could not find the clause."
# Keywords of the logged search calls, chosen by k % 10 (words of the corpus).
SEARCH_KEYWORDS = [
    ["the"], ["and", "of"], ["in the"], ["que"], ["en", "la"],
    ["license"], ["the", "and"], ["of the"], ["le"], ["zzzz"],
]


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("bigint")


def target_of(user: Column, n_contracts: int) -> Column:
    n = F.lit(max(n_contracts, 1))
    return (F.pmod(F.pmod(user.cast("bigint"), n) * 7, n) + 1).cast("bigint")


def event_actions(events: DataFrame, n_contracts: int) -> DataFrame:
    """Numbered events with their action, before rendering as messages."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value", _k().alias("k"))
    ev = group_row_number(ev, ["user_id"], ["ts", "event_id"], "rn")
    u, v, k = F.col("user_id"), F.col("value"), F.col("k")
    use_tools = F.pmod(u, F.lit(10)) != 9
    t = F.col("event_type")
    action = (F.when(t == "error", F.when(v >= 60, "fail").otherwise("search"))
              .when(t == "signup", F.when((v >= 180) | ~use_tools, "text").otherwise("search"))
              .when(t == "purchase", F.when(v >= 100, "answer").otherwise("search"))
              .when(t == "click", F.lit("read"))
              .when(t == "view", F.when(k < 3, "unknown").when(k < 6, "broken").otherwise("search")))
    return ev.select(
        "event_id", "ts", "user_id", "k", "value", "rn",
        F.concat_ws(":", u.cast("string"), F.floor((F.col("rn") - 1) / TURNS_PER_RUN).cast("string")).alias("trajectory_id"),
        (F.pmod(F.col("rn") - 1, F.lit(TURNS_PER_RUN)) + 1).cast("int").alias("turn"),
        use_tools.alias("use_tools"), action.alias("action"),
        target_of(u, n_contracts).alias("target"))


def turns(events: DataFrame, n_contracts: int) -> DataFrame:
    """The ``TURNS`` table of ``pactum.schemas`` (+ ``k`` for the verdict adapter)."""
    a = event_actions(events, n_contracts)
    k, act = F.col("k"), F.col("action")
    ks = k.cast("string")
    read_id = F.when(F.pmod(k, F.lit(25)) == 24, k + 1000000).otherwise(k)
    ans_text = F.when(F.pmod(k, F.lit(5)) == 0, F.lit(DONT_KNOW_SENTENCE)).otherwise(F.concat(F.lit("clause "), ks))
    ans_src = F.when(F.pmod(k, F.lit(2)) == 0, F.col("target")).otherwise(k)
    name = (F.when(act.isin("search", "broken"), "search_contracts").when(act == "read", "read_contract")
            .when(act == "answer", "return_final_answer").when(act == "unknown", "delete_contract"))
    kw_json = F.element_at(F.array(*[F.lit(json.dumps(kw)) for kw in SEARCH_KEYWORDS]),
                           (F.pmod(k, F.lit(len(SEARCH_KEYWORDS))) + 1).cast("int"))
    args = (F.when(act == "search", F.concat(F.lit('{"keywords": '), kw_json, F.lit(', "max_results": 10}')))
            .when(act == "read", F.concat(F.lit('{"contract_id": '), read_id.cast("string"), F.lit("}")))
            .when(act == "answer", F.concat(F.lit('{"extracted_clause_text": "'), ans_text,
                                            F.lit('", "source_contract_id": '), ans_src.cast("string"), F.lit("}")))
            .when(act == "unknown", F.concat(F.lit('{"contract_id": '), ks, F.lit("}")))
            .when(act == "broken", F.concat(F.lit('{"keywords": ["clause '), ks, F.lit('"'))))
    is_call = act.isin("search", "read", "answer", "unknown", "broken")
    call = F.struct(F.concat(F.lit("call_"), F.col("event_id").cast("string")).alias("id"),
                    name.alias("name"), args.alias("arguments"))
    empty_calls = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    tool_calls = F.when(F.col("use_tools") & is_call, F.array(call)).otherwise(empty_calls)
    content = (F.when(act == "text", F.concat(F.lit("I think the clause is in contract "), ks, F.lit(".")))
               .when(~F.col("use_tools") & is_call,
                     F.concat(F.lit('Call: {"tool_name": "'), name, F.lit('", "tool_args": '), args, F.lit("} end"))))
    return a.select(
        "trajectory_id", F.col("user_id").alias("scenario_id"), "turn", "use_tools",
        (act == "fail").alias("llm_failed"), content.alias("content"), tool_calls.alias("tool_calls"),
        F.when(act == "search", F.sequence(k + 1, k + 10)).alias("tool_result_ids"),
        F.floor("value").cast("bigint").alias("prompt_tokens"), k.alias("completion_tokens"),
        "ts", "k")


def run_scenarios(events: DataFrame, contracts: DataFrame, n_contracts: int) -> DataFrame:
    """Scenario of every run's user: (scenario_id, contract_id, contract_title,
    clause_type, ground_truth_clause_text)."""
    users = events.select("user_id").distinct()
    s = users.select(F.col("user_id").alias("scenario_id"), target_of(F.col("user_id"), n_contracts).alias("contract_id"),
                     F.concat(F.lit("clause_"), F.pmod("user_id", F.lit(5)).cast("string")).alias("clause_type"),
                     F.concat(F.lit("clause "), F.pmod("user_id", F.lit(100)).cast("string")).alias("ground_truth_clause_text"))
    titles = contracts.select("contract_id", F.col("title").alias("contract_title"))
    return s.join(titles, "contract_id", "left")


def judge_replies(turns_df: DataFrame) -> DataFrame:
    """Verdict table as logged by the judge client: one reply per final-answer
    turn, keyed by (trajectory_id, turn)."""
    ans = turns_df.filter(F.exists("tool_calls", lambda c: c["name"] == "return_final_answer")
                          | F.coalesce(F.col("content").contains('"return_final_answer"'), F.lit(False)))
    return ans.select("trajectory_id", "turn",
                      F.when(F.pmod("k", F.lit(3)) != 0, " True").otherwise("False\n").alias("reply"),
                      (F.col("k") + 100).alias("judge_prompt_tokens"),
                      F.lit(1).cast("bigint").alias("judge_completion_tokens"))
