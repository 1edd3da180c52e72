"""Scoring logged agent runs (2.11): parse each turn's tool call, classify it
(first matching rule wins), stop at the first terminal turn, fold the kept
turns of a run into the 16-field rubric (A5, A6, J6-J8, J10, W3-W5, F6-F10).

Turns beyond ``max_turns`` are dropped first, so a run is at most ``max_turns``
rows.  What a turn does follows from the turn alone (``decided_turns``, narrow);
``classified_turns`` joins target, verdict and existence to every turn, for the
tables that need them per turn.  The rubric is folded in ``fold.py``, which
joins them once per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.functions import toolcall as tc
from pactum.functions.text import py_strip
from pactum.schemas import (DONT_KNOW_ID, DONT_KNOW_TEXT, MAX_TURNS, TOOL_ANSWER, TOOL_READ,
                            TOOL_SEARCH)

SEARCH_ARGS = ("keywords", "max_results")
NUMERIC_KINDS = ("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN")


def verdict_of(reply: Column) -> Column:
    """a judge reply is a yes when, stripped and lower-cased, it starts with 't'."""
    return F.coalesce(F.lower(py_strip(reply)).startswith("t"), F.lit(False))


def _falsy(v: Column, k: Column) -> Column:
    """Python falsiness of a JSON value ``v`` whose kind is ``k``."""
    return (k.isNull() | (k == "VOID")
            | (k.startswith("ARRAY") & (F.json_array_length(F.to_json(v)) == 0))
            | ((k == "STRING") & (tc.as_str(v) == ""))
            | ((k.isin(*NUMERIC_KINDS) | k.startswith("DECIMAL")) & (F.try_variant_get(v, "$", "double") == 0))
            | (k.startswith("OBJECT") & (F.size(tc.object_keys(v)) == 0)))


def _numeric_kind(k: Column) -> Column:
    return k.isin(*NUMERIC_KINDS) | k.startswith("DECIMAL")


def parsed_turns(turns: DataFrame) -> DataFrame:
    """Adds the parse of every turn (F6-F9): ``call_source`` (tools / json /
    none), ``parse_status``, ``tool_name`` and ``tool_args`` (VARIANT).

    Each parse (JSON text -> VARIANT) and each type test is staged as its own
    column, so it runs once per row however often the rules refer to it."""
    c = F.col
    t = turns.withColumn("_fc", tc.first_call(c("tool_calls"))) \
        .withColumn("_has_calls", F.coalesce(F.size("tool_calls") > 0, F.lit(False))) \
        .withColumn("_truthy", F.coalesce(F.length("content") > 0, F.lit(False))) \
        .withColumn("_failed", F.coalesce(c("llm_failed"), F.lit(False)))
    t = t.withColumn("_targs", F.when(c("use_tools") & c("_has_calls"), tc.parse_object(c("_fc")["arguments"]))) \
        .withColumn("_jobj", F.when(~c("use_tools") & c("_truthy"), tc.embedded_object(c("content"))))
    t = t.withColumn("_targs_kind", tc.kind(c("_targs"))) \
        .withColumn("_jobj_kind", tc.kind(c("_jobj"))) \
        .withColumn("_jname", tc.field(c("_jobj"), "tool_name")) \
        .withColumn("_jargs", tc.field(c("_jobj"), "tool_args"))
    t = t.withColumn("_jname_kind", tc.kind(c("_jname"))).withColumn("_jargs_kind", tc.kind(c("_jargs")))
    use_tools, has_calls, truthy = c("use_tools"), c("_has_calls"), c("_truthy")
    j_ok = F.coalesce(c("_jobj_kind").startswith("OBJECT"), F.lit(False)) & c("_jname").isNotNull() \
        & c("_jargs").isNotNull()
    jk = c("_jname_kind")
    j_name_s = (F.when(jk == "VOID", F.lit(None)).when(jk == "STRING", tc.as_str(c("_jname")))
                .otherwise(F.concat(F.lit("<"), jk, F.lit(">"))))
    j_args = F.when(c("_jargs_kind") != "VOID", c("_jargs"))
    t_obj = F.coalesce(c("_targs_kind").startswith("OBJECT"), F.lit(False))
    status = (F.when(c("_failed"), "model_failure")
              .when(use_tools & has_calls & c("_fc")["name"].isNull(), "no_function")
              .when(use_tools & has_calls & ~t_obj, "bad_arguments")
              .when(~use_tools & truthy & ~j_ok, "unparsable")
              .when(~use_tools & truthy & (j_name_s.isNull() | j_args.isNull()), "null_call")
              .when(use_tools & has_calls, "ok")
              .when(~use_tools & truthy, "ok")
              .when(truthy, "text_reply")
              .otherwise("no_call"))
    t = t.withColumn("parse_status", status)
    ok = c("parse_status") == "ok"
    out = t.select(
        *turns.columns, "parse_status",
        F.when(use_tools & has_calls, "tools").when(~use_tools & truthy, "json").otherwise("none").alias("call_source"),
        F.when(ok, F.when(use_tools, c("_fc")["name"]).otherwise(j_name_s)).alias("tool_name"),
        F.when(ok, F.when(use_tools, c("_targs")).otherwise(j_args)).alias("tool_args"),
        F.when(ok & use_tools, c("_fc")["id"]).alias("tool_call_id"))
    return out


def decided_turns(turns: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """Everything about a turn that follows from the turn alone, without a join
    or a shuffle: its outcome, whether the run ends there, the executed call
    (``read_id``, ``search_keywords``, ..), ``found_ids`` of an executed search
    and the answer.  Turns beyond ``max_turns`` never run (W5)."""
    c = F.col
    t = parsed_turns(turns.filter(c("turn") <= max_turns))
    args, name = c("tool_args"), c("tool_name")
    # Stage every argument lookup and its type once.
    t = t.withColumn("_obj", tc.is_object(args)) \
        .withColumn("_rid_v", F.when(name == TOOL_READ, tc.field(args, "contract_id"))) \
        .withColumn("_kw", F.when(name == TOOL_SEARCH, tc.field(args, "keywords"))) \
        .withColumn("_mr", F.when(name == TOOL_SEARCH, tc.field(args, "max_results"))) \
        .withColumn("_keys", F.when(name == TOOL_SEARCH, tc.object_keys(args))) \
        .withColumn("_text_v", F.when(name == TOOL_ANSWER, tc.field(args, "extracted_clause_text"))) \
        .withColumn("_src_v", F.when(name == TOOL_ANSWER, tc.field(args, "source_contract_id")))
    t = t.withColumn("_rid_kind", tc.kind(c("_rid_v"))).withColumn("_kw_kind", tc.kind(c("_kw"))) \
        .withColumn("_mr_kind", tc.kind(c("_mr"))).withColumn("_text_kind", tc.kind(c("_text_v"))) \
        .withColumn("_src_kind", tc.kind(c("_src_v")))
    is_int = lambda k: F.coalesce(k.isin("BIGINT", "BOOLEAN"), F.lit(False))

    ok, obj = c("parse_status") == "ok", c("_obj")
    # search_contracts(**args)
    is_search = name == TOOL_SEARCH
    kw_falsy = _falsy(c("_kw"), c("_kw_kind"))
    unknown_arg = F.exists("_keys", lambda x: ~x.isin(*SEARCH_ARGS))
    search_bad = (~obj | unknown_arg | ~F.array_contains("_keys", "keywords")
                  | (~kw_falsy & ((F.coalesce(c("_kw_kind"), F.lit("")) != "ARRAY<STRING>")
                                  | (c("_mr").isNotNull() & ~_numeric_kind(c("_mr_kind"))))))
    # read_contract(contract_id)
    is_read = name == TOOL_READ
    read_bad = ~obj | ~is_int(c("_rid_kind"))
    # return_final_answer(extracted_clause_text, source_contract_id)
    ans_bad = ~obj | ~F.coalesce(c("_text_kind") == "STRING", F.lit(False)) | ~is_int(c("_src_kind"))
    ans_text, ans_src = tc.as_str(c("_text_v")), tc.as_long(c("_src_v"))
    dont_know = (F.lower(py_strip(ans_text)) == DONT_KNOW_TEXT) | (ans_src == DONT_KNOW_ID)

    no_reply = ~c("use_tools") | c("tool_call_id").isNull()
    outcome = (F.when(~ok, c("parse_status"))
               .when(is_search, F.when(search_bad, "bad_arguments")
                     .when(no_reply, "stop_after_tool").otherwise("searched"))
               .when(is_read, F.when(read_bad, "bad_arguments")
                     .when(no_reply, "stop_after_tool").otherwise("read"))
               .when(name == TOOL_ANSWER, F.when(ans_bad, "bad_arguments").otherwise("answered"))
               .otherwise("unknown_tool"))
    t = t.withColumn("outcome", outcome).withColumn("_search_ok", ok & is_search & ~search_bad) \
        .withColumn("_kw_falsy", kw_falsy).withColumn("_dont_know", dont_know) \
        .withColumn("_ans_text", ans_text).withColumn("_ans_src", ans_src)
    o = c("outcome")
    answered = o == "answered"
    tokens = lambda n: F.when(o != "model_failure", F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint")
    return t.select(
        "trajectory_id", "scenario_id", "turn", "use_tools", "ts", "outcome",
        "parse_status", "call_source", "tool_name",
        (~o.isin("searched", "read")).alias("terminal"),
        o.isin("model_failure", "text_reply", "no_call", "unknown_tool").alias("f_bad_name"),
        o.isin("no_function", "bad_arguments").alias("f_bad_args"),
        o.isin("unparsable", "null_call").alias("f_cant_parse"),
        F.when(c("_search_ok") & ~c("_kw_falsy"), c("tool_result_ids")).alias("found_ids"),
        F.when(ok & is_read & ~read_bad, tc.as_long(c("_rid_v"))).alias("read_id"),
        answered.alias("f_attempted"), (answered & c("_dont_know")).alias("f_dont_know"),
        (answered & ~c("_dont_know") & (F.length("_ans_text") > 0)).alias("judgeable"),
        "tool_call_id",
        # the executed search call (for replaying it against the index)
        F.when(c("_search_ok"),
               F.coalesce(F.try_variant_get(c("_kw"), "$", "array<string>"), F.array().cast("array<string>")))
        .alias("search_keywords"),
        F.when(c("_search_ok"), F.coalesce(F.try_variant_get(c("_mr"), "$", "int"), F.lit(10))).alias("search_max_results"),
        F.when(answered, c("_ans_text")).alias("answer_text"),
        F.when(answered, c("_ans_src")).alias("answer_contract_id"),
        tokens(c("prompt_tokens")).alias("p_tokens"), tokens(c("completion_tokens")).alias("c_tokens"))


def classified_turns(turns: DataFrame, scenarios: DataFrame, contract_ids: DataFrame,
                     judge_replies: DataFrame | None = None, max_turns: int = MAX_TURNS) -> DataFrame:
    """Per-turn outcome and flags.  ``scenarios`` gives the target contract and
    truth text per ``scenario_id`` (J6), ``contract_ids`` the existing ids (J8),
    ``judge_replies`` the judge's reply per (trajectory_id, turn) (J10)."""
    c = F.col
    t = decided_turns(turns, max_turns)
    scen = scenarios.select("scenario_id", c("contract_id").alias("target"),
                            c("ground_truth_clause_text").alias("truth"))
    t = t.join(scen, "scenario_id", "left")
    # Existence of the requested id.  Turns without a read get a distinct
    # negative key instead of NULL (ids are positive, so it never matches):
    # NULL keys would all hash to one partition of the shuffle join.
    salt = -1 - F.pmod(F.xxhash64("trajectory_id", "turn"), F.lit(1 << 40))
    t = t.withColumn("_rkey", F.coalesce(c("read_id"), salt))
    ids = contract_ids.select(c("contract_id").alias("_rkey"), F.lit(True).alias("_exists"))
    t = t.join(ids, "_rkey", "left").drop("_rkey")
    if judge_replies is not None:
        t = t.join(judge_replies.select("trajectory_id", "turn", "reply", "judge_prompt_tokens",
                                        "judge_completion_tokens"), ["trajectory_id", "turn"], "left")
    else:
        t = (t.withColumn("reply", F.lit(None).cast("string"))
             .withColumn("judge_prompt_tokens", F.lit(None).cast("bigint"))
             .withColumn("judge_completion_tokens", F.lit(None).cast("bigint")))
    rid = c("read_id")
    yes = lambda x: F.coalesce(x, F.lit(False))
    judged = yes(c("judgeable")) & yes(F.length("truth") > 0)
    judge_tokens = lambda n: F.when(judged, F.coalesce(n, F.lit(0))).otherwise(0).cast("bigint")
    return t.select(
        "trajectory_id", "scenario_id", "turn", "use_tools", "ts", "target", "outcome",
        "parse_status", "call_source", "tool_name", "terminal", "f_bad_name", "f_bad_args", "f_cant_parse",
        yes(F.array_contains("found_ids", c("target"))).alias("f_found_in_search"),
        yes((rid > 0) & (rid == c("target"))).alias("f_read_correct"),
        yes((rid <= 0) | (rid.isNotNull() & c("_exists").isNull())).alias("f_invalid_read"),
        "f_attempted", "f_dont_know", judged.alias("f_judged"),
        (judged & verdict_of(c("reply"))).alias("f_text_correct"),
        yes(c("f_attempted") & ~c("f_dont_know") & (c("answer_contract_id") == c("target"))).alias("f_found_contract"),
        "tool_call_id", "read_id", "search_keywords", "search_max_results", "answer_text", "answer_contract_id",
        "p_tokens", "c_tokens",
        judge_tokens(c("judge_prompt_tokens")).alias("jp_tokens"),
        judge_tokens(c("judge_completion_tokens")).alias("jc_tokens"))


def kept_turns(classified: DataFrame) -> DataFrame:
    """Turns up to and including the first terminal one, with ``_end``
    (first terminal turn or NULL) and ``_n`` (turns logged within the limit)."""
    w = Window.partitionBy("trajectory_id")
    c = classified.withColumn("_end", F.min(F.when(F.col("terminal"), F.col("turn"))).over(w)) \
        .withColumn("_n", F.count(F.lit(1)).over(w))
    return c.filter(F.col("_end").isNull() | (F.col("turn") <= F.col("_end")))


def rubric(classified: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """One row per run with the 16 rubric fields, ``status``
    ('valid' / 'incomplete'), ``stop_reason`` and ``duration``."""
    kept = kept_turns(classified)
    b = F.bool_or
    agg = kept.groupBy("trajectory_id").agg(
        F.first("scenario_id").alias("scenario_id"),
        F.first("use_tools").alias("use_tools"),
        F.max("_end").alias("_end"), F.max("_n").alias("_n"),
        b("f_text_correct").alias("clause_text_correct"),
        b("f_found_contract").alias("found_correct_contract"),
        b("f_attempted").alias("attempted_answer"),
        b("f_dont_know").alias("returned_i_dont_know"),
        b("f_found_in_search").alias("ever_found_correct_contract_in_search"),
        b("f_read_correct").alias("ever_read_correct_contract"),
        b("f_invalid_read").alias("tried_to_read_invalid_contract"),
        b("f_cant_parse").alias("cant_parse_tool_call"),
        b("f_bad_name").alias("bad_tool_call_name"),
        b("f_bad_args").alias("bad_tool_call_args"),
        F.sum("p_tokens").alias("prompt_tokens"),
        F.sum("c_tokens").alias("completion_tokens"),
        F.sum("jp_tokens").alias("judge_prompt_tokens"),
        F.sum("jc_tokens").alias("judge_completion_tokens"),
        F.max_by("outcome", "turn").alias("_last_outcome"),
        # independent of the session time zone (works on TIMESTAMP and TIMESTAMP_NTZ)
        (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6).alias("duration"),
    )
    out_of_turns = F.col("_end").isNull() & (F.col("_n") >= max_turns)
    return agg.select(
        "trajectory_id", "scenario_id", "use_tools",
        F.when(F.col("_end").isNotNull() | out_of_turns, "valid").otherwise("incomplete").alias("status"),
        F.when(out_of_turns, "out_of_turns").when(F.col("_end").isNotNull(), F.col("_last_outcome"))
        .otherwise("incomplete").alias("stop_reason"),
        "clause_text_correct", "found_correct_contract",
        F.coalesce("_end", F.when(out_of_turns, F.lit(max_turns + 1)), "_n").cast("bigint").alias("num_turns"),
        "attempted_answer", "returned_i_dont_know", "ever_found_correct_contract_in_search",
        "ever_read_correct_contract", "tried_to_read_invalid_contract", "cant_parse_tool_call",
        "bad_tool_call_name", "bad_tool_call_args", out_of_turns.alias("ran_out_of_turns"),
        "prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens",
        "duration")
