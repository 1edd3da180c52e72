"""Registered queries: one callable per operator group of the survey.

Each takes ``(spark, sf_dir)``, reads the driver tables and returns a
DataFrame whose column names equal those of the matching oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.operators import flatten as fl
from pactum.operators import scenarios as scen_ops
from pactum.operators import tables as table_ops
from pactum.plans import common as C
from pactum.schemas import TRAINING_DATASET_SIZE, VAL_SET_SIZE
from pactum.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- step 1: flatten ---------------------------------------------------------

@query("full_text")
def q_full_text(spark, sf_dir):
    n = C.nested(spark, sf_dir)
    ft = fl.full_text(F.col("paragraphs"))
    return n.select(
        F.col("contract_id").cast("bigint").alias("contract_id"), "title",
        F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
        F.length(ft).cast("bigint").alias("full_text_length"),
        F.md5(ft).alias("full_text_md5"))


@query("para_offsets")
def q_para_offsets(spark, sf_dir):
    p = fl.paragraph_rows(C.nested(spark, sf_dir), keep=["contract_id"])
    return p.select(*C.as_long("contract_id", "para_idx", "base_offset"),
                    F.length("context").cast("bigint").alias("context_length"))


@query("flat_annotations")
def q_flat_annotations(spark, sf_dir):
    a = fl.flat_annotations(C.nested(spark, sf_dir), keep=["contract_id"], check_text=True)
    return a.select(*C.as_long("contract_id", "para_idx", "ans_idx"), "clause_type", "text",
                    "start_char", "end_char", "text_matches")


# --- step 2: tables and checks -------------------------------------------------

@query("build_tables")
def q_build_tables(spark, sf_dir):
    return C.annotations(spark, sf_dir)


@query("build_counts")
def q_build_counts(spark, sf_dir):
    return table_ops.load_counts(C.nested(spark, sf_dir))


@query("integrity_report")
def q_integrity_report(spark, sf_dir):
    n = C.nested(spark, sf_dir)
    contracts = table_ops.contracts_table(n, ids=False).select("id", "title")
    return table_ops.integrity_report(contracts, table_ops.annotations_table(n, check_text=True))


@query("integrity_violations")
def q_integrity_violations(spark, sf_dir):
    """The same report over tables with a broken row of each kind for every
    tenth document: an orphan, a null field, a wrong span, a second title."""
    n = C.nested(spark, sf_dir)
    contracts = table_ops.contracts_table(n, ids=False).select("id", "title")
    annotations = table_ops.annotations_table(n, check_text=True).select(
        "contract_id", "clause_type", "text", "start_char", "end_char", "text_matches")
    kind = F.pmod("contract_seq", F.lit(10))
    broken = n.where(kind.isin(3, 4, 5)).select(
        F.when(kind == 3, -F.col("contract_id")).otherwise(F.col("contract_id")).alias("contract_id"),
        F.when(kind != 4, "clause").alias("clause_type"), F.lit("x").alias("text"),
        F.lit(0).cast("bigint").alias("start_char"), F.lit(1).cast("bigint").alias("end_char"),
        (kind != 5).alias("text_matches"))
    twice = n.where(kind == 6).select((-F.col("contract_id")).alias("id"), "title")
    return table_ops.integrity_report(contracts.unionByName(twice), annotations.unionByName(broken))


# --- step 3: scenarios, split, sample, schedule --------------------------------

@query("scenarios")
def q_scenarios(spark, sf_dir):
    return C.scenarios(spark, sf_dir)


@query("scenario_split")
def q_scenario_split(spark, sf_dir):
    return C.split(spark, sf_dir).select("scenario_id", "contract_id", "contract_rank", "split")


@query("split_disjoint")
def q_split_disjoint(spark, sf_dir):
    return scen_ops.split_disjointness(C.split(spark, sf_dir))


@query("scenario_sample")
def q_scenario_sample(spark, sf_dir):
    """S10 write (by split) -> S11 pruned read of the train split ->
    seeded shuffle and limit (L2, L4)."""
    from pactum.session import scratch_path as _sp
    path = _sp(spark, "scenarios")
    scen_ops.write_scenarios(C.split(spark, sf_dir), path)
    train = scen_ops.read_scenarios(spark, path, "train")
    s = scen_ops.sample_scenarios(train, "train", TRAINING_DATASET_SIZE, shuffle=True)
    return s.select(F.col("sample_rank").cast("bigint").alias("sample_rank"),
                    F.col("scenario_id").cast("bigint").alias("scenario_id"),
                    F.col("contract_id").cast("bigint").alias("contract_id"), "clause_type")


@query("training_schedule")
def q_training_schedule(spark, sf_dir):
    return _schedule(C.split(spark, sf_dir))


def _schedule(split):
    return scen_ops.training_schedule(scen_ops.sample_scenarios(split, "train", TRAINING_DATASET_SIZE, shuffle=True))


@query("evaluation_points")
def q_evaluation_points(spark, sf_dir):
    """Periodic evaluations and the final one."""
    e = scen_ops.evaluation_points(q_training_schedule(spark, sf_dir))
    return e.select(F.col("global_step").cast("bigint").alias("global_step"), "kind")


@query("work_list")
def q_work_list(spark, sf_dir):
    """The first validation scenarios of the test split, unshuffled."""
    s = scen_ops.sample_scenarios(C.split(spark, sf_dir), "test", VAL_SET_SIZE, shuffle=False)
    return s.select("sample_rank", F.col("scenario_id").cast("bigint").alias("scenario_id"), "contract_id")


@query("stored_contracts")
def q_stored_contracts(spark, sf_dir):
    """Both tables written, a second build skipped, the contracts read back."""
    n = C.nested(spark, sf_dir)
    contracts = table_ops.contracts_table(n)
    ids = contracts.select("contract_seq", F.col("id").alias("contract_id"))
    annotations = table_ops.annotations_table(n.drop("contract_id").join(ids, "contract_seq"))
    path = scratch_path(spark, "tables")
    table_ops.write_tables(contracts, annotations, path)
    again = table_ops.write_tables(contracts, annotations, path)
    stored = spark.read.parquet(f"{path}/contracts")
    return stored.select("id", "title", F.md5("full_text").alias("full_text_md5"),
                         F.lit(int(not again["skipped"])).cast("bigint").alias("rebuilt"))


# --- step 4-5: index, search, lookup ----------------------------------------

from pactum.operators import lookup as lookup_ops  # noqa: E402
from pactum.operators import blocksearch as search_ops  # noqa: E402
from pactum.operators import textindex as ti  # noqa: E402
from pactum.operators.blockindex import BlockIndex, build_block_index  # noqa: E402


@query("tokens")
def q_tokens(spark, sf_dir):
    return ti.token_summary(C.contracts_flat(spark, sf_dir))


@query("postings")
def q_postings(spark, sf_dir):
    p = ti.postings(C.contracts_flat(spark, sf_dir))
    return p.select(*C.as_long("contract_id", "col", "pos"), "token")


_STORED: dict[tuple, BlockIndex] = {}


def _stored_version(spark, sf_dir) -> tuple:
    """Names the state of the documents' files: a changed file makes another index."""
    files = spark.read.format("binaryFile").load(f"{sf_dir.rstrip('/')}/documents.parquet")
    marks = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)").alias("h"))
    return tuple(marks.agg(F.count("h"), F.sum("h")).first())


def _index(spark, sf_dir) -> BlockIndex:
    """The stored search index of the contracts, built once per session and state of the input."""
    key = (spark.sparkContext.applicationId, sf_dir, _stored_version(spark, sf_dir))
    if key not in _STORED:
        path = scratch_path(spark, "search-index")
        build_block_index(C.contracts_flat(spark, sf_dir), path)
        _STORED[key] = BlockIndex(spark, path)
    return _STORED[key]


@query("search_topk")
def q_search_topk(spark, sf_dir):
    return search_ops.search(_index(spark, sf_dir), C.search_batch(spark))


@query("search_snippet")
def q_search_snippet(spark, sf_dir):
    res = search_ops.search_with_snippets(_index(spark, sf_dir), C.search_batch(spark))
    return res.select("query_id", "rank", "contract_id", "snippet_col", "snippet")


@query("read_by_id")
def q_read_by_id(spark, sf_dir):
    r = lookup_ops.read_by_id(C.read_requests(spark, sf_dir), C.contracts_flat(spark, sf_dir))
    return r.select(F.col("request_id").cast("bigint").alias("request_id"),
                    F.col("contract_id").cast("bigint").alias("contract_id"), "status", "title",
                    F.length("full_text").cast("bigint").alias("text_length"),
                    F.md5("full_text").alias("text_md5"))


# --- step 6: logged runs ----------------------------------------------------------

from pactum.functions import prompts as pr  # noqa: E402
from pactum.functions import scoring  # noqa: E402
from pactum.operators import benchmark as bench_ops  # noqa: E402
from pactum.operators import judge as judge_ops  # noqa: E402
from pactum.operators import runs as run_ops  # noqa: E402
from pactum.operators.search import stable_double  # noqa: E402
from pactum.schemas import MAX_TURNS  # noqa: E402


@query("parse_tool_call")
def q_parse_tool_call(spark, sf_dir):
    turns, _, _, _ = C.run_inputs(spark, sf_dir)
    p = run_ops.parsed_turns(turns)
    keys = F.array_join(F.array_sort(F.json_object_keys(F.to_json("tool_args"))), ",")
    return p.select("trajectory_id", F.col("turn").cast("bigint").alias("turn"), "call_source",
                    "parse_status", "tool_name", keys.alias("arg_keys"))


@query("rubric")
def q_rubric(spark, sf_dir):
    return C.rubric(spark, sf_dir).drop("duration", "use_tools")


@query("judge_requests")
def q_judge_requests(spark, sf_dir):
    turns, scen, ids, replies = C.run_inputs(spark, sf_dir)
    req = judge_ops.judge_requests(run_ops.classified_turns(turns, scen, ids, replies), scen)
    return req.select("trajectory_id", F.col("turn").cast("bigint").alias("turn"), "request_key",
                      F.col("messages")[1]["content"].alias("user_content"))


@query("judge_verdicts")
def q_judge_verdicts(spark, sf_dir):
    turns, scen, ids, replies = C.run_inputs(spark, sf_dir)
    req = judge_ops.judge_requests(run_ops.classified_turns(turns, scen, ids, replies), scen)
    v = judge_ops.judge_verdicts(req, replies)
    return v.select("trajectory_id", F.col("turn").cast("bigint").alias("turn"), "reply", "verdict")


@query("reward")
def q_reward(spark, sf_dir):
    r = scoring.with_reward(C.rubric(spark, sf_dir))
    return r.select("trajectory_id", "status", "stop_reason", "num_turns",
                    stable_double(F.col("reward"), 9).alias("reward"))


def _metrics(spark, sf_dir):
    return scoring.metrics(C.rubric(spark, sf_dir))


@query("metrics")
def q_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.withColumn("reward", stable_double(F.col("reward"), 9)) \
        .withColumn("duration", stable_double(F.col("duration"), 6))


@query("benchmark_means")
def q_benchmark_means(spark, sf_dir):
    return bench_ops.benchmark_means(_metrics(spark, sf_dir))


@query("run_counts")
def q_run_counts(spark, sf_dir):
    return bench_ops.run_counts(_metrics(spark, sf_dir))


@query("run_log")
def q_run_log(spark, sf_dir):
    """The valid runs of two benchmarks appended to one log."""
    metrics, path = _metrics(spark, sf_dir), scratch_path(spark, "run-log")
    for model, split in (("first", "train"), ("second", "test")):
        bench_ops.log_runs(metrics, path, model, split)
    return spark.read.parquet(path).select("trajectory_id", "model", "split",
                                           stable_double(F.col("reward"), 9).alias("reward"))


@query("union_metrics")
def q_union_metrics(spark, sf_dir):
    """U4: metric rows with different keys in one frame."""
    m = _metrics(spark, sf_dir)
    valid = m.where("status = 'valid'").select("trajectory_id", stable_double(F.col("reward"), 9).alias("reward"))
    other = m.where("status <> 'valid'").select("trajectory_id", stable_double(F.col("duration"), 6).alias("duration"))
    return bench_ops.union_metrics([valid, other])


@query("trajectory_groups")
def q_trajectory_groups(spark, sf_dir):
    return bench_ops.trajectory_groups(_metrics(spark, sf_dir))


@query("prompt_messages")
def q_prompt_messages(spark, sf_dir):
    turns, scen, _, _ = C.run_inputs(spark, sf_dir)
    runs_ = turns.groupBy("trajectory_id").agg(F.first("scenario_id").alias("scenario_id"),
                                               F.first("use_tools").alias("use_tools"))
    j = runs_.join(scen, "scenario_id", "left")
    system = pr.agent_system_prompt(F.col("contract_title"), F.col("contract_id"), F.col("clause_type"),
                                    F.lit(MAX_TURNS), F.col("use_tools"))
    user = pr.agent_user_prompt(F.col("clause_type"), F.col("contract_id"))
    meta = F.struct("scenario_id", "contract_id", "contract_title",
                    F.col("clause_type").alias("target_clause_type"), F.col("scenario_id").alias("annotation_id"))
    msgs = pr.messages(system, user)
    return j.select("trajectory_id", F.col("scenario_id").cast("bigint").alias("scenario_id"),
                    F.col("contract_id").cast("bigint").alias("contract_id"), "contract_title",
                    meta["target_clause_type"].alias("clause_type"),
                    msgs[0]["content"].alias("system_prompt"), msgs[1]["content"].alias("user_prompt"))


def _said(asked, key, payload, name):
    """What a tool message says to each key: role, digest and length of the content, stored."""
    msg = pr.tool_reply(payload, F.lit(None).cast("string"))
    return search_ops.stored(asked.select(
        key, msg["role"].alias("role"), F.md5(msg["content"]).alias("content_md5"),
        F.length(msg["content"]).cast("bigint").alias("content_length")), name)


@query("tool_reply")
def q_tool_reply(spark, sf_dir):
    """Tool messages of reached turns: search results (hits with snippets, in
    rank order), the contract or error object of reads, and the confirmation
    text of final answers."""
    turns, scen, ids, replies = C.run_inputs(spark, sf_dir)
    kept = run_ops.kept_turns(run_ops.classified_turns(turns, scen, ids, replies))
    # The turns that get a reply feed three branches: classify them once.
    from pactum.session import scratch_root
    scratch_root(spark)
    # A turn that is there several times is answered as often in each of its replies (``_times``).
    kept = kept.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("trajectory_id", "turn")).cast("int"))
    kept = kept.filter(F.col("outcome").isin("read", "answered", "searched")).checkpoint(eager=True)
    # What is said depends on the contract read or the search made alone: said once for each, then joined.
    reads = kept.filter(F.col("outcome") == "read").withColumn("rid", F.col("read_id"))
    asked = search_ops.stored(reads.select("rid").distinct(), "read-ids")
    contracts = C.contracts_flat(spark, sf_dir).select(F.col("contract_id").alias("rid"), "title", "full_text") \
        .join(asked, "rid", "left_semi")
    payload = (F.when(F.col("rid") <= 0, F.to_json(F.struct(F.concat(
                    F.lit("Contract ID "), F.col("rid").cast("string"), F.lit(" is invalid.")).alias("error"))))
               .when(F.col("title").isNull(), F.to_json(F.struct(F.concat(
                    F.lit("Contract with ID "), F.col("rid").cast("string"), F.lit(" not found.")).alias("error"))))
               .otherwise(F.to_json(F.struct(F.col("rid").alias("id"), "title", "full_text"))))
    said = _said(asked.join(contracts, "rid", "left"), F.col("rid").alias("_rid"), payload, "read-replies")
    read_rows = reads.join(said, F.col("rid").eqNullSafe(F.col("_rid"))).select(
        "trajectory_id", F.col("turn").cast("bigint").alias("turn"), "role", "tool_call_id", "content_md5", "content_length")
    from pactum.functions.text import preview
    answers = kept.filter(F.col("outcome") == "answered").select(
        "trajectory_id", F.col("turn").cast("bigint").alias("turn"), F.lit("confirmation").alias("role"),
        F.lit(None).cast("string").alias("tool_call_id"),
        F.md5(F.concat(F.lit(pr.FINAL_ANSWER_CONFIRMATION), preview(F.col("answer_text")))).alias("content_md5"),
        F.length(F.concat(F.lit(pr.FINAL_ANSWER_CONFIRMATION), preview(F.col("answer_text")))).cast("bigint")
        .alias("content_length"))
    # Search replies: the distinct tool-mode searches run as one batch; the
    # reply lists the hits (at most 10 per call) in rank order.
    searched = kept.filter(F.col("outcome") == "searched").withColumn(
        "query_id", F.md5(F.to_json(F.struct("search_keywords", "search_max_results"))))
    batch = searched.select("query_id", F.col("search_keywords").alias("keywords"),
                            F.col("search_max_results").alias("max_results")).dropDuplicates(["query_id"])
    batch = search_ops.stored(batch, "searches")
    hits = search_ops.search_with_snippets(_index(spark, sf_dir), batch)
    per_call = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "contract_id", "title", "snippet"))).alias("h"))
    repeated = F.flatten(F.transform("h", lambda x: F.array_repeat(x, F.col("_times"))))
    listing = F.to_json(F.transform(repeated, lambda x: F.struct(
        x["contract_id"].alias("contract_id"), x["title"].alias("title"), x["snippet"].alias("snippet"))))
    found = searched.select("query_id", "_times").distinct().join(per_call, "query_id", "left")
    said = _said(found, F.struct("query_id", "_times").alias("asked"), F.coalesce(listing, F.lit("[]")), "search-replies")
    said = said.select("asked.*", "role", "content_md5", "content_length")
    search_rows = searched.join(said, ["query_id", "_times"]).select(
        "trajectory_id", F.col("turn").cast("bigint").alias("turn"), "role", "tool_call_id", "content_md5", "content_length")
    return read_rows.unionByName(answers).unionByName(search_rows)


# --- step 7: nested JSON ingest ---------------------------------------------------

from pactum.operators.ids import dense_ids  # noqa: E402
from pactum.sources import nested_json as nj  # noqa: E402
from pactum.sources.adapters import raw_contract_lines  # noqa: E402
from pactum.sources.tables import text_table as _text_table  # noqa: E402


def _raw_json_path(spark, sf_dir):
    """Write the documents as raw JSON Lines to the shared scratch folder."""
    docs = _text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = scratch_path(spark, "raw-json")
    raw_contract_lines(docs).select("value").write.mode("error").text(path)
    return path


def _validated(spark, sf_dir):
    return nj.validate(nj.read_lines(spark, _raw_json_path(spark, sf_dir)))


@query("load_nested")
def q_load_nested(spark, sf_dir):
    # Validated once, and stored: the ids of the good ones are made from these rows.
    flagged = search_ops.stored(_validated(spark, sf_dir), "validated")
    good, rejects = nj.good_and_rejects(flagged)
    ids = dense_ids(good.select("contract_seq"), ["contract_seq"], "contract_id")
    n_paras = F.when(F.col("paragraphs").isNotNull(), F.size("paragraphs"))  # size(NULL) is -1 without ANSI
    rows = flagged.select("contract_seq", "status", "reason", "title", n_paras.cast("bigint").alias("n_paragraphs"))
    return rows.join(ids, "contract_seq", "left").select(
        "contract_seq", "contract_id", "status", "reason", "title", "n_paragraphs")


@query("load_envelope")
def q_load_envelope(spark, sf_dir):
    """The raw contracts in several envelope files, read as one input."""
    docs = _text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = scratch_path(spark, "envelopes")
    write_envelopes(docs, path)
    return _envelope_rows(nj.read_envelope(spark, path))


def _envelope_rows(raw, max_contracts=None):
    flagged = nj.validate(raw, max_contracts)
    n_paras = F.when(F.col("paragraphs").isNotNull(), F.size("paragraphs"))
    return flagged.select("contract_seq", "status", "reason", "title", n_paras.cast("bigint").alias("n_paragraphs"))


@query("load_envelope_splits")
def q_load_envelope_splits(spark, sf_dir):
    """The same files cut into splits of 64 KiB, through the structural index."""
    docs = _text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = scratch_path(spark, "envelopes")
    write_envelopes(docs, path)
    return _envelope_rows(nj.read_envelope(spark, path, split_bytes=1 << 16))


@query("load_first")
def q_load_first(spark, sf_dir):
    """Validation of the first contracts only, in input order over all files."""
    docs = _text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    path = scratch_path(spark, "envelopes")
    write_envelopes(docs, path)
    return _envelope_rows(nj.read_envelope(spark, path), max_contracts=VAL_SET_SIZE)


@query("validate_nested")
def q_validate_nested(spark, sf_dir):
    good, _ = nj.good_and_rejects(_validated(spark, sf_dir))
    a = fl.flat_annotations(good, keep=["contract_seq"], check_text=True)
    return a.select(*C.as_long("contract_seq", "para_idx", "ans_idx"), "clause_type", "text",
                    "start_char", "end_char", "text_matches")


@query("roundtrip_nested")
def q_roundtrip_nested(spark, sf_dir):
    good, _ = nj.good_and_rejects(_validated(spark, sf_dir))
    path = scratch_path(spark, "processed")
    nj.write_processed_lines(good, path)
    again, _ = nj.good_and_rejects(nj.validate(nj.read_lines(spark, path), mode="processed"))  # P7
    n_qas = F.aggregate("paragraphs", F.lit(0).cast("bigint"), lambda acc, p: acc + F.size(p["qas"]))
    ft = fl.full_text(F.col("paragraphs"))
    return again.select("contract_seq", "title", F.size("paragraphs").cast("bigint").alias("n_paragraphs"),
                        n_qas.alias("n_qas"), F.md5(ft).alias("full_text_md5"))


# --- step 8: streaming index upkeep -----------------------------------------------

from pactum.sources.adapters import change_feed, initial_contracts, write_envelopes  # noqa: E402
from pactum.streaming.index_upkeep import IndexStore, run_upkeep  # noqa: E402


def upkept_index(spark, sf_dir) -> IndexStore:
    docs = _text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    store = IndexStore(spark, scratch_path(spark, "index"))
    store.build(initial_contracts(docs))
    # Two feeds, each with a stream and a checkpoint of its own.
    for i, feed in enumerate(change_feed(docs)):
        path = scratch_path(spark, f"feed{i}")
        feed.write.mode("error").parquet(path)
        run_upkeep(spark, store, path, scratch_path(spark, f"feed{i}-ckpt"))
    return store


@query("index_upsert")
def q_index_upsert(spark, sf_dir):
    p = upkept_index(spark, sf_dir).read("postings")
    return p.select(*C.as_long("contract_id", "col", "pos"), "token")


@query("search_replay")
def q_search_replay(spark, sf_dir):
    """Every search call the logged agents executed, replayed as one query
    batch against the corpus index (hits, scores and snippets)."""
    turns, scen, ids, replies = C.run_inputs(spark, sf_dir)
    kept = run_ops.kept_turns(run_ops.classified_turns(turns, scen, ids, replies))
    batch = kept.filter(F.col("search_keywords").isNotNull()).select(
        F.concat_ws(":", "trajectory_id", F.col("turn").cast("string")).alias("query_id"),
        F.col("search_keywords").alias("keywords"), F.col("search_max_results").alias("max_results"))
    res = search_ops.search_with_snippets(_index(spark, sf_dir), batch)
    return res.select("query_id", "rank", "contract_id", "score", "snippet")


# --- step 9: runs logged as conversations, schedule slots, counted load, verdict cache --------

from pactum.operators import trajectories as traj_ops  # noqa: E402
from pactum.operators.fold import fold_runs  # noqa: E402
from pactum.sources import dialogs  # noqa: E402


def _conversations(spark, sf_dir):
    return _text_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def _conversation_rubric(spark, sf_dir, scenarios=None):
    contract_ids = _text_table(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") + 1).alias("contract_id"))
    scenarios = C.scenarios(spark, sf_dir) if scenarios is None else scenarios
    return fold_runs(dialogs.turns(_conversations(spark, sf_dir)), scenarios, contract_ids)


@query("conversation_rubric")
def q_conversation_rubric(spark, sf_dir):
    """The rubric of every run that ``conversations`` logs."""
    return _conversation_rubric(spark, sf_dir).drop("duration", "use_tools")


@query("conversation_trajectories")
def q_conversation_trajectories(spark, sf_dir):
    """Trajectories as nested rows, shown by digests of their parts."""
    conv = _conversations(spark, sf_dir)
    scenarios = C.scenarios(spark, sf_dir)  # built once for both
    metrics = search_ops.stored(scoring.metrics(_conversation_rubric(spark, sf_dir, scenarios)), "metrics")
    t = traj_ops.trajectories(dialogs.messages(conv), dialogs.turns(conv), metrics, scenarios)
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return t.select("trajectory_id", F.col("metadata.scenario_id").alias("scenario_id"),
                    F.col("metadata.contract_title").alias("contract_title"),
                    F.col("metadata.target_clause_type").alias("clause_type"),
                    F.size("messages").cast("bigint").alias("n_messages"), F.md5(text).alias("messages_md5"),
                    F.col("metrics.num_turns").alias("num_turns"), stable_double(F.col("reward"), 9).alias("reward"))


@query("step_groups")
def q_step_groups(spark, sf_dir):
    """The runs of ``conversations`` on the slots of the training schedule."""
    scenarios = C.scenarios(spark, sf_dir)  # built once for runs and schedule
    metrics = search_ops.stored(scoring.metrics(_conversation_rubric(spark, sf_dir, scenarios)).where("status = 'valid'"), "metrics")
    schedule = _schedule(scen_ops.split_scenarios(scenarios))
    groups = traj_ops.step_groups(traj_ops.assign_runs(metrics, schedule), metrics)
    return groups.withColumn("runs", F.array_join("runs", ","))


@query("load_report")
def q_load_report(spark, sf_dir):
    """A4: contracts read, loaded and skipped by reason, counted by the load itself."""
    counts = table_ops.load_counted(_validated(spark, sf_dir), scratch_path(spark, "loaded"))
    return spark.createDataFrame([(k, v) for k, v in counts.items()], "count_name string, n bigint")


@query("verdict_cache")
def q_verdict_cache(spark, sf_dir):
    """The judge requests in two batches; the second asks only for new keys."""
    turns, scen, ids, replies = C.run_inputs(spark, sf_dir)
    requests = judge_ops.judge_requests(run_ops.classified_turns(turns, scen, ids, replies), scen)
    cache = judge_ops.VerdictCache(spark, scratch_path(spark, "verdicts"))
    for batch, digits in enumerate(("02468ace", "13579bdf")):
        part = requests.where(F.substring(F.md5("trajectory_id"), 32, 1).isin(*digits))
        asked = cache.pending(part, batch)
        cache.add(batch, asked.join(replies.select("trajectory_id", "turn", "reply"), ["trajectory_id", "turn"], "left"))
    return cache.replies().select("request_key", "batch", "reply",
                                  run_ops.verdict_of(F.col("reply")).alias("verdict"))
