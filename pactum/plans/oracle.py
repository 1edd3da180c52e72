"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The driver tables are views named after the tables.  The adapters of
``pactum.sources.adapters`` are re-derived here in SQL, independently of the
Spark code.
"""

from __future__ import annotations

from pactum.sources.dialogs import RUNS_PER_SCENARIO
from pactum.schemas import NUM_EPOCHS, TRAINING_DATASET_SIZE, TRAJECTORIES_PER_GROUP, VAL_SET_SIZE

SEP_SQL = "chr(10) || chr(10) || '--- PARAGRAPH BREAK ---' || chr(10) || chr(10)"

DOCS = """
docs AS (
  SELECT doc_id, doc_id + 1 AS contract_id,
         source || ' ' || lang || ' ' || CAST(doc_id AS VARCHAR) AS title,
         coalesce(text, '') AS text,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents)"""

PARAS = DOCS + """,
paras AS (
  SELECT doc_id, contract_id, title, unnest(lines) AS context,
         unnest(generate_series(0, len(lines) - 1)) AS para_idx
  FROM docs),
paras_b AS (
  SELECT *, coalesce(sum(length(context) + 27) OVER (
              PARTITION BY doc_id ORDER BY para_idx
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_offset
  FROM paras)"""

SPANS = PARAS + """,
sentences AS (
  SELECT doc_id, contract_id, para_idx, base_offset, 'clause_' || CAST(para_idx % 5 AS VARCHAR) AS clause_type,
         unnest(string_split(context, '.')) AS text, generate_subscripts(string_split(context, '.'), 1) AS raw_idx
  FROM paras_b WHERE para_idx % 7 <> 6),
raw_spans AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, para_idx ORDER BY raw_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS answer_start
  FROM sentences),
spans AS (
  SELECT doc_id, contract_id, para_idx, clause_type, text,
         row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY raw_idx) - 1 AS ans_idx,
         base_offset + answer_start AS start_char,
         base_offset + answer_start + length(text) AS end_char
  FROM raw_spans WHERE text <> ''),
ann AS (
  SELECT row_number() OVER (ORDER BY doc_id, para_idx, ans_idx) AS id,
         contract_id, clause_type, text, start_char, end_char
  FROM spans)"""

SCEN = SPANS + """,
scen AS (
  SELECT a.id AS scenario_id, a.contract_id, d.title AS contract_title, a.id AS annotation_id,
         a.clause_type, a.text AS ground_truth_clause_text, a.start_char, a.end_char
  FROM ann a JOIN docs d ON a.contract_id = d.contract_id)"""

SPLIT = SCEN + """,
cids AS (SELECT DISTINCT contract_id FROM scen),
crank AS (
  SELECT contract_id,
         row_number() OVER (ORDER BY md5('42:' || CAST(contract_id AS VARCHAR)), contract_id) AS contract_rank,
         count(*) OVER () AS n
  FROM cids),
split AS (
  SELECT s.*, r.contract_rank,
         CASE WHEN r.contract_rank <= floor(CAST(r.n AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
  FROM scen s JOIN crank r USING (contract_id))"""

SAMPLE = SPLIT + f""",
sample AS (
  SELECT * FROM (
    SELECT row_number() OVER (ORDER BY md5('42:' || CAST(scenario_id AS VARCHAR)), scenario_id) AS sample_rank, *
    FROM split WHERE split = 'train')
  WHERE sample_rank <= {TRAINING_DATASET_SIZE})"""

ORACLE: dict[str, str] = {}

ORACLE["full_text"] = f"""WITH {DOCS}
SELECT contract_id, title, CAST(len(lines) AS BIGINT) AS n_paragraphs,
       CAST(length(replace(text, chr(10), {SEP_SQL})) AS BIGINT) AS full_text_length,
       md5(replace(text, chr(10), {SEP_SQL})) AS full_text_md5
FROM docs"""

ORACLE["para_offsets"] = f"""WITH {PARAS}
SELECT contract_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(base_offset AS BIGINT) AS base_offset,
       CAST(length(context) AS BIGINT) AS context_length
FROM paras_b"""

ORACLE["flat_annotations"] = f"""WITH {SPANS}
SELECT s.contract_id, CAST(s.para_idx AS BIGINT) AS para_idx, CAST(s.ans_idx AS BIGINT) AS ans_idx,
       s.clause_type, s.text, CAST(s.start_char AS BIGINT) AS start_char, CAST(s.end_char AS BIGINT) AS end_char,
       substr(replace(d.text, chr(10), {SEP_SQL}), CAST(s.start_char + 1 AS BIGINT), CAST(s.end_char - s.start_char AS BIGINT)) = s.text AS text_matches
FROM spans s JOIN docs d USING (doc_id)"""

ORACLE["build_tables"] = f"""WITH {SPANS}
SELECT CAST(id AS BIGINT) AS id, contract_id, clause_type, text,
       CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char
FROM ann"""

ORACLE["build_counts"] = f"""WITH {PARAS},
qa AS (SELECT para_idx % 7 = 6 AS imp,
              len(list_filter(string_split(context, '.'), lambda s: s <> '')) AS n_ans
       FROM paras)
SELECT (SELECT count(*) FROM documents) AS n_contracts,
       CAST(count(*) AS BIGINT) AS n_paragraphs,
       CAST(count(*) AS BIGINT) AS n_qas,
       CAST(count(*) FILTER (WHERE imp) AS BIGINT) AS n_impossible_qas,
       CAST(coalesce(sum(n_ans) FILTER (WHERE NOT imp), 0) AS BIGINT) AS n_annotations
FROM qa"""

ORACLE["integrity_report"] = f"""WITH {SPANS},
chk AS (
  SELECT substr(replace(d.text, chr(10), {SEP_SQL}), CAST(s.start_char + 1 AS BIGINT), CAST(s.end_char - s.start_char AS BIGINT)) = s.text AS ok
  FROM spans s JOIN docs d USING (doc_id))
SELECT 'duplicate_title' AS check_name, (SELECT count(*) FROM docs) AS n_checked,
       (SELECT count(*) FROM (SELECT title FROM docs GROUP BY title HAVING count(*) > 1)) AS n_violations
UNION ALL
SELECT 'orphan_annotation', (SELECT count(*) FROM ann),
       (SELECT count(*) FROM ann a WHERE NOT EXISTS (SELECT 1 FROM docs d WHERE d.contract_id = a.contract_id))
UNION ALL
SELECT 'span_text_mismatch', count(*), count(*) FILTER (WHERE NOT ok) FROM chk
UNION ALL
SELECT 'null_field', count(*), count(*) FILTER (WHERE contract_id IS NULL OR clause_type IS NULL OR text IS NULL
                                              OR start_char IS NULL OR end_char IS NULL) FROM ann"""

ORACLE["integrity_violations"] = f"""WITH report AS ({ORACLE["integrity_report"]}),
broken AS (SELECT doc_id % 10 AS kind FROM documents)
SELECT check_name,
       n_checked + CASE WHEN check_name = 'duplicate_title' THEN (SELECT count(*) FROM broken WHERE kind = 6)
                        ELSE (SELECT count(*) FROM broken WHERE kind IN (3, 4, 5)) END AS n_checked,
       n_violations + (SELECT count(*) FROM broken WHERE kind = CASE check_name
           WHEN 'duplicate_title' THEN 6 WHEN 'orphan_annotation' THEN 3 WHEN 'null_field' THEN 4 ELSE 5 END) AS n_violations
FROM report"""

ORACLE["scenarios"] = f"""WITH {SCEN}
SELECT CAST(scenario_id AS BIGINT) AS scenario_id, contract_id, contract_title,
       CAST(annotation_id AS BIGINT) AS annotation_id, clause_type, ground_truth_clause_text,
       CAST(start_char AS BIGINT) AS start_char, CAST(end_char AS BIGINT) AS end_char
FROM scen"""

ORACLE["scenario_split"] = f"""WITH {SPLIT}
SELECT CAST(scenario_id AS BIGINT) AS scenario_id, contract_id, CAST(contract_rank AS BIGINT) AS contract_rank, split
FROM split"""

ORACLE["split_disjoint"] = f"""WITH {SPLIT}
SELECT count(DISTINCT contract_id) FILTER (WHERE split = 'train') AS n_train_contracts,
       count(DISTINCT contract_id) FILTER (WHERE split = 'test') AS n_test_contracts,
       count(*) FILTER (WHERE split = 'train') AS n_train_scenarios,
       count(*) FILTER (WHERE split = 'test') AS n_test_scenarios,
       (SELECT count(*) FROM (SELECT contract_id FROM split WHERE split = 'train'
                              INTERSECT SELECT contract_id FROM split WHERE split = 'test')) AS n_overlap_contracts
FROM split"""

ORACLE["scenario_sample"] = f"""WITH {SAMPLE}
SELECT CAST(sample_rank AS BIGINT) AS sample_rank, CAST(scenario_id AS BIGINT) AS scenario_id,
       contract_id, clause_type
FROM sample"""

ORACLE["training_schedule"] = f"""WITH {SAMPLE},
ep AS (SELECT s.scenario_id, e.epoch FROM sample s, range(0, {NUM_EPOCHS}) e(epoch)),
rk AS (SELECT scenario_id, epoch,
              row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || CAST(epoch AS VARCHAR) || ':' || CAST(scenario_id AS VARCHAR)), scenario_id) AS epoch_rank,
              count(*) OVER (PARTITION BY epoch) AS n
       FROM ep),
st AS (SELECT CAST(epoch AS BIGINT) AS epoch, CAST(epoch_rank - 1 AS BIGINT) AS epoch_step,
              CAST(epoch * n + epoch_rank - 1 AS BIGINT) AS global_step, CAST(scenario_id AS BIGINT) AS scenario_id
       FROM rk)
SELECT st.*, (global_step > 0 AND global_step % 30 = 0) AS eval_before, CAST(r.run_idx AS BIGINT) AS run_idx
FROM st, range(1, {TRAJECTORIES_PER_GROUP} + 1) r(run_idx)"""


ORACLE["evaluation_points"] = f"""WITH {SAMPLE},
n AS (SELECT CAST(count(*) * {NUM_EPOCHS} AS BIGINT) AS steps FROM sample)
SELECT CAST(unnest(range(30, steps, 30)) AS BIGINT) AS global_step, 'periodic' AS kind FROM n
UNION ALL SELECT steps, 'final' FROM n"""

ORACLE["work_list"] = f"""WITH {SPLIT}
SELECT CAST(row_number() OVER (ORDER BY scenario_id) AS BIGINT) AS sample_rank, CAST(scenario_id AS BIGINT) AS scenario_id,
       contract_id FROM split WHERE split = 'test' ORDER BY scenario_id LIMIT {VAL_SET_SIZE}"""

ORACLE["stored_contracts"] = f"""WITH {DOCS}
SELECT contract_id AS id, title, md5(replace(text, chr(10), {SEP_SQL})) AS full_text_md5, CAST(0 AS BIGINT) AS rebuilt
FROM docs"""


# --- step 4-5 -------------------------------------------------------------------

PAT = r"'[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*'"
FOLDED = "list_transform(regexp_extract_all(@X@, " + PAT + "), lambda t: strip_accents(lower(t)))"

CTOKS = DOCS + f""",
cdocs AS (SELECT contract_id, title, replace(text, chr(10), {SEP_SQL}) AS full_text FROM docs),
ctoks AS (SELECT contract_id, {FOLDED.replace('@X@', 'title')} AS tt, {FOLDED.replace('@X@', 'full_text')} AS bt FROM cdocs),
post AS (
  SELECT contract_id, 0 AS col, unnest(generate_series(0, len(tt) - 1)) AS pos, unnest(tt) AS token FROM ctoks
  UNION ALL
  SELECT contract_id, 1 AS col, unnest(generate_series(0, len(bt) - 1)) AS pos, unnest(bt) AS token FROM ctoks)"""


def _batch_values() -> str:
    from pactum.plans.common import SEARCH_BATCH

    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    rows = [f"({q}, [{', '.join(lit(k) for k in kws)}]::VARCHAR[], {m})" for q, kws, m in SEARCH_BATCH]
    return ",\n    ".join(rows)


SEARCH_CORE = f"""
kw AS (SELECT query_id, unnest(keywords) AS keyword, unnest(generate_series(0, len(keywords) - 1)) AS kw_idx FROM q),
kt AS (SELECT query_id, kw_idx, {FOLDED.replace('@X@', 'keyword')} AS toks FROM kw),
qtok AS (SELECT query_id, kw_idx, len(toks) AS n_tok, unnest(toks) AS token,
                unnest(generate_series(0, len(toks) - 1)) AS tok_idx FROM kt WHERE len(toks) > 0),
occ AS (SELECT query_id, kw_idx, n_tok, contract_id, col, pos - tok_idx AS start
        FROM post JOIN qtok USING (token)
        GROUP BY query_id, kw_idx, n_tok, contract_id, col, pos - tok_idx HAVING count(*) = n_tok),
tf AS (SELECT query_id, kw_idx, contract_id, count(*) AS tf FROM occ GROUP BY query_id, kw_idx, contract_id),
nkw AS (SELECT query_id, count(DISTINCT kw_idx) AS n_kw FROM qtok GROUP BY query_id),
fullm AS (SELECT t.query_id, t.contract_id FROM tf t JOIN nkw n USING (query_id)
          GROUP BY t.query_id, t.contract_id, n.n_kw HAVING count(*) = n.n_kw),
dfi AS (SELECT query_id, kw_idx, count(*) AS n_i FROM tf GROUP BY query_id, kw_idx),
ds AS (SELECT contract_id, len(tt) + len(bt) AS doc_len FROM ctoks),
g AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(doc_len) AS DOUBLE) / count(*) AS avgdl FROM ds),
terms AS (
  SELECT tf.query_id, tf.contract_id,
         CASE WHEN ln((g.n_docs - n_i + CAST(0.5 AS DOUBLE)) / (n_i + CAST(0.5 AS DOUBLE))) <= 0 THEN CAST(1e-6 AS DOUBLE)
              ELSE ln((g.n_docs - n_i + CAST(0.5 AS DOUBLE)) / (n_i + CAST(0.5 AS DOUBLE))) END
         * CAST(tf AS DOUBLE) * CAST(2.2 AS DOUBLE)
         / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * doc_len / g.avgdl)) AS term
  FROM tf JOIN fullm USING (query_id, contract_id) JOIN dfi USING (query_id, kw_idx) JOIN ds USING (contract_id), g),
scored AS (SELECT query_id, contract_id, CAST(CAST(-sum(term) AS DECIMAL(38,12)) AS DOUBLE) AS score
           FROM terms GROUP BY query_id, contract_id),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score, s.contract_id) AS rank,
                  CASE WHEN q.max_results IS NULL OR q.max_results <= 0 OR q.max_results > 10 THEN 10 ELSE q.max_results END AS k
           FROM scored s JOIN q USING (query_id))"""

SEARCH = CTOKS + f""",
q AS (SELECT * FROM (VALUES
    {_batch_values()}) v(query_id, keywords, max_results)),""" + SEARCH_CORE

ORACLE["tokens"] = f"""WITH {CTOKS}
SELECT contract_id, CAST(len(tt) AS BIGINT) AS n_title_tokens, CAST(len(bt) AS BIGINT) AS n_body_tokens,
       CAST(len(list_distinct(list_concat(tt, bt))) AS BIGINT) AS n_distinct_tokens,
       bt[1] AS first_body_token
FROM ctoks"""

ORACLE["postings"] = f"""WITH {CTOKS}
SELECT contract_id, CAST(col AS BIGINT) AS col, CAST(pos AS BIGINT) AS pos, token FROM post"""

ORACLE["search_topk"] = f"""WITH {SEARCH}
SELECT CAST(r.query_id AS BIGINT) AS query_id, CAST(r.rank AS BIGINT) AS rank, r.contract_id, c.title, r.score
FROM ranked r JOIN cdocs c USING (contract_id)
WHERE r.rank <= r.k"""

ORACLE["read_by_id"] = f"""WITH {DOCS},
cdocs AS (SELECT contract_id, title, replace(text, chr(10), {SEP_SQL}) AS full_text FROM docs),
ev AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click'),
req AS (SELECT event_id AS request_id, CASE WHEN k % 25 = 24 THEN k + 1000000 ELSE k END AS contract_id FROM ev)
SELECT r.request_id, r.contract_id,
       CASE WHEN r.contract_id IS NULL OR r.contract_id <= 0 THEN 'invalid_id'
            WHEN c.contract_id IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       c.title, CAST(length(c.full_text) AS BIGINT) AS text_length, md5(c.full_text) AS text_md5
FROM req r LEFT JOIN cdocs c ON r.contract_id > 0 AND r.contract_id = c.contract_id"""


# --- step 6: runs ------------------------------------------------------------------
# The oracle derives each turn's outcome straight from the event semantics of
# the adapter (no JSON parsing), an independent path to the same rubric.

from pactum.functions.prompts import (AGENT_SYSTEM_TEMPLATE, AGENT_USER_TEMPLATE,  # noqa: E402
                                      FINAL_ANSWER_CONFIRMATION, JSON_MODE_SUFFIX, JUDGE_USER_TEMPLATE,
                                      render_sql)

RUN_ACT = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
act AS (
  SELECT *, CAST(user_id AS VARCHAR) || ':' || CAST((rn - 1) // 12 AS VARCHAR) AS trajectory_id, CAST((rn - 1) % 12 + 1 AS BIGINT) AS turn,
         user_id % 10 <> 9 AS use_tools, CAST(1 + (user_id * 7) % (SELECT count(*) FROM documents) AS BIGINT) AS target,
         CASE event_type
           WHEN 'error' THEN CASE WHEN value >= 60 THEN 'fail' ELSE 'search' END
           WHEN 'signup' THEN CASE WHEN value >= 180 OR user_id % 10 = 9 THEN 'text' ELSE 'search' END
           WHEN 'purchase' THEN CASE WHEN value >= 100 THEN 'answer' ELSE 'search' END
           WHEN 'click' THEN 'read'
           WHEN 'view' THEN CASE WHEN k < 3 THEN 'unknown' WHEN k < 6 THEN 'broken' ELSE 'search' END
         END AS action,
         CASE WHEN k % 25 = 24 THEN k + 1000000 ELSE k END AS rid,
         CASE WHEN k % 2 = 0 THEN CAST(1 + (user_id * 7) % (SELECT count(*) FROM documents) AS BIGINT) ELSE k END AS src,
         CASE WHEN k % 5 = 0 THEN 'I could not find the clause.' ELSE 'clause ' || CAST(k AS VARCHAR) END AS ans_text
  FROM ev),
cls AS (
  SELECT a.*,
    CASE
      WHEN action = 'fail' THEN 'model_failure'
      WHEN action = 'text' THEN CASE WHEN use_tools THEN 'text_reply' ELSE 'unparsable' END
      WHEN action = 'broken' THEN CASE WHEN use_tools THEN 'bad_arguments' ELSE 'unparsable' END
      WHEN action = 'unknown' THEN 'unknown_tool'
      WHEN action = 'search' THEN CASE WHEN use_tools THEN 'searched' ELSE 'stop_after_tool' END
      WHEN action = 'read' THEN CASE WHEN use_tools THEN 'read' ELSE 'stop_after_tool' END
      WHEN action = 'answer' THEN 'answered'
    END AS outcome,
    (action = 'search' AND target BETWEEN k + 1 AND k + 10) AS f_found_in_search,
    (action = 'read' AND rid > 0 AND rid = target) AS f_read_correct,
    (action = 'read' AND (rid <= 0 OR rid NOT IN (SELECT doc_id + 1 FROM documents))) AS f_invalid_read,
    (action = 'answer') AS f_attempted,
    (action = 'answer' AND k % 5 = 0) AS f_dont_know,
    (action = 'answer' AND k % 5 <> 0) AS f_judged,
    (action = 'answer' AND k % 5 <> 0 AND k % 3 <> 0) AS f_text_correct,
    (action = 'answer' AND k % 5 <> 0 AND src = target) AS f_found_contract,
    CASE WHEN action = 'fail' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS p_tokens,
    CASE WHEN action = 'fail' THEN 0 ELSE k END AS c_tokens,
    CASE WHEN action = 'answer' AND k % 5 <> 0 THEN k + 100 ELSE 0 END AS jp_tokens,
    CASE WHEN action = 'answer' AND k % 5 <> 0 THEN 1 ELSE 0 END AS jc_tokens
  FROM act a WHERE turn <= 10),
cls2 AS (
  SELECT *, outcome NOT IN ('searched', 'read') AS terminal,
         outcome IN ('model_failure', 'text_reply', 'no_call', 'unknown_tool') AS f_bad_name,
         outcome IN ('no_function', 'bad_arguments') AS f_bad_args,
         outcome IN ('unparsable', 'null_call') AS f_cant_parse
  FROM cls),
kept AS (
  SELECT * FROM (
    SELECT *, min(CASE WHEN terminal THEN turn END) OVER (PARTITION BY trajectory_id) AS t_end,
              count(*) OVER (PARTITION BY trajectory_id) AS n_logged
    FROM cls2)
  WHERE t_end IS NULL OR turn <= t_end),
rub0 AS (
  SELECT trajectory_id, first(user_id) AS scenario_id, first(use_tools) AS use_tools,
         max(t_end) AS t_end, max(n_logged) AS n_logged,
         bool_or(f_text_correct) AS clause_text_correct, bool_or(f_found_contract) AS found_correct_contract,
         bool_or(f_attempted) AS attempted_answer, bool_or(f_dont_know) AS returned_i_dont_know,
         bool_or(f_found_in_search) AS ever_found_correct_contract_in_search,
         bool_or(f_read_correct) AS ever_read_correct_contract,
         bool_or(f_invalid_read) AS tried_to_read_invalid_contract,
         bool_or(f_cant_parse) AS cant_parse_tool_call, bool_or(f_bad_name) AS bad_tool_call_name,
         bool_or(f_bad_args) AS bad_tool_call_args,
         CAST(sum(p_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(c_tokens) AS BIGINT) AS completion_tokens,
         CAST(sum(jp_tokens) AS BIGINT) AS judge_prompt_tokens, CAST(sum(jc_tokens) AS BIGINT) AS judge_completion_tokens,
         arg_max(outcome, turn) AS last_outcome,
         (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration
  FROM kept GROUP BY trajectory_id),
rub AS (
  SELECT trajectory_id, scenario_id, use_tools,
         CASE WHEN t_end IS NOT NULL OR n_logged >= 10 THEN 'valid' ELSE 'incomplete' END AS status,
         CASE WHEN t_end IS NULL AND n_logged >= 10 THEN 'out_of_turns' WHEN t_end IS NOT NULL THEN last_outcome
              ELSE 'incomplete' END AS stop_reason,
         clause_text_correct, found_correct_contract,
         CAST(coalesce(t_end, CASE WHEN n_logged >= 10 THEN 11 END, n_logged) AS BIGINT) AS num_turns,
         attempted_answer, returned_i_dont_know, ever_found_correct_contract_in_search, ever_read_correct_contract,
         tried_to_read_invalid_contract, cant_parse_tool_call, bad_tool_call_name, bad_tool_call_args,
         (t_end IS NULL AND n_logged >= 10) AS ran_out_of_turns,
         prompt_tokens, completion_tokens, judge_prompt_tokens, judge_completion_tokens, duration
  FROM rub0),
rew AS (
  SELECT *, CASE
      WHEN cant_parse_tool_call THEN -2.0 WHEN bad_tool_call_name THEN -1.9
      WHEN bad_tool_call_args THEN -1.8 WHEN tried_to_read_invalid_contract THEN -1.7
      WHEN NOT attempted_answer THEN (CASE WHEN ran_out_of_turns THEN -0.5 ELSE -0.3 END)
           + (CASE WHEN ever_found_correct_contract_in_search THEN 0.05 ELSE 0.0 END)
           + (CASE WHEN ever_read_correct_contract THEN 0.05 ELSE 0.0 END)
      WHEN clause_text_correct AND found_correct_contract THEN 1.0 + 0.2 * (1 - num_turns / 10.0)
      ELSE (CASE WHEN found_correct_contract THEN -1.0 ELSE -1.2 END)
           + (CASE WHEN ever_found_correct_contract_in_search THEN 0.05 ELSE 0.0 END)
           + (CASE WHEN ever_read_correct_contract THEN 0.05 ELSE 0.0 END)
    END AS reward_raw
  FROM rub),
met AS (
  SELECT trajectory_id, scenario_id, status,
         CAST(clause_text_correct AS INTEGER) AS clause_text_correct, CAST(found_correct_contract AS INTEGER) AS found_correct_contract,
         CAST(attempted_answer AS INTEGER) AS attempted_answer, CAST(returned_i_dont_know AS INTEGER) AS returned_i_dont_know,
         CAST(ever_found_correct_contract_in_search AS INTEGER) AS ever_found_correct_contract_in_search,
         CAST(ever_read_correct_contract AS INTEGER) AS ever_read_correct_contract,
         CAST(tried_to_read_invalid_contract AS INTEGER) AS tried_to_read_invalid_contract,
         CAST(cant_parse_tool_call AS INTEGER) AS cant_parse_tool_call, CAST(bad_tool_call_name AS INTEGER) AS bad_tool_call_name,
         CAST(bad_tool_call_args AS INTEGER) AS bad_tool_call_args, CAST(ran_out_of_turns AS INTEGER) AS ran_out_of_turns,
         num_turns, prompt_tokens, completion_tokens, judge_prompt_tokens, judge_completion_tokens,
         CAST(duration AS DOUBLE) AS duration, CAST(reward_raw AS DOUBLE) AS reward
  FROM rew)"""

RUN_METRIC_COLS = [
    "clause_text_correct", "found_correct_contract", "attempted_answer", "returned_i_dont_know",
    "ever_found_correct_contract_in_search", "ever_read_correct_contract", "tried_to_read_invalid_contract",
    "cant_parse_tool_call", "bad_tool_call_name", "bad_tool_call_args", "ran_out_of_turns",
    "num_turns", "prompt_tokens", "completion_tokens", "judge_prompt_tokens", "judge_completion_tokens",
    "duration", "reward"]


def _sd(expr: str, places: int) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(38,{places})) AS DOUBLE)"


ORACLE["parse_tool_call"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, turn,
  CASE WHEN action IN ('search', 'read', 'answer', 'unknown', 'broken') AND use_tools THEN 'tools'
       WHEN NOT use_tools AND action NOT IN ('fail') THEN 'json' ELSE 'none' END AS call_source,
  CASE WHEN action = 'fail' THEN 'model_failure'
       WHEN action = 'text' THEN CASE WHEN use_tools THEN 'text_reply' ELSE 'unparsable' END
       WHEN action = 'broken' THEN CASE WHEN use_tools THEN 'bad_arguments' ELSE 'unparsable' END
       ELSE 'ok' END AS parse_status,
  CASE WHEN action IN ('search') THEN 'search_contracts' WHEN action = 'read' THEN 'read_contract'
       WHEN action = 'answer' THEN 'return_final_answer' WHEN action = 'unknown' THEN 'delete_contract' END AS tool_name,
  CASE WHEN action = 'search' THEN 'keywords,max_results' WHEN action IN ('read', 'unknown') THEN 'contract_id'
       WHEN action = 'answer' THEN 'extracted_clause_text,source_contract_id' END AS arg_keys
FROM act"""

ORACLE["rubric"] = f"""WITH {RUN_ACT}
SELECT * EXCLUDE (duration, use_tools) FROM rub"""

ORACLE["reward"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, status, stop_reason, num_turns, {_sd('reward_raw', 9)} AS reward FROM rew"""

ORACLE["metrics"] = f"""WITH {RUN_ACT}
SELECT * REPLACE ({_sd('reward', 9)} AS reward, {_sd('duration', 6)} AS duration) FROM met"""

ORACLE["benchmark_means"] = f"""WITH {RUN_ACT}
SELECT {', '.join(_sd(f'avg({c})', 9) + f' AS {c}' for c in RUN_METRIC_COLS)},
       count(*) AS n_trajectories
FROM met WHERE status = 'valid'"""

ORACLE["run_counts"] = f"""WITH {RUN_ACT}
SELECT count(*) FILTER (WHERE status = 'valid') AS num_valid, count(*) FILTER (WHERE status <> 'valid') AS num_errors
FROM met"""

ORACLE["run_log"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, model, split, {_sd('reward', 9)} AS reward
FROM met, (VALUES ('first', 'train'), ('second', 'test')) v(model, split) WHERE status = 'valid'"""

ORACLE["union_metrics"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, {_sd('reward', 9)} AS reward, NULL::DOUBLE AS duration FROM met WHERE status = 'valid'
UNION ALL
SELECT trajectory_id, NULL, {_sd('duration', 6)} FROM met WHERE status <> 'valid'"""

ORACLE["trajectory_groups"] = f"""WITH {RUN_ACT}
SELECT scenario_id, count(*) AS n_runs, {_sd('avg(reward)', 9)} AS mean_reward,
       {_sd('min(reward)', 9)} AS min_reward, {_sd('max(reward)', 9)} AS max_reward,
       {_sd('stddev_pop(reward)', 6)} AS std_reward,
       CAST(sum(clause_text_correct * found_correct_contract) AS BIGINT) AS n_correct
FROM met WHERE status = 'valid' GROUP BY scenario_id"""

JUDGE_USER_SQL = render_sql(JUDGE_USER_TEMPLATE, clause_type="'clause_' || CAST(user_id % 5 AS VARCHAR)",
                            truth="'clause ' || CAST(user_id % 100 AS VARCHAR)", extracted="ans_text")

ORACLE["judge_requests"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, turn, md5({JUDGE_USER_SQL}) AS request_key, {JUDGE_USER_SQL} AS user_content
FROM kept WHERE f_judged"""

ORACLE["judge_verdicts"] = f"""WITH {RUN_ACT}
SELECT trajectory_id, turn, CASE WHEN k % 3 <> 0 THEN ' True' ELSE 'False' || chr(10) END AS reply,
       k % 3 <> 0 AS verdict
FROM kept WHERE f_judged"""

_SYS_SQL = render_sql(AGENT_SYSTEM_TEMPLATE, contract_title="c.title", contract_id="r.target",
                      clause_type="'clause_' || CAST(r.user_id % 5 AS VARCHAR)", max_turns="10")
_USER_SQL = render_sql(AGENT_USER_TEMPLATE, clause_type="'clause_' || CAST(r.user_id % 5 AS VARCHAR)",
                       contract_id="r.target")
_SUFFIX = "'" + JSON_MODE_SUFFIX.replace("'", "''") + "'"

ORACLE["prompt_messages"] = f"""WITH {DOCS}, {RUN_ACT},
runs AS (SELECT DISTINCT trajectory_id, user_id, use_tools, target FROM act)
SELECT r.trajectory_id, r.user_id AS scenario_id, r.target AS contract_id, c.title AS contract_title,
       'clause_' || CAST(r.user_id % 5 AS VARCHAR) AS clause_type,
       CASE WHEN r.use_tools THEN {_SYS_SQL} ELSE {_SYS_SQL} || {_SUFFIX} END AS system_prompt,
       {_USER_SQL} AS user_prompt
FROM runs r LEFT JOIN docs c ON c.contract_id = r.target"""

_CONF = "'" + FINAL_ANSWER_CONFIRMATION + "' || substr(ans_text, 1, 50) || '...'"

ORACLE["tool_reply"] = f"""WITH {DOCS}, {RUN_ACT},
cd AS (SELECT contract_id, title, replace(text, chr(10), {SEP_SQL}) AS full_text FROM docs),
reads AS (
  SELECT k.trajectory_id, k.turn, 'call_' || CAST(k.event_id AS VARCHAR) AS tool_call_id,
         CASE WHEN k.rid <= 0 THEN to_json({{'error': 'Contract ID ' || CAST(k.rid AS VARCHAR) || ' is invalid.'}})::VARCHAR
              WHEN c.contract_id IS NULL THEN to_json({{'error': 'Contract with ID ' || CAST(k.rid AS VARCHAR) || ' not found.'}})::VARCHAR
              ELSE to_json({{'id': k.rid, 'title': c.title, 'full_text': c.full_text}})::VARCHAR END AS content
  FROM kept k LEFT JOIN cd c ON c.contract_id = k.rid
  WHERE k.outcome = 'read')
SELECT trajectory_id, turn, 'tool' AS role, tool_call_id, md5(content) AS content_md5,
       CAST(length(content) AS BIGINT) AS content_length FROM reads
UNION ALL
SELECT trajectory_id, turn, 'confirmation', NULL, md5({_CONF}), CAST(length({_CONF}) AS BIGINT)
FROM kept WHERE outcome = 'answered'"""


# --- step 7: nested JSON ----------------------------------------------------------
# Case per doc_id % 11 (see pactum.sources.adapters.raw_contract_lines):
# 5 (context null) and 8 (no title) are rejected, 9 (no paragraphs) dropped,
# 4 loses paragraph 0, 7 loses the QA of paragraph 0, 10 loses every QA.

RAW = DOCS + """,
rdocs AS (SELECT *, doc_id % 11 AS v FROM docs),
rstat AS (
  SELECT doc_id, v, title,
         CASE WHEN v IN (5, 8) THEN 'rejected' WHEN v = 9 THEN 'dropped' ELSE 'ok' END AS status,
         CASE WHEN v = 5 THEN 'bad_paragraph' WHEN v = 8 THEN 'bad_title' WHEN v = 9 THEN 'no_paragraphs' END AS reason,
         CASE WHEN v = 4 THEN list_slice(lines, 2, len(lines)) ELSE lines END AS kept_lines,
         CASE WHEN v = 4 THEN 1 ELSE 0 END AS shift
  FROM rdocs),
rparas AS (
  SELECT doc_id, v, shift, unnest(kept_lines) AS context,
         unnest(generate_series(0, len(kept_lines) - 1)) AS para_idx
  FROM rstat WHERE status = 'ok'),
rparas_b AS (
  SELECT *, para_idx + shift AS orig_idx,
         coalesce(sum(length(context) + 27) OVER (PARTITION BY doc_id ORDER BY para_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_offset
  FROM rparas),
rqa AS (SELECT * FROM rparas_b WHERE v <> 10 AND NOT (v = 7 AND orig_idx = 0)),
rsentences AS (
  SELECT doc_id, para_idx, base_offset, 'clause_' || CAST(orig_idx % 5 AS VARCHAR) AS clause_type,
         unnest(string_split(context, '.')) AS text, generate_subscripts(string_split(context, '.'), 1) AS raw_idx
  FROM rqa WHERE orig_idx % 7 <> 6),
rraw_spans AS (
  SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, para_idx ORDER BY raw_idx
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS answer_start
  FROM rsentences),
rspans AS (
  SELECT doc_id, para_idx, clause_type, text,
         row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY raw_idx) - 1 AS ans_idx,
         base_offset + answer_start AS start_char, base_offset + answer_start + length(text) AS end_char
  FROM rraw_spans WHERE text <> '')"""

ORACLE["load_nested"] = f"""WITH {RAW}
SELECT doc_id AS contract_seq,
       CASE WHEN status = 'ok' THEN row_number() OVER (PARTITION BY status = 'ok' ORDER BY doc_id) END AS contract_id,
       status, reason, CASE WHEN v = 8 THEN NULL ELSE title END AS title,
       CASE WHEN status = 'ok' THEN CAST(len(kept_lines) AS BIGINT) END AS n_paragraphs
FROM rstat"""

ORACLE["load_envelope"] = f"""WITH {RAW}
SELECT doc_id AS contract_seq, status, reason, CASE WHEN v = 8 THEN NULL ELSE title END AS title,
       CASE WHEN status = 'ok' THEN CAST(len(kept_lines) AS BIGINT) END AS n_paragraphs
FROM rstat"""

ORACLE["load_envelope_splits"] = ORACLE["load_envelope"]
ORACLE["load_first"] = ORACLE["load_envelope"] + f" WHERE doc_id < {VAL_SET_SIZE}"

ORACLE["validate_nested"] = f"""WITH {RAW}
SELECT s.doc_id AS contract_seq, CAST(s.para_idx AS BIGINT) AS para_idx, CAST(s.ans_idx AS BIGINT) AS ans_idx,
       s.clause_type, s.text, CAST(s.start_char AS BIGINT) AS start_char, CAST(s.end_char AS BIGINT) AS end_char,
       substr(array_to_string(r.kept_lines, {SEP_SQL}), CAST(s.start_char + 1 AS BIGINT),
              CAST(s.end_char - s.start_char AS BIGINT)) = s.text AS text_matches
FROM rspans s JOIN rstat r USING (doc_id)"""

ORACLE["roundtrip_nested"] = f"""WITH {RAW}
SELECT doc_id AS contract_seq, title, CAST(len(kept_lines) AS BIGINT) AS n_paragraphs,
       CAST(CASE WHEN v = 10 THEN 0 WHEN v = 7 AND len(kept_lines) > 0 THEN len(kept_lines) - 1
                 ELSE len(kept_lines) END AS BIGINT) AS n_qas,
       md5(array_to_string(kept_lines, {SEP_SQL})) AS full_text_md5
FROM rstat WHERE status = 'ok'"""


# --- step 8: index after the change feed = index of the final state ----------------

ORACLE["index_upsert"] = f"""WITH {DOCS},
fin AS (
  SELECT contract_id, title,
         CASE WHEN doc_id % 11 = 0 THEN 'Replaced text ' || CAST(doc_id AS VARCHAR)
              WHEN doc_id % 5 = 0 THEN replace(text, chr(10), {SEP_SQL}) || {SEP_SQL} || 'Amended clause ' || CAST(doc_id AS VARCHAR)
              ELSE replace(text, chr(10), {SEP_SQL}) END AS full_text
  FROM docs WHERE doc_id % 7 <> 0 OR doc_id % 11 = 0),
ctoks AS (SELECT contract_id, {FOLDED.replace('@X@', 'title')} AS tt, {FOLDED.replace('@X@', 'full_text')} AS bt FROM fin)
SELECT contract_id, CAST(0 AS BIGINT) AS col, CAST(unnest(generate_series(0, len(tt) - 1)) AS BIGINT) AS pos, unnest(tt) AS token FROM ctoks
UNION ALL
SELECT contract_id, CAST(1 AS BIGINT), CAST(unnest(generate_series(0, len(bt) - 1)) AS BIGINT), unnest(bt) FROM ctoks"""


# --- snippets (F5): the window rule of pactum.operators.search.snippets in SQL -----

SNIPPET_CHAIN = f"""hits AS (SELECT query_id, rank, contract_id FROM ranked WHERE rank <= k),
hocc AS (SELECT o.query_id, o.contract_id, o.kw_idx, o.col, o.start, o.start + o.n_tok - 1 AS "end"
         FROM occ o JOIN hits h USING (query_id, contract_id)),
cand AS (SELECT query_id, contract_id, col, start,
                count(DISTINCT kw_idx) OVER w AS n_kw, count(*) OVER w AS n_occ
         FROM hocc
         WINDOW w AS (PARTITION BY query_id, contract_id ORDER BY col * 1099511627776 + start
                      RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING)),
best AS (SELECT * FROM (
           SELECT query_id, contract_id, col, start AS w0,
                  row_number() OVER (PARTITION BY query_id, contract_id ORDER BY n_kw DESC, n_occ DESC, col, start) AS r
           FROM cand) WHERE r = 1),
btxt AS (SELECT b.*, CASE WHEN b.col = 0 THEN c.title ELSE c.full_text END AS txt
         FROM best b JOIN cdocs c USING (contract_id)),
bt AS (SELECT *, regexp_extract_all(txt, {PAT}) AS toks, regexp_split_to_array(txt, {PAT}) AS seps FROM btxt),
bw AS (SELECT *, len(toks) AS n, greatest(0, least(w0, len(toks) - 15)) AS a FROM bt),
bz AS (SELECT *, least(n - 1, a + 14) AS z FROM bw),
idx AS (SELECT query_id, contract_id, col, a, z, toks, seps, unnest(generate_series(a, z)) AS i FROM bz),
piece AS (
  SELECT x.query_id, x.contract_id, x.i,
    (CASE WHEN cov AND (x.i = x.a OR NOT jprev) THEN '<b>' ELSE '' END)
    || x.toks[x.i + 1]
    || (CASE WHEN cov AND (x.i = x.z OR NOT jnext) THEN '</b>' ELSE '' END)
    || (CASE WHEN x.i < x.z THEN x.seps[x.i + 2] ELSE '' END) AS p
  FROM (
    SELECT idx.*,
      EXISTS (SELECT 1 FROM hocc h WHERE h.query_id = idx.query_id AND h.contract_id = idx.contract_id
              AND h.col = idx.col AND h.start <= idx.i AND h."end" >= idx.i) AS cov,
      EXISTS (SELECT 1 FROM hocc h WHERE h.query_id = idx.query_id AND h.contract_id = idx.contract_id
              AND h.col = idx.col AND h.start <= idx.i - 1 AND h."end" >= idx.i) AS jprev,
      EXISTS (SELECT 1 FROM hocc h WHERE h.query_id = idx.query_id AND h.contract_id = idx.contract_id
              AND h.col = idx.col AND h.start <= idx.i AND h."end" >= idx.i + 1) AS jnext
    FROM idx) x),
body AS (SELECT query_id, contract_id, string_agg(p, '' ORDER BY i) AS s FROM piece GROUP BY query_id, contract_id)"""

SNIPPET_TEXT = ("(CASE WHEN b.a > 0 THEN ' ... ' ELSE b.seps[1] END) || y.s"
                " || (CASE WHEN b.z < b.n - 1 THEN ' ... ' ELSE b.seps[len(b.seps)] END)")

ORACLE["search_snippet"] = f"""WITH {SEARCH},
{SNIPPET_CHAIN}
SELECT CAST(h.query_id AS BIGINT) AS query_id, CAST(h.rank AS BIGINT) AS rank, h.contract_id,
       CAST(b.col AS BIGINT) AS snippet_col, {SNIPPET_TEXT} AS snippet
FROM hits h JOIN bz b USING (query_id, contract_id) JOIN body y USING (query_id, contract_id)"""



# --- replay of the executed search calls: the batch comes from the events ----------

from pactum.sources.runlog import SEARCH_KEYWORDS  # noqa: E402

KEYWORD_SET = f"""CASE k % 10 {' '.join(f"WHEN {i} THEN [{', '.join(repr(w) for w in kw)}]::VARCHAR[]" for i, kw in enumerate(SEARCH_KEYWORDS))} END"""

# Each distinct keyword list is ranked once (query_id = its number), then fanned out to the calls.
ORACLE["search_replay"] = f"""WITH {CTOKS}, {RUN_ACT},
calls AS (SELECT trajectory_id || ':' || CAST(turn AS VARCHAR) AS call_id, k % 10 AS list FROM kept WHERE action = 'search'),
q AS (SELECT DISTINCT k % 10 AS query_id, {KEYWORD_SET} AS keywords, 10 AS max_results FROM kept WHERE action = 'search'),""" + SEARCH_CORE + f""",
{SNIPPET_CHAIN}
SELECT c.call_id AS query_id, CAST(h.rank AS BIGINT) AS rank, h.contract_id,
       r.score, {SNIPPET_TEXT} AS snippet
FROM hits h JOIN ranked r USING (query_id, contract_id) JOIN bz b USING (query_id, contract_id)
     JOIN body y USING (query_id, contract_id) JOIN calls c ON c.list = h.query_id"""


def _replaced(text: str, old: str, new: str) -> str:
    if old not in text:
        raise ValueError(f"oracle text no longer holds {old[:60]!r}")
    return text.replace(old, new, 1)


# tool_reply gains the search replies: executed tool-mode searches replayed
# against the index, hits listed in rank order as JSON.
ORACLE["tool_reply"] = _replaced(
    ORACLE["tool_reply"], "WITH " + DOCS + ", " + RUN_ACT + ",", "WITH " + CTOKS + ", " + RUN_ACT + ",")
ORACLE["tool_reply"] = _replaced(
    ORACLE["tool_reply"],
    "cd AS (SELECT contract_id, title, replace(text, chr(10), " + SEP_SQL + ") AS full_text FROM docs),",
    f"""cd AS (SELECT contract_id, title, replace(text, chr(10), {SEP_SQL}) AS full_text FROM docs),
q AS (SELECT DISTINCT k % 10 AS query_id, {KEYWORD_SET} AS keywords, 10 AS max_results
      FROM kept WHERE outcome = 'searched'),""" + SEARCH_CORE + ",\n" + SNIPPET_CHAIN + """,
sreplies AS (
  SELECT h.query_id, to_json(list({'contract_id': h.contract_id, 'title': c.title,
                                   'snippet': (CASE WHEN b.a > 0 THEN ' ... ' ELSE b.seps[1] END) || y.s
                                     || (CASE WHEN b.z < b.n - 1 THEN ' ... ' ELSE b.seps[len(b.seps)] END)}
                                  ORDER BY h.rank))::VARCHAR AS payload
  FROM hits h JOIN cdocs c USING (contract_id) JOIN bz b USING (query_id, contract_id)
       JOIN body y USING (query_id, contract_id)
  GROUP BY h.query_id),""") + """
UNION ALL
SELECT k.trajectory_id, k.turn, 'tool', 'call_' || CAST(k.event_id AS VARCHAR),
       md5(coalesce(r.payload, '[]')), CAST(length(coalesce(r.payload, '[]')) AS BIGINT)
FROM kept k LEFT JOIN sreplies r ON r.query_id = k.k % 10
WHERE k.outcome = 'searched'"""


# --- step 9: runs logged as conversations, schedule slots, counted load, verdict cache --------

# The texts of the table hold no JSON object, so the first reply of a run ends it.
CONV_RUNS = f"""
rep AS (
  SELECT conv_id, turn AS position, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text NULLS FIRST) AS n
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL),
crun AS (
  SELECT conv_id, position, CAST(conv_id AS VARCHAR) AS trajectory_id,
         CAST(floor(conv_id / {RUNS_PER_SCENARIO}) + 1 AS BIGINT) AS scenario_id,
         CASE WHEN text IS NULL THEN 'model_failure' WHEN text = '' THEN 'no_call'
              WHEN text LIKE '%{{%}}%' THEN error('a call in a text') ELSE 'unparsable' END AS stop_reason
  FROM rep WHERE n = 1),
crew AS (SELECT *, CAST(CASE WHEN stop_reason = 'unparsable' THEN -2.0 ELSE -1.9 END AS DOUBLE) AS reward FROM crun)"""

ORACLE["conversation_rubric"] = f"""WITH {CONV_RUNS}
SELECT trajectory_id, scenario_id, 'valid' AS status, stop_reason, FALSE AS clause_text_correct,
       FALSE AS found_correct_contract, CAST(1 AS BIGINT) AS num_turns, FALSE AS attempted_answer,
       FALSE AS returned_i_dont_know, FALSE AS ever_found_correct_contract_in_search,
       FALSE AS ever_read_correct_contract, FALSE AS tried_to_read_invalid_contract,
       stop_reason = 'unparsable' AS cant_parse_tool_call, stop_reason <> 'unparsable' AS bad_tool_call_name,
       FALSE AS bad_tool_call_args, FALSE AS ran_out_of_turns, CAST(0 AS BIGINT) AS prompt_tokens,
       CAST(0 AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS judge_prompt_tokens,
       CAST(0 AS BIGINT) AS judge_completion_tokens
FROM crun"""

ORACLE["conversation_trajectories"] = f"""WITH {SCEN}, {CONV_RUNS},
said AS (
  SELECT r.conv_id, count(*) AS n,
         string_agg(c.role || ':' || coalesce(c.text, ''), chr(10) ORDER BY c.turn, c.role, c.text) AS m
  FROM crew r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn <= r.position GROUP BY r.conv_id)
SELECT r.trajectory_id, CAST(s.scenario_id AS BIGINT) AS scenario_id, s.contract_title, s.clause_type,
       CAST(d.n AS BIGINT) AS n_messages, md5(d.m) AS messages_md5, CAST(1 AS BIGINT) AS num_turns, r.reward
FROM crew r JOIN said d USING (conv_id) LEFT JOIN scen s ON s.scenario_id = r.scenario_id"""

ORACLE["step_groups"] = f"""WITH sched AS ({ORACLE["training_schedule"]}), {CONV_RUNS},
slots AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY global_step, run_idx) AS slot FROM sched),
runs AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY trajectory_id) AS slot FROM crew)
SELECT global_step, scenario_id, count(run_idx) AS n_slots, count(trajectory_id) AS n_runs,
       count(*) FILTER (WHERE trajectory_id IS NULL) AS n_missing, {_sd('avg(reward)', 9)} AS mean_reward,
       coalesce(string_agg(CASE WHEN run_idx IS NOT NULL THEN trajectory_id END, ',' ORDER BY run_idx), '') AS runs
FROM slots FULL JOIN runs USING (scenario_id, slot) GROUP BY global_step, scenario_id"""

ORACLE["load_report"] = f"""WITH {RAW},
n AS (SELECT count(*) AS n_read, count(*) FILTER (WHERE status = 'ok') AS n_loaded,
             count(*) FILTER (WHERE status <> 'ok') AS n_skipped,
             count(*) FILTER (WHERE reason = 'not_an_object') AS n_not_an_object,
             count(*) FILTER (WHERE reason = 'no_paragraphs') AS n_no_paragraphs,
             count(*) FILTER (WHERE reason = 'paragraphs_not_a_list') AS n_paragraphs_not_a_list,
             count(*) FILTER (WHERE reason = 'bad_paragraph') AS n_bad_paragraph,
             count(*) FILTER (WHERE reason = 'bad_title') AS n_bad_title,
             (SELECT count(*) FROM rspans) AS n_annotations
      FROM rstat)
SELECT name AS count_name, CAST(value AS BIGINT) AS n FROM (UNPIVOT n ON *)"""

ORACLE["verdict_cache"] = f"""WITH {RUN_ACT},
rq AS (SELECT trajectory_id, turn, md5({JUDGE_USER_SQL}) AS request_key, k % 3 <> 0 AS verdict,
              CAST(CASE WHEN substr(md5(trajectory_id), 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 0 ELSE 1 END AS BIGINT) AS batch
       FROM kept WHERE f_judged)
SELECT request_key, batch, CASE WHEN verdict THEN ' True' ELSE 'False' || chr(10) END AS reply, verdict
FROM (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY batch, trajectory_id, turn) AS rn FROM rq) WHERE rn = 1"""
