"""Declared schemas and fixed values.

Schemas are declared once here and never inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the original tool's for identical results.
# ---------------------------------------------------------------------------
# Separator placed between paragraph contexts in the full contract text
# (27 characters: two newlines, dashes and the words, two newlines).
PARAGRAPH_SEP = "\n\n--- PARAGRAPH BREAK ---\n\n"
PARAGRAPH_SEP_LEN = len(PARAGRAPH_SEP)
# Search result cap and snippet width in tokens.
MAX_SEARCH_RESULTS = 10
SNIPPET_TOKENS = 15
SNIPPET_OPEN = "<b>"
SNIPPET_CLOSE = "</b>"
SNIPPET_ELLIPSIS = " ... "
# BM25 parameters of the full-text ranking, and the floor for a non-positive idf.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6
# Agent run settings (defaults of the policy / training configuration).
MAX_TURNS = 10
TRAJECTORIES_PER_GROUP = 6
GROUPS_PER_STEP = 1
EVAL_STEPS = 30
VAL_SET_SIZE = 100
TRAINING_DATASET_SIZE = 4000
NUM_EPOCHS = 4
TRAIN_RATIO = 0.8
SPLIT_SEED = 42
# The sentence an agent returns when it gives up, and its "no contract" id.
DONT_KNOW_TEXT = "i could not find the clause."
DONT_KNOW_ID = -1
# Tool names offered to the agent.
TOOL_SEARCH = "search_contracts"
TOOL_READ = "read_contract"
TOOL_ANSWER = "return_final_answer"
# Preview length used in confirmation and log messages.
PREVIEW_CHARS = 50
# White space as Python's ``str.strip`` sees it.
WHITE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# One token: Unicode letters and digits, with combining marks after the first.
TOKEN_PATTERN = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"
# ---------------------------------------------------------------------------
# Our own version tag, written into processed files (nothing reads its value).
PROCESSED_VERSION = "processed_v1.0"

ANSWER_SPAN = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("answer_start", T.LongType()),
])

QUESTION_ANSWER = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("qa_id", T.StringType()),
    T.StructField("answers", T.ArrayType(ANSWER_SPAN)),
    T.StructField("is_impossible", T.BooleanType()),
])

PARAGRAPH = T.StructType([
    T.StructField("context", T.StringType()),
    T.StructField("qas", T.ArrayType(QUESTION_ANSWER)),
])

# One validated contract per row; ``contract_seq`` is the 0-based input order.
CONTRACT_NESTED = T.StructType([
    T.StructField("contract_seq", T.LongType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(PARAGRAPH)),
])

CONTRACTS_TABLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("full_text", T.StringType(), False),
])

ANNOTATIONS_TABLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("contract_id", T.LongType(), False),
    T.StructField("clause_type", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("start_char", T.LongType(), False),
    T.StructField("end_char", T.LongType(), False),
])

SCENARIO_COLUMNS = [
    "scenario_id", "contract_id", "contract_title", "annotation_id",
    "clause_type", "ground_truth_clause_text", "start_char", "end_char",
]

TOOL_CALL = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("arguments", T.StringType()),
])

# Logged agent turns: one row per model reply.
TURNS = T.StructType([
    T.StructField("trajectory_id", T.StringType(), False),
    T.StructField("scenario_id", T.LongType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("use_tools", T.BooleanType()),
    T.StructField("llm_failed", T.BooleanType()),
    T.StructField("content", T.StringType()),
    T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    T.StructField("tool_result_ids", T.ArrayType(T.LongType())),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("ts", T.TimestampType()),
])

RUBRIC_FLAGS = [
    "clause_text_correct", "found_correct_contract", "attempted_answer",
    "returned_i_dont_know", "ever_found_correct_contract_in_search",
    "ever_read_correct_contract", "tried_to_read_invalid_contract",
    "cant_parse_tool_call", "bad_tool_call_name", "bad_tool_call_args",
    "ran_out_of_turns",
]
RUBRIC_COUNTERS = [
    "num_turns", "prompt_tokens", "completion_tokens",
    "judge_prompt_tokens", "judge_completion_tokens",
]
