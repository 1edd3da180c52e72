"""Message texts as native string expressions.

Templates use ``<<name>>`` placeholders; ``render`` turns one into a
``concat`` of literals and columns, ``render_sql`` into a SQL ``||`` chain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The message texts of the original agent and judge.
# ---------------------------------------------------------------------------
AGENT_SYSTEM_TEMPLATE = (
    "You are an expert legal assistant AI. Your task is to find specific clauses in legal contracts.\n"
    "You will be given the type of clause to find. Use the provided tools to search contracts and read "
    "their content to locate the requested clause text.\n"
    "\n"
    "Available Tools:\n"
    "- `search_contracts(keywords: list[str], max_results: int)`: Searches contracts by keywords in title "
    "or text. Returns contract IDs, titles, and snippets.\n"
    "- `read_contract(contract_id: int)`: Reads the full text of a specific contract given its ID.\n"
    "- `return_final_answer(extracted_clause_text: str, source_contract_id: int)`: Use this ONLY when you "
    "have found the exact text of the requested clause. Provide the full clause text and the ID of the "
    "contract it came from. If you cannot find the clause after searching, use this tool with \"I could "
    "not find the clause.\" and source_contract_id=-1.\n"
    "\n"
    "Current Task: Find the clause text for the following clause type in contract '<<contract_title>>' "
    "(ID: <<contract_id>>):\n"
    "Clause Type: \"<<clause_type>>\"\n"
    "\n"
    "Think step-by-step. First, search for the contract if necessary, then read it, then identify the "
    "exact clause text based on the type, and finally return the answer using `return_final_answer`. "
    "You have a maximum of <<max_turns>> turns.\n"
)
JSON_MODE_SUFFIX = '\n\n Respond with JSON for tool calls: {"tool_name": "...", "tool_args": {...}}'
AGENT_USER_TEMPLATE = "Please find the '<<clause_type>>' clause in contract ID <<contract_id>>."
JUDGE_SYSTEM = (
    "You are an expert evaluator comparing extracted legal clauses. You will see the target clause type, "
    "the ground truth text, and the text extracted by an AI assistant.\n"
    "Determine if the Extracted Text accurately and completely represents the Ground Truth Text for the "
    "specified Clause Type.\n"
    "Ignore minor differences in whitespace or punctuation unless they change the meaning significantly.\n"
    "Focus on semantic equivalence and completeness.\n"
    "Respond ONLY with the word 'True' if the extracted text is a good match, or 'False' otherwise. No "
    "other text, reasoning, or punctuation.\n"
)
JUDGE_USER_TEMPLATE = (
    "Clause Type: <<clause_type>>\n\n"
    "Ground Truth Text:\n```\n<<truth>>\n```\n\n"
    "Extracted Text:\n```\n<<extracted>>\n```\n\n"
    "Is the Extracted Text a correct match for the Ground Truth Text given the Clause Type? "
    "Respond only True or False."
)
FINAL_ANSWER_CONFIRMATION = "Final answer recorded: "
# ---------------------------------------------------------------------------

_PLACEHOLDER = re.compile(r"<<(\w+)>>")


def _parts(template: str):
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            yield ("lit", template[pos:m.start()])
        yield ("var", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("lit", template[pos:])


def render(template: str, **values: Column) -> Column:
    return F.concat(*[F.lit(v) if kind == "lit" else values[v].cast("string")
                      for kind, v in _parts(template)])


def render_sql(template: str, **values: str) -> str:
    out = []
    for kind, v in _parts(template):
        out.append("'" + v.replace("'", "''") + "'" if kind == "lit" else f"CAST({values[v]} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"


def agent_system_prompt(title: Column, contract_id: Column, clause_type: Column,
                        max_turns: Column, use_tools: Column) -> Column:
    base = render(AGENT_SYSTEM_TEMPLATE, contract_title=title, contract_id=contract_id,
                  clause_type=clause_type, max_turns=max_turns)
    return F.when(use_tools, base).otherwise(F.concat(base, F.lit(JSON_MODE_SUFFIX)))


def agent_user_prompt(clause_type: Column, contract_id: Column) -> Column:
    return render(AGENT_USER_TEMPLATE, clause_type=clause_type, contract_id=contract_id)


def judge_user_prompt(clause_type: Column, truth: Column, extracted: Column) -> Column:
    return render(JUDGE_USER_TEMPLATE, clause_type=clause_type, truth=truth, extracted=extracted)


def messages(system: Column, user: Column) -> Column:
    """ARRAY<STRUCT<role, content>> of a system and a user message."""
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


def tool_reply(payload_json: Column, tool_call_id: Column) -> Column:
    """``{"role": "tool", "tool_call_id": .., "content": <json>}`` as a struct."""
    return F.struct(F.lit("tool").alias("role"), tool_call_id.alias("tool_call_id"),
                    payload_json.alias("content"))
