"""Quality rules, line first: clean the lines, then judge what is left.

Every line is tested by itself.  A line that looks like navigation, like
boilerplate, like symbol noise, or that neither ends in punctuation nor has the
end of a sentence inside is removed.
The document is rejected when it loses more than ``max_removed`` of its word
characters, or when it fails one of two base rules (too few words, too many
words inside repeated three-word windows).

Defined results: a NULL or empty text has no words and is rejected by the base
rule; an empty line is kept and has no weight; equal rows are judged alike,
each for itself; the id is passed through, NULL included; an empty table gives
an empty table.  Work and memory are linear in each text.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import map_rows

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A document may lose this share (percent) of its word characters to line rules.
MAX_REMOVED_PCT = 30
SYMBOLS = "#*$%&|<>"
#: Line rules as regular expressions that Python, Java and RE2 read alike.
WORD = r"[^\x20\x09-\x0D]+"
ENDED = r"[.!?:;,…\"'”’»)\]][\x20\x09-\x0D]*$"
SENTENCE = r"[.!?…][\"'”’»)\]]*[\x20\x09-\x0D]"
SHOUT = r"[!?]{2,}"
SEPARATOR = r"[|»›·•]"
BOILERPLATE = (
    r"(?i)(all rights reserved|licen[sc]ed under|released under the [a-z0-9 .-]*licen[sc]e|terms of (use|service)"
    r"|privacy policy|cookie policy|uses cookies|enable javascript|subscribe to our newsletter|click here to"
    r"|sign in to|log in to|share on (facebook|twitter)|copyright (©|\(c\)|[0-9]{4}))")

_WORD, _ENDED, _SENTENCE, _SHOUT = re.compile(WORD), re.compile(ENDED), re.compile(SENTENCE), re.compile(SHOUT)
_SEP, _BOILER = re.compile(SEPARATOR), re.compile(BOILERPLATE)

RESULT = [T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("n_lines_removed", T.LongType()), T.StructField("removed_chars", T.LongType()),
    T.StructField("clean_text", T.StringType())]


def line_fails(line: str, n_words: int, word_chars: int) -> bool:
    """One line with at least one word: does a rule remove it?"""
    if _ENDED.search(line) is None and _SENTENCE.search(line) is None:
        return True
    if 3 * len(_SHOUT.findall(line)) > n_words:
        return True
    if 4 * len(_SEP.findall(line)) > n_words:
        return True
    if 10 * sum(map(line.count, SYMBOLS)) > word_chars:
        return True
    return _BOILER.search(line) is not None


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, total, upto = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: str, max_removed_pct: int = MAX_REMOVED_PCT) -> tuple:
    """All result fields of one text, without the id."""
    n_words = chars = removed = removed_chars = dup = 0
    words: list[str] = []
    kept_lines, seen = [], set()
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        size = sum(map(len, own))
        words += own
        n_words += len(own)
        chars += size
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, len(own), size):
            removed += 1
            removed_chars += size
        else:
            kept_lines.append(line)
    repeated = repeat_words(words)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PCT * n_words
    kept = not failed and 100 * removed_chars <= max_removed_pct * chars
    return (n_words, chars, sum(map(text.count, SYMBOLS)), dup, repeated, failed, kept, removed, removed_chars,
            "\n".join(kept_lines) if removed else text)


def quality_rules(docs: DataFrame, max_removed_pct: int = MAX_REMOVED_PCT, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the counts, the verdict and the cleaned text."""
    names = [f.name for f in RESULT][1:]

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            rows = [judge(t or "", max_removed_pct) for t in batch.column("text").to_pylist()]
            return dict(zip(names, zip(*rows)))
        return step

    return map_rows(docs, {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text")}, RESULT, make, carry)
