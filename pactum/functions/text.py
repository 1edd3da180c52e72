"""Text expressions: tokeniser (F3), whitespace trim, previews.  All native."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.schemas import PREVIEW_CHARS, TOKEN_PATTERN, WHITE_SPACE


def _folds() -> tuple[str, str]:
    """Lower-case letters that are one base letter and one combining mark, and
    their base letters, over the Latin, Greek and Cyrillic blocks."""
    pairs = []
    for cp in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(cp)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) == 2 and unicodedata.category(parts[1]) == "Mn":
            pairs.append((letter, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def fold(c: Column) -> Column:
    """Lower case, accented letters folded to their base letter, combining marks dropped."""
    return F.regexp_replace(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), r"\p{Mn}+", "")


def raw_tokens(text: Column) -> Column:
    """Tokens as written: maximal runs of letters and digits (and their marks)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), 0)


def tokens(text: Column) -> Column:
    """index tokens -- the tokens of the folded text.  Folding neither makes
    nor removes a separator, so positions are those of ``raw_tokens`` (needed
    for snippets); it runs once over the text, not once per token."""
    return raw_tokens(fold(F.coalesce(text, F.lit(""))))


def separators(text: Column) -> Column:
    """The text between tokens: element i precedes token i, the last element
    follows the last token (``size = n_tokens + 1``)."""
    return F.split(F.coalesce(text, F.lit("")), TOKEN_PATTERN, -1)


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: Spark ``trim`` removes spaces only, and ``\\s`` is ASCII."""
    return F.regexp_replace(c, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def preview(c: Column, n: int = PREVIEW_CHARS) -> Column:
    """first ``n`` characters followed by '...'."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))
