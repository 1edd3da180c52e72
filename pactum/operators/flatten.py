"""Nested contracts -> full text, paragraph offsets and flat annotations.

All of it is narrow: a contract is one row, so offsets are computed inside
the row and the explodes never shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.schemas import PARAGRAPH_SEP, PARAGRAPH_SEP_LEN


def full_text(paragraphs: Column) -> Column:
    """Paragraph contexts joined with the separator."""
    return F.array_join(F.transform(paragraphs, lambda p: p["context"]), PARAGRAPH_SEP)


#: Elements of an array that are summed at a time.
SUM_CHUNK = 64


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a Python variable would put the
    whole expression at each of its uses, and inside a lambda none is shared."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(lens: Column) -> Column:
    """0 and the running sums, one element more than ``lens``; for short arrays (each step copies the sums so far)."""
    return F.aggregate(lens, F.array(F.lit(0).cast("bigint")),
                       lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def exclusive_sums(lens: Column) -> Column:
    """Running sum of an array of BIGINTs, each element without itself.

    Computed inside the row (no window and no shuffle) in chunks of ``SUM_CHUNK``
    elements: the sums in each chunk, the sums of the chunks, and the one added
    to the other, so an element costs a few steps whatever the array's length."""
    def summed(a):
        last = F.greatest(F.ceil(F.size(a) / SUM_CHUNK).cast("int") - 1, F.lit(0))
        chunks = F.transform(F.sequence(F.lit(0), last), lambda j: _running(F.slice(a, j * SUM_CHUNK + 1, SUM_CHUNK)))
        return bound(chunks, lambda parts: bound(
            _running(F.transform(parts, lambda p: F.element_at(p, -1))), lambda bases: F.flatten(F.transform(
                parts, lambda p, j: F.transform(F.slice(p, 1, F.size(p) - 1), lambda s: s + F.get(bases, j))))))
    return bound(lens, summed)


def paragraph_bases(paragraphs: Column) -> Column:
    """Start offset of every paragraph in the full text, i.e. the
    exclusive running sum of ``length(context) + len(SEP)``."""
    return exclusive_sums(
        F.transform(paragraphs, lambda p: (F.length(p["context"]) + PARAGRAPH_SEP_LEN).cast("bigint")))


def with_full_text(nested: DataFrame) -> DataFrame:
    return nested.withColumn("full_text", full_text(F.col("paragraphs")))


def paragraph_rows(nested: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per paragraph: (keep..., para_idx, base_offset, context, qas)."""
    keep = keep or ["contract_seq", "contract_id", "title"]
    with_bases = nested.select(*keep, "paragraphs", paragraph_bases(F.col("paragraphs")).alias("_bases"))
    exploded = with_bases.select(*keep, "_bases", F.posexplode("paragraphs").alias("para_idx", "p"))
    return exploded.select(
        *keep,
        "para_idx",
        F.element_at("_bases", F.col("para_idx") + 1).alias("base_offset"),
        F.col("p.context").alias("context"),
        F.col("p.qas").alias("qas"),
    )


def flat_annotations(nested: DataFrame, keep: list[str] | None = None,
                     check_text: bool = False) -> DataFrame:
    """Paragraph x QA x answer for possible QAs, offsets rebased
    to the whole document (end exclusive, in code points).

    With ``check_text`` the column ``text_matches`` reports whether the span's
    text stands at its place: it is looked up inside its own paragraph, whose
    place in the full text is fixed by the offsets, so the check is linear in
    the text.  The original never checks this, so it is a report, not a filter."""
    keep = keep or ["contract_seq", "contract_id", "title"]
    extra = ["context"] if check_text else []
    paras = paragraph_rows(nested, keep)
    qas = paras.select(*keep, *extra, "para_idx", "base_offset",
                       F.posexplode("qas").alias("qa_idx", "qa"))
    qas = qas.filter(~F.coalesce(F.col("qa.is_impossible"), F.lit(False)))
    spans = qas.select(*keep, *extra, "para_idx", "base_offset", "qa_idx",
                       F.col("qa.question").alias("clause_type"),
                       F.posexplode("qa.answers").alias("ans_idx", "a"))
    at = F.col("a.answer_start").cast("bigint")
    start = F.col("base_offset") + at
    matches = [((at >= 0) & (at <= F.length("context"))
                & (F.substring(F.col("context"), (at + 1).cast("int"), F.length("a.text")) == F.col("a.text")))
               .alias("text_matches")] if check_text else []
    return spans.select(
        *keep, "para_idx", "qa_idx", "ans_idx", "clause_type",
        F.col("a.text").alias("text"),
        start.alias("start_char"),
        (start + F.length(F.col("a.text"))).cast("bigint").alias("end_char"),
        *matches,
    )
