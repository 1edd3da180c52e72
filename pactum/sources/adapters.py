"""Driver tables -> engine inputs.

Each adapter is a fixed, SQL-expressible function of the driver tables, so
the same derivation can be written as oracle SQL.

* contracts: ``documents`` rows become contracts; paragraph ``i`` is line
  ``i`` of the text.  ``contract_id = doc_id + 1``; the title is
  ``source || ' ' || lang || ' ' || doc_id`` (unique).
* annotations: per paragraph one question ``clause_<para_idx % 5>`` whose
  answers are all its '.'-separated sentences (empty ones dropped);
  every 7th paragraph (index % 7 = 6) is marked impossible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.operators.flatten import bound, exclusive_sums


def _sentences(line: Column, offset_type: str = "bigint") -> Column:
    """All non-empty '.'-separated sentences of a line, with their offsets."""
    def spans(parts):
        starts = exclusive_sums(F.transform(parts, lambda t: (F.length(t) + 1).cast("bigint")))
        return F.zip_with(parts, starts, lambda t, s: F.struct(t.alias("text"), s.cast(offset_type).alias("answer_start")))
    return F.filter(bound(F.split(line, r"\.", -1), spans), lambda a: a["text"] != F.lit(""))


def _paragraph(line: Column, idx: Column, doc_id: Column) -> Column:
    answers = _sentences(line)
    qa = F.struct(
        F.concat(F.lit("clause_"), (idx % 5).cast("string")).alias("question"),
        F.concat_ws("-", doc_id.cast("string"), idx.cast("string")).alias("qa_id"),
        answers.alias("answers"),
        (idx % 7 == 6).alias("is_impossible"),
    )
    return F.struct(line.alias("context"), F.array(qa).alias("qas"))


def nested_contracts(documents: DataFrame) -> DataFrame:
    """(contract_seq, contract_id, title, paragraphs) in the validated nested shape."""
    doc_id = F.col("doc_id")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    return documents.select(
        doc_id.alias("contract_seq"),
        (doc_id + 1).alias("contract_id"),
        F.concat_ws(" ", F.col("source"), F.col("lang"), doc_id.cast("string")).alias("title"),
        F.transform(lines, lambda line, i: _paragraph(line, i, doc_id)).alias("paragraphs"),
    )


def contracts_flat(documents: DataFrame) -> DataFrame:
    """(contract_id, title, full_text) straight from documents: the paragraph
    join with the separator equals replacing each newline by it."""
    from pactum.schemas import PARAGRAPH_SEP

    return documents.select(
        (F.col("doc_id") + 1).alias("contract_id"),
        F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("title"),
        F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\n"), F.lit(PARAGRAPH_SEP)).alias("full_text"),
    )


# --- raw nested JSON with data-dependent validation cases -------------------------

RAW_VARIANTS = 11  # case = doc_id % 11, see raw_contract_lines


def _raw_paragraphs(doc_id, lines, answer_start_type="bigint", imp_as_text=False, qa_key="id",
                    id_as_number=False, drop_context_0=False, bad_answer_0=False):
    def para(line, i):
        answers = _sentences(line, answer_start_type)
        if bad_answer_0:
            answers = F.when(i == 0, F.concat(answers, F.array(F.struct(
                F.lit("x").alias("text"), F.lit(12.5).cast(answer_start_type).alias("answer_start")))))\
                .otherwise(answers)
        qid = F.concat_ws("-", doc_id.cast("string"), i.cast("string"))
        qid = (doc_id * 1000 + i).cast("bigint") if id_as_number else qid
        imp = i % 7 == 6
        imp = F.when(imp, F.lit("yes")).otherwise(F.lit("no")) if imp_as_text else imp
        qa = F.struct(F.concat(F.lit("clause_"), (i % 5).cast("string")).alias("question"),
                      qid.alias(qa_key), answers.alias("answers"), imp.alias("is_impossible"))
        ctx = F.when(i == 0, F.lit(None).cast("string")).otherwise(line) if drop_context_0 else line
        return F.struct(ctx.alias("context"), F.array(qa).alias("qas"))
    return F.transform(lines, para)


def raw_contract_lines(documents: DataFrame) -> DataFrame:
    """One raw JSON contract per line (``seq``, ``title``, ``paragraphs`` with QA
    key ``id``), built from documents like ``nested_contracts`` but with one
    validation case per ``doc_id % 11``:

      1 answer_start as text ("12")      2 answer_start as float (12.0)
      3 is_impossible as "yes"/"no"      4 paragraph 0 has no context key
      5 paragraph 0 has context null     6 QA key qa_id instead of id
      7 paragraph 0's QA gets an answer at 12.5
      8 no title                         9 empty paragraph list
     10 QA ids are numbers               0 unchanged
    """
    d = F.col("doc_id")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    title = F.concat_ws(" ", F.col("source"), F.col("lang"), d.cast("string"))
    v = d % RAW_VARIANTS

    def doc(paragraphs, t=title, **opts):
        return F.to_json(F.struct(d.alias("seq"), t.alias("title"), paragraphs.alias("paragraphs")), opts or None)

    P = lambda **kw: _raw_paragraphs(d, lines, **kw)
    empty = F.array().cast("array<struct<context:string,qas:array<string>>>")
    line = (F.when(v == 1, doc(P(answer_start_type="string")))
            .when(v == 2, doc(P(answer_start_type="double")))
            .when(v == 3, doc(P(imp_as_text=True)))
            .when(v == 4, doc(P(drop_context_0=True)))
            .when(v == 5, doc(P(drop_context_0=True), ignoreNullFields="false"))
            .when(v == 6, doc(P(qa_key="qa_id")))
            .when(v == 7, doc(P(answer_start_type="double", bad_answer_0=True)))
            .when(v == 8, doc(P(), t=F.lit(None).cast("string")))
            .when(v == 9, doc(empty))
            .when(v == 10, doc(P(id_as_number=True)))
            .otherwise(doc(P())))
    return documents.select(d.alias("doc_id"), line.alias("value"))


def write_envelopes(documents: DataFrame, path: str, per_file: int = 200) -> None:
    """The same raw contracts as envelope files ``{"version", "data": [..]}`` of
    up to ``per_file`` contracts each, named so that the order of the paths is
    the order of the documents."""
    name = F.lpad(F.floor(F.col("doc_id") / per_file).cast("string"), 12, "0")
    files = (raw_contract_lines(documents).groupBy(name.alias("file"))
             .agg(F.sort_array(F.collect_list(F.struct("doc_id", "value"))).alias("rows")))
    data = F.array_join(F.transform("rows", lambda r: r["value"]), ",")
    (files.select("file", F.concat(F.lit('{"version": "v", "data": ['), data, F.lit("]}")).alias("value"))
     .write.partitionBy("file").text(path))


# --- change feed for the index upkeep -----------------------------------------------

def initial_contracts(documents: DataFrame) -> DataFrame:
    """Contracts indexed before the feed starts: documents with doc_id % 3 <> 0."""
    return contracts_flat(documents.filter(F.col("doc_id") % 3 != 0))


def change_feed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two batches of changes ``(contract_id, version, op, title, full_text)``:

    1. doc_id % 3 = 0 inserted (version 1); doc_id % 5 = 0 updated with an
       amended text (version 2);
    2. doc_id % 7 = 0 deleted (version 3); doc_id % 11 = 0 replaced by a new
       text (version 4, so 77 comes back after its delete).
    """
    from pactum.schemas import PARAGRAPH_SEP

    d = F.col("doc_id")
    base = contracts_flat(documents).withColumn("doc_id", F.col("contract_id") - 1)

    def rows(df, version, op, full_text):
        return df.select(F.col("contract_id").cast("bigint"), F.lit(version).cast("bigint").alias("version"),
                         F.lit(op).alias("op"), F.when(F.lit(op) != "delete", F.col("title")).alias("title"),
                         F.when(F.lit(op) != "delete", full_text).alias("full_text"))
    amended = F.concat(F.col("full_text"), F.lit(PARAGRAPH_SEP), F.lit("Amended clause "), d.cast("string"))
    replaced = F.concat(F.lit("Replaced text "), d.cast("string"))
    first = rows(base.filter(d % 3 == 0), 1, "upsert", F.col("full_text")).unionByName(
        rows(base.filter(d % 5 == 0), 2, "upsert", amended))
    second = rows(base.filter(d % 7 == 0), 3, "delete", F.lit(None).cast("string")).unionByName(
        rows(base.filter(d % 11 == 0), 4, "upsert", replaced))
    return first, second
