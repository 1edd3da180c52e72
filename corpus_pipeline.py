"""Corpus pipeline: five stages, each one operator of ``pactum.llm``.

Every stage works on all rows that its predecessor kept.  The first four
return the columns of ``documents``; the last returns the packed pieces.

A stage hands whole rows to Python, and its frame is run by whoever writes it:
it bounds the session's Arrow batches, and a stage that is called by itself
leaves that bound set.  ``run`` puts it back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import jaccard, line_rules, ordinal, packing, suffix_dedup
from pactum.llm.common import bound_batches, bounded_batches, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of being good is too low go."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "quality", "toxic")
    judged = ordinal.quality_classifier(docs, labels, carry=True)
    return judged.where("kept").select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail a base rule or lose too much go."""
    bound_batches(spark)
    judged = line_rules.quality_rules(docs, carry=True).where("kept")
    return with_text(judged, docs.columns, F.col("clean_text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once."""
    bound_batches(spark)
    return jaccard.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document that consists of nothing else goes."""
    bound_batches(spark)
    cut = suffix_dedup.cut_documents(docs)
    length = F.when(F.col(cut.columns[-1]) > 0, F.length("text")).otherwise(F.col("n_chars"))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, in pieces with their place in a sequence."""
    bound_batches(spark)
    return packing.pack(docs, with_ids=False)


def with_text(judged: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The original columns out of ``row``, with the new text and its length."""
    new = {"text": text, "n_chars": F.length(text)}
    kinds = dict(judged.select("row.*").dtypes)
    return judged.select(*[(new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c) for c in columns])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]


#: Rows that go to a Python worker at once; two copies of each text are held there and in the JVM's buffers.
BATCH_ROWS = 1_000
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """At most ``BATCH_ROWS`` rows in an Arrow batch, and bounded bytes, for what is run inside."""
    before = spark.conf.get(BATCH_KEY, None)
    own = int(before or 0)
    spark.conf.set(BATCH_KEY, str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    try:
        with bounded_batches(spark):
            yield
    finally:
        spark.conf.unset(BATCH_KEY) if before is None else spark.conf.set(BATCH_KEY, before)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    with small_batches(spark):
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = materialize(docs, f"pipeline-{name}")
    return docs


#: The classifier is a fitted model and token ids need the tokenizer: no SQL.
#: tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None
