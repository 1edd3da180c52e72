"""Inverted index as tables (S9): postings and per-document statistics.

``postings(contract_id, col, pos, token)``: one row per token of the title
(col 0) and the full text (col 1).  Stored layout (``write_index``): parquet
partitioned by ``bucket = pmod(hash(contract_id), B)`` so the streaming
upkeep (T1) rewrites only the buckets it touches, and range-partitioned on
(bucket, token) and sorted by token inside each file, so a heavy bucket is
written by several tasks and parquet min/max statistics skip files and row
groups for a token filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions.text import tokens

INDEX_BUCKETS = 64


def tokenized(contracts: DataFrame) -> DataFrame:
    """(contract_id, title_tokens, body_tokens) from (contract_id, title, full_text)."""
    return contracts.select(
        "contract_id",
        tokens(F.col("title")).alias("title_tokens"),
        tokens(F.col("full_text")).alias("body_tokens"))


def tokenized_with(contracts: DataFrame, *keep: str) -> DataFrame:
    """``tokenized`` that also keeps some columns."""
    return contracts.select("contract_id", *keep, tokens(F.col("title")).alias("title_tokens"),
                            tokens(F.col("full_text")).alias("body_tokens"))


def materialize_tokens(contracts: DataFrame) -> DataFrame:
    """Tokenise once and store the token arrays in the shared scratch folder:
    postings, document lengths and corpus statistics are then read from it
    without running the regex again (the index build step)."""
    from pactum.session import scratch_path

    spark = contracts.sparkSession
    path = scratch_path(spark, "tokens")
    tokenized(contracts).write.mode("error").parquet(path)
    return spark.read.parquet(path)


def postings_from_tokens(t: DataFrame, with_doc_len: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Postings; ``with_doc_len`` also carries the document length on every
    row (it compresses to almost nothing in parquet, and spares every query a
    shuffle join with the doc-stats table)."""
    doc_len = (F.size("title_tokens") + F.size("body_tokens")).cast("bigint")
    keep = keep or ["contract_id"]
    cols = t.select(*keep, *([doc_len.alias("doc_len")] if with_doc_len else []), F.explode(F.array(
        F.struct(F.lit(0).alias("col"), F.col("title_tokens").alias("toks")),
        F.struct(F.lit(1).alias("col"), F.col("body_tokens").alias("toks")))).alias("c"))
    return cols.select(*keep, *(["doc_len"] if with_doc_len else []), F.col("c.col").alias("col"),
                       F.posexplode("c.toks").alias("pos", "token"))


def postings(contracts: DataFrame) -> DataFrame:
    return postings_from_tokens(tokenized(contracts))


def doc_stats_from_tokens(t: DataFrame) -> DataFrame:
    return t.select("contract_id",
                    (F.size("title_tokens") + F.size("body_tokens")).cast("bigint").alias("doc_len"))


def doc_stats(contracts: DataFrame) -> DataFrame:
    """(contract_id, doc_len): tokens of both columns, from the token arrays
    (no explode)."""
    t = tokenized(contracts)
    return t.select("contract_id",
                    (F.size("title_tokens") + F.size("body_tokens")).cast("bigint").alias("doc_len"))


def token_summary(contracts: DataFrame) -> DataFrame:
    """Per contract: token counts per column, distinct tokens and the first of the
    body (null if the body has none)."""
    t = tokenized(contracts)
    return t.select(
        F.col("contract_id").cast("bigint").alias("contract_id"),
        F.size("title_tokens").cast("bigint").alias("n_title_tokens"),
        F.size("body_tokens").cast("bigint").alias("n_body_tokens"),
        F.size(F.array_distinct(F.concat("title_tokens", "body_tokens"))).cast("bigint").alias("n_distinct_tokens"),
        F.try_element_at("body_tokens", F.lit(1)).alias("first_body_token"))


def write_index(contracts: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Write postings and doc stats in the layout described above."""
    bucket = F.pmod(F.hash("contract_id"), F.lit(buckets))
    (postings(contracts).withColumn("bucket", bucket)
     .repartitionByRange("bucket", "token", "contract_id", "pos").sortWithinPartitions("token", "contract_id", "pos")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
    (doc_stats(contracts).withColumn("bucket", bucket)
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/doc_stats"))


def write_search_index(contracts: DataFrame, path: str) -> None:
    """The index that searches read: postings with ``doc_len``, range-partitioned
    and sorted on (token, contract_id, pos), so that a token filter skips files
    and row groups and a frequent token is split over several files; doc stats."""
    tok = materialize_tokens(contracts)
    (postings_from_tokens(tok, with_doc_len=True).repartitionByRange("token", "contract_id", "pos")
     .sortWithinPartitions("token", "contract_id", "pos").write.parquet(f"{path}/postings"))
    doc_stats_from_tokens(tok).write.parquet(f"{path}/doc_stats")
