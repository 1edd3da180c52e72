"""Shared building blocks of the registered queries: driver tables -> engine inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import scenarios as scen_ops
from pactum.operators import tables as table_ops
from pactum.sources.adapters import nested_contracts
from pactum.sources.tables import table, text_table


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return nested_contracts(docs)


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts table; ids equal ``doc_id + 1`` because documents are dense
    from 0 and none is dropped by the adapter."""
    n = nested(spark, sf_dir)
    return table_ops.contracts_table(n, ids=False)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_ops.annotations_table(nested(spark, sf_dir))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scen_ops.scenarios(annotations(spark, sf_dir), contracts(spark, sf_dir))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scen_ops.split_scenarios(scenarios(spark, sf_dir))


def as_long(*names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def contracts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract_id, title, full_text) without the nested detour."""
    from pactum.sources.adapters import contracts_flat as cf
    docs = text_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return cf(docs)


# Search batch used by the registered search queries: the keyword lists of
# FIXTURES.md section 2, with varied result caps to exercise the clamp.
SEARCH_BATCH = [
    (1, ["the", "and"], 10),
    (2, ["in the"], 10),
    (3, ["MIT License"], 5),
    (4, ["under the", "license"], 10),
    (5, ["src3", "que"], 20),
    (6, ["", "THE."], 10),
    (7, ["the", "the", "of the"], 0),
    (8, ["en", "éé"], 10),
    (9, ["a a"], 3),
    (10, ["zzzz"], 10),
    (11, ["and in", "or", "as of"], -1),
]


def search_batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEARCH_BATCH, "query_id BIGINT, keywords ARRAY<STRING>, max_results INT")


def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read requests logged by agents: every click event asks for contract
    ``k`` (``1000000 + k`` when ``k % 25 = 24``)."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return ev.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("request_id"),
        F.when(F.pmod(k, F.lit(25)) == 24, k + 1000000).otherwise(k).alias("contract_id"))


def run_inputs(spark: SparkSession, sf_dir: str):
    """(turns, run scenarios, contract ids, judge replies) from the driver tables."""
    from pactum.sources import runlog
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    n_contracts = docs.count()
    turns = runlog.turns(events, n_contracts)
    titles = docs.select((F.col("doc_id") + 1).alias("contract_id"),
                         F.concat_ws(" ", "source", "lang", F.col("doc_id").cast("string")).alias("title"))
    scen = runlog.run_scenarios(events, titles, n_contracts)
    ids = titles.select("contract_id")
    return turns, scen, ids, runlog.judge_replies(turns)


def classified(spark: SparkSession, sf_dir: str):
    from pactum.operators import runs
    turns, scen, ids, replies = run_inputs(spark, sf_dir)
    return runs.classified_turns(turns, scen, ids, replies)


def rubric(spark: SparkSession, sf_dir: str):
    from pactum.operators.fold import fold_runs
    return fold_runs(*run_inputs(spark, sf_dir))
