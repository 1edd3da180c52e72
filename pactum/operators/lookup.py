"""Lookup by id (J4): a batch of requests answered by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_by_id(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """(request_id, contract_id, status, title, full_text) with status
    ``invalid_id`` (not a positive integer; no lookup), ``not_found`` or ``ok``."""
    valid = F.coalesce(F.col("contract_id") > 0, F.lit(False))
    none = F.lit(None).cast("string")
    invalid = requests.filter(~valid).select("request_id", "contract_id", F.lit("invalid_id").alias("status"),
                                             none.alias("title"), none.alias("full_text"))
    asked = requests.filter(valid).select("request_id", "contract_id")
    # Only contracts that somebody asks for go on, each once: a semi join on the
    # distinct ids (Spark broadcasts them when they are small) before the fan-out.
    wanted = asked.select("contract_id").distinct()
    found = contracts.select("contract_id", "title", "full_text", F.lit("ok").alias("status")).join(
        wanted, "contract_id", "left_semi")
    joined = asked.join(found, "contract_id", "left").select(
        "request_id", "contract_id", F.coalesce("status", F.lit("not_found")).alias("status"), "title", "full_text")
    return joined.unionByName(invalid)
