"""The judge as tables (F11-F13, J10): requests out, verdicts in.

Only answered runs whose extracted and truth texts are both non-empty enter
the request table (F12); ``request_key = md5(user message)`` lets a verdict
cache be consulted with a ``left_anti`` join before asking again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions import prompts
from pactum.operators.runs import kept_turns, verdict_of


def judge_requests(classified: DataFrame, scenarios: DataFrame) -> DataFrame:
    asked = kept_turns(classified).filter(F.col("f_judged"))
    s = scenarios.select("scenario_id", "clause_type", F.col("ground_truth_clause_text").alias("truth"))
    j = asked.join(s, "scenario_id")
    user = prompts.judge_user_prompt(F.col("clause_type"), F.col("truth"), F.col("answer_text"))
    return j.select("trajectory_id", "turn", F.md5(user).alias("request_key"),
                    prompts.messages(F.lit(prompts.JUDGE_SYSTEM), user).alias("messages"))


def pending_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key has no cached verdict yet, each key once: equal
    requests are asked once and share the verdict."""
    return requests.dropDuplicates(["request_key"]).join(cache.select("request_key"), "request_key", "left_anti")


class VerdictCache:
    """Replies of the judge by ``request_key``, a Parquet folder per batch.
    A batch that is written again replaces itself; a key is asked in one batch only."""

    SCHEMA = "request_key string, reply string"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def replies(self) -> DataFrame:
        """(request_key, reply, batch) of all batches so far."""
        return self.spark.read.schema(f"{self.SCHEMA}, batch bigint").parquet(self.path)

    def pending(self, requests: DataFrame, batch: int) -> DataFrame:
        """The requests to ask in ``batch``: keys no earlier batch has, each once
        (of equal requests the one with the least run and turn)."""
        once = requests.groupBy("request_key").agg(F.min(F.struct("trajectory_id", "turn", "messages")).alias("r"))
        once = once.select("request_key", "r.*")
        if batch == 0:
            return once
        return once.join(self.replies().where(F.col("batch") < batch).select("request_key"), "request_key", "left_anti")

    def add(self, batch: int, replies: DataFrame) -> None:
        replies.select("request_key", "reply").write.mode("overwrite").parquet(f"{self.path}/batch={batch}")


def judge_verdicts(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """J10 + F11: verdict per request; a missing or unparsable reply is False."""
    r = replies.select("trajectory_id", "turn", "reply")
    return requests.join(r, ["trajectory_id", "turn"], "left").select(
        "trajectory_id", "turn", "request_key", "reply", verdict_of(F.col("reply")).alias("verdict"))
