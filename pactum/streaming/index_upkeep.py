"""Index upkeep from a change feed with Structured Streaming.

The index is an append-only log of plain Parquet folders, one per micro-batch::

    <root>/<table>/run=<run>/batch=<batch>/part-*.parquet

``contracts`` holds the changes themselves (contract_id, version, op, title,
full_text), ``postings`` and ``doc_stats`` what their texts contain.  A
micro-batch writes only its own changed contracts: nothing that is stored is
read, moved or rewritten.  Readers keep, per contract, the rows of its newest
version (largest version, then run and batch) by one aggregate over three
narrow columns and a left semi join; a delete is a version without postings.

A folder is named by the run (the streaming checkpoint, numbered in the order in
which runs first came to this index) and the batch number in it, and written in
overwrite mode: a replayed batch replaces itself, and a new feed with a new
checkpoint never meets the folders of an old one.  Postings are written before the
changes that make them visible.

Changes have a total order: version, then run, batch, and within a batch the file
(time, path) and the row in it.  Of equal versions the later one is the newest.  A
change without a version or contract is refused: it goes to the ``rejects`` folder.

After any sequence of batches the index equals a full rebuild of the final
contract state.  ``compact`` writes that state as the build of a new root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.operators import textindex as ti
from pactum.operators.sizing import broadcast_if_small

CHANGE_SCHEMA = "contract_id BIGINT, version BIGINT, op STRING, title STRING, full_text STRING"
KEY = ["contract_id", "version", "run", "batch"]
SCHEMAS = {
    "contracts": CHANGE_SCHEMA,
    "postings": "contract_id BIGINT, version BIGINT, doc_len BIGINT, col INT, pos INT, token STRING",
    "doc_stats": "contract_id BIGINT, version BIGINT, doc_len BIGINT",
}
BUILD = "000000-build"
#: Columns that place a change in its feed, if the feed gives them.
PLACE = ["_time", "_file", "_row"]


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- reading ----------------------------------------------------------------
    def _log(self, table: str) -> DataFrame:
        """All rows ever written, with the run and batch of their folder."""
        return self.spark.read.schema(f"{SCHEMAS[table]}, run STRING, batch BIGINT").parquet(f"{self.root}/{table}")

    def newest(self) -> DataFrame:
        """(contract_id, version, run, batch, op): the newest change of each contract."""
        order = F.struct("version", "run", "batch")
        return (self._log("contracts").select(*KEY, "op").groupBy("contract_id")
                .agg(F.max_by(F.struct("version", "run", "batch", "op"), order).alias("r"))
                .select("contract_id", "r.*"))

    def read(self, table: str) -> DataFrame:
        """Rows of the live contracts; a filter on the result reaches the scan."""
        live = self.newest().where("op <> 'delete'").select(*KEY)
        return self._log(table).join(broadcast_if_small(live), KEY, "left_semi")

    def search_inputs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, doc_stats, contracts) of the live index for ``search``."""
        return (self.read("postings").select("contract_id", "col", "pos", "token"),
                self.read("doc_stats").select("contract_id", "doc_len"),
                self.read("contracts").select("contract_id", "title", "full_text"))

    # -- writing ----------------------------------------------------------------
    def _append(self, changes: DataFrame, run: str, batch: int, mode: str = "overwrite") -> None:
        """One row per contract -> the folders of this run and batch."""
        def folder(table: str) -> str:
            return f"{self.root}/{table}/run={run}/batch={batch}"

        texts = ti.tokenized_with(changes.where("op <> 'delete'").select("contract_id", "version", "title", "full_text"),
                                  "version")
        stored = f"{self.root}/_tokens/run={run}/batch={batch}"  # tokenised once for both tables
        texts.write.mode(mode).parquet(stored)
        texts = self.spark.read.schema(texts.schema).parquet(stored)
        posts = ti.postings_from_tokens(texts, with_doc_len=True, keep=["contract_id", "version"])
        # A frequent token is split by contract and position over several tasks.
        (posts.repartitionByRange("token", "contract_id", "pos").sortWithinPartitions("token", "contract_id", "pos")
         .write.mode(mode).parquet(folder("postings")))
        texts.select("contract_id", "version", (F.size("title_tokens") + F.size("body_tokens")).cast("bigint")
                     .alias("doc_len")).write.mode(mode).parquet(folder("doc_stats"))
        changes.select("contract_id", "version", "op", "title", "full_text").write.mode(mode).parquet(folder("contracts"))

    def build(self, contracts: DataFrame, version: int = 0) -> None:
        """Full build of a new root: every contract as an upsert at ``version``.
        A root that already has a build is refused."""
        self._append(contracts.select(F.col("contract_id").cast("bigint").alias("contract_id"),
                                      F.lit(version).cast("bigint").alias("version"), F.lit("upsert").alias("op"),
                                      "title", "full_text"), BUILD, 0, mode="error")

    def apply_changes(self, changes: DataFrame, batch_id: int, run: str) -> None:
        """One micro-batch: its newest change per contract, appended.  Running it
        again with the same ``run`` and ``batch_id`` replaces what it wrote."""
        refused = F.col("version").isNull() | F.col("contract_id").isNull()
        (changes.where(refused).select(*self.spark.createDataFrame([], CHANGE_SCHEMA).columns)
         .write.mode("overwrite").parquet(f"{self.root}/rejects/run={run}/batch={batch_id}"))
        order = F.struct("version", *[c for c in PLACE if c in changes.columns])
        newest = changes.where(~refused).groupBy("contract_id").agg(
            F.max_by(F.struct("version", "op", "title", "full_text"), order).alias("r"))
        self._append(newest.select("contract_id", "r.*"), run, batch_id)

    def compact(self, root: str) -> "IndexStore":
        """The live contracts, at their versions, as the build of a new root.
        (A deleted contract is forgotten, and with it the version of its delete.)"""
        new = IndexStore(self.spark, root)
        new._append(self.read("contracts").select("contract_id", "version", "op", "title", "full_text"), BUILD, 0,
                    mode="error")
        return new


def run_name(store: IndexStore, checkpoint: str) -> str:
    """The run that a checkpoint location stands for: its number, counted in the order in which
    runs first wrote to this index, and its hash.  A checkpoint that was seen keeps its number."""
    mark = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()
    path = store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.root}/runs")
    fs = path.getFileSystem(store.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    seen = sorted(f.getPath().getName() for f in fs.listStatus(path))  # one entry per feed
    for name in seen:
        if name.endswith(mark):
            return name
    name = f"{int(seen[-1].split('-')[0]) + 1 if seen else 1:06d}-{mark}"
    fs.mkdirs(store.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.root}/runs/{name}"))
    return name


def run_upkeep(spark: SparkSession, store: IndexStore, feed_dir: str, checkpoint: str,
               max_files_per_trigger: int | None = None) -> None:
    """Process every change file present in ``feed_dir`` (``availableNow``)
    and stop; the checkpoint makes a restart resume where it stopped."""
    run = run_name(store, checkpoint)
    reader = spark.readStream.schema(CHANGE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    changes = reader.parquet(feed_dir).select(
        "*", F.col("_metadata.file_modification_time").alias("_time"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias("_row"))
    q = (changes.writeStream.foreachBatch(lambda df, batch: store.apply_changes(df, batch, run))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
