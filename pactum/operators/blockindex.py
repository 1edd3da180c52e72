"""Search index in blocks of contracts (S9, J9): what a batch of searches reads.

Contracts are numbered blocks of ``2 ** BLOCK_BITS`` neighbouring ids.  Tables, each
a folder under one path:

* ``blocks``: one row per (token, block), each file sorted by token: the contracts' ids and
  lengths, the token's frequencies, its positions in title and body (sorted, and
  delta-coded by the file format), ``n`` contracts, and ``top``, the largest BM25
  weight (without the idf) that the token has in a contract of the block;
* ``offsets``: one row per (contract, column, ``TOKEN_BLOCK`` tokens): where each
  token begins and ends in the text;
* ``texts``: contract_id, title, full_text and the number of tokens of each column, in order
  of ids (the files also hold the tokens and their places, which the other tables are made of);
* ``stats``: one row, number of contracts and tokens.

The build shuffles the texts into the order of their ids and tokenises each once.
Token arrays are dealt by block, one row per contract; a contract's occurrences are
grouped inside its row, and its tokens into blocks inside the tasks, so no row per
occurrence is ever shuffled or sorted.  Each task writes its blocks as one file of
its own, sorted by token: a search reads a token's pages in each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions.text import raw_tokens, separators, tokens
from pactum.operators.flatten import bound, exclusive_sums
from pactum.schemas import BM25_B, BM25_K1

BLOCK_BITS = 6
#: Added to a position in the title while both columns are one array: below 0, and before the body.
IN_TITLE = -(1 << 30)
TOKEN_BLOCK = 128
#: Tokens grouped by one task, about.
TOKENS_PER_TASK = 2_000_000
#: Integers as deltas of their predecessors, bit-packed.
DELTA_CODED = {"parquet.writer.version": "v2"}


def weight(tf: Column, doc_len: Column, avgdl: float | Column) -> Column:
    """BM25 term weight without the idf."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * doc_len / avgdl))


def _begins(lens: Column, gaps: Column) -> Column:
    """Where each token begins, from the lengths of the tokens and of the text between them."""
    steps = F.zip_with(lens, F.slice(gaps, 2, F.size(lens)), lambda n, g: n + g)
    return F.zip_with(exclusive_sums(steps), F.array_repeat(F.element_at(gaps, 1), F.size(lens)), lambda s, g: s + g)


def tokenised(contracts: DataFrame) -> DataFrame:
    """Both columns' tokens and the places of the tokens; one pass over the texts."""
    texts = {"title": F.coalesce("title", F.lit("")), "body": F.coalesce("full_text", F.lit(""))}
    cut = contracts.select(F.col("contract_id").cast("bigint").alias("contract_id"), "title", "full_text",
                           *[tokens(c).alias(f"{n}_tokens") for n, c in texts.items()],
                           *[raw_tokens(c).alias(f"{n}_raw") for n, c in texts.items()],
                           *[separators(c).alias(f"{n}_gaps") for n, c in texts.items()])

    def sizes(c):
        return F.transform(c, lambda t: F.length(t).cast("bigint"))

    measured = cut.select("contract_id", "title", "full_text", "title_tokens", "body_tokens",
                          *[sizes(F.col(f"{n}_raw")).alias(f"{n}_size") for n in texts],
                          *[sizes(F.col(f"{n}_gaps")).alias(f"{n}_gaps") for n in texts])
    return measured.select("contract_id", "title", "full_text", "title_tokens", "body_tokens", "title_size", "body_size",
                           *[_begins(F.col(f"{n}_size"), F.col(f"{n}_gaps")).alias(f"{n}_begin") for n in texts])


def _entries(title: Column, body: Column) -> Column:
    """The distinct tokens of a contract, with their positions in both columns: (token, title, body)."""
    def occurrences(c, shift):
        return F.transform(c, lambda t, i: F.struct(t.alias("token"), (i + shift).alias("at")))

    def entry(token, at):
        own = F.get(at, F.lit(0)) < 0  # few tokens are in the title
        return F.struct(token.alias("token"),
                        F.when(own, F.transform(F.filter(at, lambda p: p < 0), lambda p: p - IN_TITLE))
                        .otherwise(F.array().cast("array<int>")).alias("title"),
                        F.when(own, F.filter(at, lambda p: p >= 0)).otherwise(at).alias("body"))

    def grouped(words, at):
        first = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return bound(first, lambda starts: F.transform(starts, lambda i, j: bound(
            F.slice(at, i + 1, F.coalesce(F.get(starts, j + 1), F.size(words)) - i), lambda run: entry(F.get(words, i), run))))

    found = F.sort_array(F.concat(occurrences(title, IN_TITLE), occurrences(body, 0)))
    return F.when(F.size(title) + F.size(body) > 0, bound(found, lambda s: bound(
        s["token"], lambda words: bound(s["at"], lambda at: grouped(words, at)))))


def _one_each(entries: Column) -> Column:
    """Entries of contracts, those with the same id and length put together (ids are hardly ever repeated)."""
    def merged(key):
        own = F.filter(entries, lambda x: x["contract_id"].eqNullSafe(key["contract_id"]) & (x["doc_len"] == key["doc_len"]))
        return F.struct(key["contract_id"].alias("contract_id"), key["doc_len"].alias("doc_len"), *[
            F.sort_array(F.flatten(F.transform(own, lambda x: x[c]))).alias(c) for c in ("title", "body")])
    keys = F.array_distinct(F.transform(entries, lambda x: F.struct(x["contract_id"].alias("contract_id"), x["doc_len"].alias("doc_len"))))
    ids = F.array_distinct(F.transform(entries, lambda x: x["contract_id"]))
    return F.when(F.size(ids) == F.size(entries), entries).otherwise(F.transform(keys, merged))


def build_block_index(contracts: DataFrame, path: str) -> None:
    """Write the index of ``contracts`` (contract_id, title, full_text) under ``path``."""
    spark = contracts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The texts are put in order before they are tokenised: one shuffle of the texts alone.
    tokenised(contracts.repartitionByRange(partitions, "contract_id").sortWithinPartitions("contract_id")).withColumns(
        {"n_title": F.size("title_tokens"), "n_body": F.size("body_tokens")}).write.parquet(f"{path}/texts")
    t = spark.read.parquet(f"{path}/texts")
    doc_len = (F.col("n_title") + F.col("n_body")).cast("bigint")
    t.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(doc_len).alias("n_tokens")).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    _, avgdl = _lengths(stats)

    columns = F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(f"{name}_begin").alias("begin"), F.col(f"{name}_size").alias("size"))
        for c, name in enumerate(("title", "body"))]))
    placed = t.select("contract_id", columns.alias("c")).where("size(c.begin) > 0")
    at = F.col("tblock") * TOKEN_BLOCK + 1
    (placed.select("contract_id", "c.*", F.explode(F.sequence(F.lit(0), F.floor((F.size("c.begin") - 1) / TOKEN_BLOCK).cast("int")))
                   .alias("tblock"))
     .select("contract_id", "col", "tblock", F.slice("begin", at, TOKEN_BLOCK).alias("begin"),
             F.slice("size", at, TOKEN_BLOCK).alias("size"))
     .sortWithinPartitions("contract_id", "col", "tblock")
     .write.options(**DELTA_CODED).parquet(f"{path}/offsets"))

    block = F.shiftright("contract_id", BLOCK_BITS)
    tasks = max(partitions, (stats.first()["n_tokens"] or 0) // TOKENS_PER_TASK)
    dealt = t.select(block.alias("block"), "contract_id", doc_len.alias("doc_len"), "title_tokens", "body_tokens").repartition(tasks, "block")
    found = dealt.select("block", "contract_id", "doc_len", F.explode(_entries(F.col("title_tokens"), F.col("body_tokens"))).alias("x"))
    rows = found.groupBy("block", F.col("x.token").alias("token")).agg(
        F.sort_array(F.collect_list(F.struct("contract_id", "doc_len", "x.title", "x.body"))).alias("e"))
    rows = rows.select("block", "token", _one_each(F.col("e")).alias("e"))
    tfs = F.transform("e", lambda x: F.size(x["title"]) + F.size(x["body"]))
    top = F.array_max(F.transform("e", lambda x: weight(F.size(x["title"]) + F.size(x["body"]), x["doc_len"], F.lit(avgdl))))
    (rows.select("token", "block", F.size("e").alias("n"), top.alias("top"), F.col("e.contract_id").alias("ids"),
                 F.col("e.doc_len").alias("lens"), tfs.alias("tfs"), F.col("e.title").alias("title"), F.col("e.body").alias("body"))
     .sortWithinPartitions("token", "block")
     .write.options(**DELTA_CODED).parquet(f"{path}/blocks"))


class BlockIndex:
    """A stored index, read."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("blocks", "offsets", "texts", "stats")}
        self.tables["texts"] = self.tables["texts"].select("contract_id", "title", "full_text", "n_title", "n_body")
        self.n_docs, self.avgdl = _lengths(self.tables["stats"])

    def table(self, name: str) -> DataFrame:
        return self.tables[name]


def _lengths(stats: DataFrame) -> tuple[int, float]:
    """Number of contracts and their mean length, from the one row of statistics."""
    row = stats.first()
    return row["n_docs"], (row["n_tokens"] or 0) / row["n_docs"] if row["n_docs"] else 0.0
