"""Batches of ranked phrase searches over the block index (2.10: F1-F5, J3, J9, A8, W6, L1).

The semantics are those of ``pactum.operators.search``; the plan is another.

1. Phrases of several words become terms like words: their blocks' rows meet (one row
   per word and block), and their positions are intersected as sorted arrays inside
   the row.
2. A term's idf and, per block, its largest weight give an upper bound of every score in
   a block, from narrow columns alone.  Per list of keywords, the blocks with the highest
   bounds are scored first; the tenth score found is a threshold, and blocks whose bound
   lies below it are never scored.
3. Scoring joins whole blocks: one row per keyword and block is shuffled, never one per
   contract or occurrence.
4. A snippet takes the positions of its contract's row, looks up the stored places of the
   window's tokens, and cuts its pieces out of one substring of the text; nothing is
   tokenised at query time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.operators.blockindex import BLOCK_BITS, TOKEN_BLOCK, BlockIndex, weight
from pactum.operators.search import SCORE_PLACES, keyword_lists, query_tokens, stable_double
from pactum.schemas import (BM25_IDF_FLOOR, MAX_SEARCH_RESULTS, SNIPPET_CLOSE, SNIPPET_ELLIPSIS, SNIPPET_OPEN,
                            SNIPPET_TOKENS)
from pactum.session import scratch_path

#: Blocks of each list scored before there is a threshold.
FIRST_BLOCKS = 4
#: Values of a batch written into a scan's filter, at most; beyond it the join alone filters.
PUSHED_VALUES = 10_000
#: A bound is a sum of the same products as a score, perhaps in another order.
MARGIN = 1e-9


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pushed(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """``df`` with a literal filter on a batch's few values, so that sorted files are skipped; it only saves reads."""
    few = [r[0] for r in values.select(column).distinct().limit(PUSHED_VALUES + 1).collect()]
    return df.where(F.col(column).isin(few)) if len(few) <= PUSHED_VALUES else df


def _at(values: Column, ids: Column, x: Column) -> Column:
    """The element of ``values`` at the place of ``x`` in ``ids``."""
    return F.element_at(values, F.array_position(ids, x).cast("int"))


def _common(parts: Column) -> Column:
    """Ids that all parts hold."""
    return F.aggregate(F.slice(parts, 2, F.size(parts)), F.element_at(parts, 1)["ids"], lambda acc, p: F.array_intersect(acc, p["ids"]))


def _starts(parts: Column, column: str) -> Column:
    """Where a phrase starts: the words' positions less their places, intersected.  ``parts`` of one contract."""
    shifted = F.transform(parts, lambda p: F.transform(p[column], lambda x: x - p["tok_idx"]))
    return F.aggregate(F.slice(shifted, 2, F.size(shifted)), F.element_at(shifted, 1), lambda acc, s: F.array_intersect(acc, s))


def phrase_blocks(index: BlockIndex, words: DataFrame) -> DataFrame:
    """Rows like the index's for phrases.  ``words``: (term, n_tok, tok_idx, token) of each distinct phrase."""
    blocks = _pushed(index.table("blocks").select("token", "block", "ids", "lens", "title", "body"), "token", words)
    met = blocks.join(words, "token").groupBy("term", "n_tok", "block").agg(
        F.sort_array(F.collect_list(F.struct("tok_idx", "ids", "lens", "title", "body"))).alias("parts")) \
        .where(F.size("parts") == F.col("n_tok"))

    def entry(i):
        own = F.transform("parts", lambda p: F.struct(
            p["tok_idx"].alias("tok_idx"), _at(p["title"], p["ids"], i).alias("title"), _at(p["body"], p["ids"], i).alias("body")))
        first = F.element_at("parts", 1)
        return F.struct(i.alias("id"), _at(first["lens"], first["ids"], i).alias("len"),
                        (F.size(_starts(own, "title")) + F.size(_starts(own, "body"))).alias("tf"))

    rows = met.select("term", "block", F.filter(F.transform(_common(F.col("parts")), entry), lambda x: x["tf"] > 0).alias("e"))
    top = F.array_max(F.transform("e", lambda x: weight(x["tf"], x["len"], F.lit(index.avgdl))))
    return rows.where(F.size("e") > 0).select("term", "block", F.size("e").alias("n"), top.alias("top"), F.col("e.id").alias("ids"),
                                              F.col("e.len").alias("lens"), F.col("e.tf").alias("tfs"))


class Ranking:
    """``top``: (list_key, rank, contract_id, score); ``blocks``: (list_key, block, bound, scored) of each candidate block."""

    def __init__(self, top: DataFrame, blocks: DataFrame):
        self.top, self.blocks = top, blocks


def rank_lists(index: BlockIndex, lists: DataFrame) -> Ranking:
    """The best ten contracts of every list of keywords (query_id, keywords), ties by id."""
    toks = query_tokens(lists).withColumnRenamed("query_id", "list_key")
    keywords = toks.groupBy("list_key", "kw_idx", "n_tok").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "token"))), lambda x: x["token"]), " ").alias("term"))
    keywords = stored(keywords, "search-keywords")  # small stored tables: Spark knows their sizes and broadcasts below its limit
    words = keywords.where("n_tok > 1").select("term", "n_tok").distinct().select(
        "term", "n_tok", F.posexplode(F.split("term", " ")).alias("tok_idx", "token"))
    single = keywords.where("n_tok = 1").select(F.col("term").alias("token")).distinct()
    own = _pushed(index.table("blocks"), "token", single).select(
        F.col("token").alias("term"), "block", "n", "top", "ids", "lens", "tfs")
    # Read once: the batch's rows serve frequencies, bounds and both scorings.
    terms = stored(own.join(single.withColumnRenamed("token", "term"), "term", "left_semi"), "search-own")
    if words.limit(1).count():
        terms = terms.unionByName(stored(phrase_blocks(index, words), "search-phrases"))

    df = terms.groupBy("term").agg(F.sum("n").alias("df"))  # at most one row per term of the batch
    raw = F.log((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(BM25_IDF_FLOOR)).otherwise(raw)
    n_kw = keywords.groupBy("list_key").agg(F.count(F.lit(1)).alias("n_kw"))
    asked = stored(keywords.join(n_kw, "list_key").join(df, "term").select("list_key", "kw_idx", "term", "n_kw", idf.alias("idf")),
                    "search-terms")
    bounds = terms.select("term", "block", "top").join(asked, "term").groupBy("list_key", "n_kw", "block").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("idf") * F.col("top")).alias("bound")).where("m = n_kw")
    best = Window.partitionBy("list_key").orderBy(F.col("bound").desc(), "block")
    candidates = stored(bounds.select("list_key", "block", "bound"), "search-candidates")
    first = candidates.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST_BLOCKS).drop("place")
    scored_first = stored(_score(index, terms, asked, first), "search-first")
    by_score = Window.partitionBy("list_key").orderBy("score", "contract_id")
    tenth = scored_first.withColumn("place", F.row_number().over(by_score)).where(F.col("place") == MAX_SEARCH_RESULTS) \
        .select("list_key", (-F.col("score")).alias("least"))
    rest = candidates.join(first.select("list_key", "block"), ["list_key", "block"], "left_anti") \
        .join(tenth, "list_key", "left") \
        .where(F.col("least").isNull() | (F.col("bound") * (1 + MARGIN) + 2 * 10 ** -SCORE_PLACES >= F.col("least"))) \
        .select("list_key", "block", "bound")
    scored = scored_first.unionByName(_score(index, terms, asked, rest))
    top = scored.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= MAX_SEARCH_RESULTS)
    done = first.select("list_key", "block").unionByName(rest.select("list_key", "block")).withColumn("scored", F.lit(True))
    report = candidates.join(done, ["list_key", "block"], "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    return Ranking(stored(top, "search-top"), report)


def _score(index: BlockIndex, terms: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(list_key, contract_id, score) of the contracts of some blocks that hold all keywords."""
    wanted = blocks.select("list_key", "block")
    rows = terms.select("term", "block", "ids", "lens", "tfs").join(asked, "term").join(wanted, ["list_key", "block"]) \
        .groupBy("list_key", "n_kw", "block").agg(F.sort_array(F.collect_list(F.struct("kw_idx", "idf", "ids", "lens", "tfs"))).alias("parts")) \
        .where(F.size("parts") == F.col("n_kw"))

    def scored(i):
        total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["idf"] * weight(
            _at(p["tfs"], p["ids"], i), _at(p["lens"], p["ids"], i), F.lit(index.avgdl)))
        return F.struct(i.alias("contract_id"), (-total).alias("score"))

    return rows.select("list_key", F.inline(F.transform(_common(F.col("parts")), scored))) \
        .withColumn("score", stable_double(F.col("score"), SCORE_PLACES))


def _windows(spans: Column) -> Column:
    """The best window of sorted occurrences (col, start, stop, kw): most keywords, then most occurrences
    that start in it, then the earliest."""
    def rated(o, i):
        # A window holds SNIPPET_TOKENS starts for each keyword at most.
        near = F.filter(F.slice(spans, i + 1, SNIPPET_TOKENS * F.col("n_kw")),
                        lambda x: (x["col"] == o["col"]) & (x["start"] - o["start"] < SNIPPET_TOKENS))
        return F.struct((-F.size(F.array_distinct(F.transform(near, lambda x: x["kw"])))).alias("a"), (-F.size(near)).alias("b"),
                        o["col"].alias("col"), o["start"].alias("start"))
    return F.array_min(F.transform(spans, rated))


def snippets(index: BlockIndex, top: DataFrame, lists: DataFrame) -> DataFrame:
    """(list_key, contract_id, title, snippet_col, snippet) of the ranked contracts of each list."""
    toks = query_tokens(lists).withColumnRenamed("query_id", "list_key")
    hits = top.select("list_key", "contract_id", F.shiftright("contract_id", BLOCK_BITS).alias("block"))
    need = hits.join(toks, "list_key")
    blocks = _pushed(_pushed(index.table("blocks").select("token", "block", "ids", "title", "body"), "token", toks), "block", hits)
    found = blocks.join(need, ["token", "block"]).where(F.array_contains("ids", F.col("contract_id")))
    own = found.select("list_key", "contract_id", "kw_idx", "tok_idx", "n_tok",
                       *[_at(F.col(c), F.col("ids"), F.col("contract_id")).alias(c) for c in ("title", "body")])
    phrases = own.groupBy("list_key", "contract_id", "kw_idx", "n_tok").agg(
        F.sort_array(F.collect_list(F.struct("tok_idx", "title", "body"))).alias("parts"))

    def spans(c, column):
        return F.transform(_starts(F.col("parts"), column), lambda s: F.struct(
            F.lit(c).alias("col"), s.cast("bigint").alias("start"), (s + F.col("n_tok") - 1).cast("bigint").alias("stop"),
            F.col("kw_idx").alias("kw")))
    per_hit = phrases.select("list_key", "contract_id", F.concat(spans(0, "title"), spans(1, "body")).alias("s")) \
        .groupBy("list_key", "contract_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"), F.count(F.lit(1)).alias("n_kw"))
    best = per_hit.withColumn("best", _windows(F.col("spans"))).select(
        "list_key", "contract_id", F.col("best.col").alias("col"), F.col("best.start").alias("w0"),
        F.filter("spans", lambda x: (x["col"] == F.col("best.col")) & (x["stop"] >= F.col("best.start") - SNIPPET_TOKENS)
                 & (x["start"] < F.col("best.start") + SNIPPET_TOKENS)).alias("spans"))
    best = stored(best, "search-windows")
    texts = _pushed(index.table("texts"), "contract_id", top).join(best, "contract_id")
    n = F.when(F.col("col") == 0, F.col("n_title")).otherwise(F.col("n_body"))
    texts = texts.withColumn("n", n).withColumn("a", F.greatest(F.lit(0), F.least("w0", F.col("n") - SNIPPET_TOKENS)))
    texts = texts.withColumn("z", F.least(F.col("n") - 1, F.col("a") + SNIPPET_TOKENS - 1))
    texts = texts.select("list_key", "contract_id", "title", "col", "spans", "n", "a", "z",
                         F.when(F.col("col") == 0, F.col("title")).otherwise(F.col("full_text")).alias("text"))
    texts = texts.select("*", F.explode(F.sequence(F.floor(F.col("a") / TOKEN_BLOCK).cast("int"), F.floor(F.col("z") / TOKEN_BLOCK).cast("int")))
                         .alias("tblock"))
    offsets = _pushed(index.table("offsets"), "contract_id", top)
    placed = offsets.join(texts, ["contract_id", "col", "tblock"])
    whole = placed.groupBy("list_key", "contract_id", "col", "n", "a", "z").agg(
        F.first("title").alias("title"), F.first("text").alias("text"), F.first("spans").alias("spans"),
        F.sort_array(F.collect_list(F.struct("tblock", "begin", "size"))).alias("o"))
    skip = (F.col("a") - F.col("o")[0]["tblock"] * TOKEN_BLOCK + 1).cast("int")
    count = (F.col("z") - F.col("a") + 1).cast("int")
    whole = whole.withColumns({"begin": F.slice(F.flatten("o.begin"), skip, count), "size": F.slice(F.flatten("o.size"), skip, count)})
    return whole.select("list_key", "contract_id", "title", F.col("col").cast("bigint").alias("snippet_col"), _marked().alias("snippet"))


def _marked() -> Column:
    """The window's substring, cut at its tokens, with covered tokens marked."""
    def covered(i):
        return F.exists("spans", lambda s: (s["start"] <= i) & (s["stop"] >= i))

    def joined(i, j):
        return F.exists("spans", lambda s: (s["start"] <= i) & (s["stop"] >= j))

    from_char = F.when(F.col("a") > 0, F.element_at("begin", 1)).otherwise(0)
    to_char = F.when(F.col("z") < F.col("n") - 1, F.element_at("begin", -1) + F.element_at("size", -1)).otherwise(F.length("text"))
    part = F.substring(F.col("text"), (from_char + 1).cast("int"), (to_char - from_char).cast("int"))

    def cut(x, y):
        return F.substring(part, (x - from_char + 1).cast("int"), (y - x).cast("int"))

    def piece(k):
        i = F.col("a") + k
        begin, end = F.get("begin", k), F.get("begin", k) + F.get("size", k)
        return F.concat(
            F.when(covered(i) & ((k == 0) | ~joined(i - 1, i)), F.lit(SNIPPET_OPEN)).otherwise(F.lit("")), cut(begin, end),
            F.when(covered(i) & ((i == F.col("z")) | ~joined(i, i + 1)), F.lit(SNIPPET_CLOSE)).otherwise(F.lit("")),
            F.when(i < F.col("z"), cut(end, F.get("begin", k + 1))).otherwise(F.lit("")))

    count = (F.col("z") - F.col("a")).cast("int")
    head = F.when(F.col("a") > 0, F.lit(SNIPPET_ELLIPSIS)).otherwise(cut(F.lit(0), F.element_at("begin", 1)))
    tail = F.when(F.col("z") < F.col("n") - 1, F.lit(SNIPPET_ELLIPSIS)).otherwise(
        cut(F.element_at("begin", -1) + F.element_at("size", -1), F.length("text")))
    return F.concat(head, F.array_join(F.transform(F.sequence(F.lit(0), count), piece), ""), tail)


def _fan_out(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of each list (stored, so that a few are broadcast) to every query that asked it, each with its own
    cap: the queries are not shuffled, however many ask the same list."""
    return hits.join(queries, "list_key").where(F.col("rank") <= F.col("_k"))


def search(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """(query_id, rank, contract_id, title, score) of queries (query_id, keywords, max_results)."""
    lists, q = keyword_lists(queries)
    ranking = rank_lists(index, lists)
    titles = _pushed(index.table("texts").select("contract_id", "title"), "contract_id", ranking.top)
    hits = stored(ranking.top.join(titles, "contract_id"), "search-hits")
    return _fan_out(hits, q).select("query_id", F.col("rank").cast("bigint").alias("rank"), "contract_id", "title", "score")


def search_with_snippets(index: BlockIndex, queries: DataFrame) -> DataFrame:
    """``search`` with snippet_col and snippet."""
    lists, q = keyword_lists(queries)
    ranking = rank_lists(index, lists)
    shown = snippets(index, ranking.top, lists)
    hits = stored(ranking.top.join(shown, ["list_key", "contract_id"]), "search-hits")
    return _fan_out(hits, q).select("query_id", F.col("rank").cast("bigint").alias("rank"), "contract_id", "title", "score",
                                    "snippet_col", "snippet")
