"""URL filters: a blocked Bloom filter in front of an exact hash join.

The list of blocked canonical URLs becomes a table of 512-bit blocks: one row
per block, eight 64-bit words, one bit per word and key, built with
``bit_or``.  Every URL is looked up in its block; a URL whose eight bits are
not all set is surely not listed.  Only possible hits go to the exact join on
the canonical URL, which removes the false positives.  Host and path rules
override the list.  Everything is DataFrame code.

Defined results: a NULL URL or one without ``://`` has empty host and path,
fits no rule and is never listed; equal URLs get equal verdicts; an empty list
lists nothing; a NULL id is passed through.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BLOCK_BITS = 512
WORDS = 8
#: The filter is broadcast up to this many bytes (its size is computed from the
#: counted list); a larger one is joined on the block number.
BROADCAST_BYTES = 8 << 20
#: Rules of the registered query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Host labels that put a page on the registered query's list.
LISTED_HOST = r"(^|[.-])(ads|casino|spam|adult|pills|bets)([.-]|$)"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), string.ascii_uppercase, string.ascii_lowercase),
                      F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without query, fragment,
    ``.html`` and closing slashes; NULL without a host."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(/index)?(\.html)?/*$", "")))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, or NULLs."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        text = F.when(_fits(host, path, r), F.lit(r[1] + r[2])).otherwise(text)
        verdict = F.when(_fits(host, path, r), F.lit(r[0])).otherwise(verdict)
    return text, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("bigint")


def _mask(key: Column, i: int) -> Column:
    """Word ``i`` of a key: one bit, from six bits of a second hash."""
    bits = F.xxhash64(key, F.lit("bits"))
    return F.call_function("shiftleft", F.lit(1).cast("bigint"),
                           F.shiftright(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))


def bloom_blocks(listed: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the filter over ``listed``'s column ``key``."""
    cols = listed.select(_block(F.col(key), n_blocks).alias("block"),
                         *[_mask(F.col(key), i).alias(f"m{i}") for i in range(WORDS)])
    return cols.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) against ``rules`` and the
    canonical URLs in ``listed`` (canon).  Returns page_id, host, path, rule,
    verdict, listed, maybe_listed (what the Bloom filter alone says)."""
    keys = listed.select(F.col("canon").alias("key")).where(F.col("key").isNotNull()).distinct()
    n_blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    blocks = bloom_blocks(keys, "key", n_blocks)
    if n_blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    seen = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("canon", canonical(F.col("host"), F.col("path")))
    # xxhash64 of a NULL is a fixed value; by page instead, so that URLs without a canonical form don't share one task.
    probe = seen.withColumn("block", F.when(F.col("canon").isNotNull(), _block(F.col("canon"), n_blocks))
                            .otherwise(_block(F.col("page_id"), n_blocks)))
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_mask(F.col("canon"), i)) == _mask(F.col("canon"), i))
    maybe = probe.join(blocks, "block", "left").withColumn(
        "maybe_listed", F.coalesce(hit & F.col("canon").isNotNull(), F.lit(False)))
    cols = ["page_id", "host", "path", "canon", "maybe_listed"]
    exact = (maybe.where("maybe_listed").select(*cols)
             .join(keys, F.col("canon") == F.col("key"), "left")
             .withColumn("listed", F.col("key").isNotNull()))
    rest = maybe.where("NOT maybe_listed").select(*cols, F.lit(False).alias("listed"))
    judged = exact.select(*cols, "listed").unionByName(rest)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "listed", "maybe_listed")


def listed_urls(pages: DataFrame, host_pattern: str = LISTED_HOST) -> DataFrame:
    """(canon): canonical URLs of the pages on hosts that match ``host_pattern``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.where(host.rlike(host_pattern)).select(canonical(host, path).alias("canon")).distinct()
