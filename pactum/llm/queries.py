"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to the whole of its table.  ``ORACLE`` has DuckDB SQL
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.llm import (chat_events, digest, itq, jaccard, line_rules, ordinal, packing, periodic, records, suffix_dedup,
                        trie_counts, turn_repair, url_bloom, viterbi)
from pactum.llm.common import materialize


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """Column-pruned scan of one table, by Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet").select(*cols)


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = records.read_records(records.write_records(read(spark, sf_dir, "documents", "doc_id", "text")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents", "doc_id", "text"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(read(spark, sf_dir, "documents", "doc_id", "text")).drop("clean_text")


def op7_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = viterbi.decode(viterbi.encode(read(spark, sf_dir, "documents", "doc_id", "text")))
    return decoded.select("doc_id", "n_tokens", "ids_crc32",
                          (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), with_ids=False)


def op9_url_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    judged = url_bloom.filter_urls(pages, url_bloom.listed_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return ordinal.quality_classifier(docs, labels)


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage that the repair query fixes: by crc32 of ``conv_id:turn``, modulo 20, a row is dropped (0),
    emptied (1), loses its sentence ends (2), is there twice (3), or is said by the user (4)."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(said[0], F.lit(":"), said[1])), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    got = turn_repair.repair_conversations(damaged(conversations))
    line = F.concat("role", F.lit(":"), "text").alias("line")
    said = digest.ordered_digest(got.turns.select("conv_id", "at", "sub", line), "conv_id", ["at", "sub"], "line", "\n")
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    rows = ids.join(got.summary, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    rows = rows.join(said.select(F.col("conv_id").alias("d"), "sha256"), F.col("c").eqNullSafe(F.col("d")), "left")
    return rows.select(F.col("c").alias("conv_id"), *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in counts],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The texts of the run query: with h = crc32 of the decimal doc_id, a text with h % 10 = 0 repeats its words
    from word ``a`` on with period ``p``.  A NULL id has no digits and leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.when(F.pmod(h, F.lit(10)) == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    parts = docs.select("doc_id", "text", g.alias("g"), words.alias("w"))
    n = F.size("w")
    a = F.pmod("g", n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.pmod("g", F.lit(8))))).cast("int")
    parts = parts.where("w IS NOT NULL AND size(w) > 0").select("doc_id", "text", "w", a.alias("a"), p.alias("p"))
    tail = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("a") - 1),
                       lambda k: F.get("w", F.col("a") + k % F.col("p")))
    made = F.concat_ws(" ", F.slice("w", 1, F.col("a")), tail)
    rest = docs.where((F.coalesce(F.pmod(h, F.lit(10)), F.lit(1)) != 0) | F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return rest.select("doc_id", "text").unionAll(parts.select("doc_id", made.alias("text")))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic.periodic_runs(with_periodic_tails(docs))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("best"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def chat_log(conversations: DataFrame) -> DataFrame:
    """Logs for the chat query: each turn is opened and streamed; by a hash, some were drafted, thrown away and
    generated again, and some were streamed with a slip that an edit took out later."""
    told = conversations.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    extra = F.array([F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"),
                              F.lit(role).alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
                              F.lit(-1 - k).cast("bigint").alias("row")) for k, role in enumerate(("user", "assistant"))])
    told = told.unionByName(conversations.sparkSession.range(1).select(F.inline(extra)))
    half = F.floor(F.length("text") / 2).cast("int")
    slip, length = F.lit("[slip]"), F.length("text")
    first, second = F.expr("left(text, {0})".format("cast(length(text) / 2 as int)")), F.substring("text", half + 1, length)

    def event(kind, role=F.lit(None), content=F.lit(None), at=F.lit(None), n=F.lit(None)):
        return F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), content.cast("string").alias("content"),
                        at.cast("bigint").alias("at"), n.cast("bigint").alias("n"))

    way = F.pmod(F.xxhash64("conv_id", "turn", "row"), F.lit(4))
    opened = event("open", role=F.col("role"))
    events = (F.when(way == 0, F.array(opened, event("delta", content=first), event("regenerate"),
                                       event("delta", content=first), event("delta", content=second)))
              .when(way == 1, F.array(opened, event("delta", content=first), event("delta", content=slip),
                                      event("delta", content=second), event("edit", content=F.lit(""), at=F.length(first), n=F.length(slip))))
              .otherwise(F.array(opened, event("delta", content=first), event("delta", content=second))))
    logged = told.select("conv_id", "turn", "role", F.md5("text").alias("h"), "row", F.posexplode(events).alias("k", "e"))
    return logged.select("conv_id", F.struct("turn", F.col("role").alias("r"), "h", "row", "k").alias("seq"),
                         F.col("turn").alias("message"), "e.*")


def op13_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat_log(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return chat_events.transcript_digests(materialize(chat_events.format_chats(log), "chats"))


QUERIES = {f.__name__: f for f in (
    op1_itq, op2_jaccard, op3_trie_counts, op4_records, op5_suffix_dedup, op6_line_rules, op7_viterbi,
    op8_packing, op9_url_bloom, op10_ordinal, op11_turn_repair, op12_periodic, op13_chat_events)}

_W = r"[^\x20\x09-\x0D]+"

#: Smallest id reachable over ``links`` (a, b both ways) from each of ``ids`` (id).
_REACH = """reach(id, root) AS (
  SELECT id, id FROM ids UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    byte = ("list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), "
            "lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))")
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), "
            f"lambda z: CAST(ascii(z) AS BIGINT))), lambda c, b: {byte}), 4294967295)")


ORACLE = {
    "op1_itq": f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.id AS a, b.id AS b FROM good a JOIN good b ON a.id < b.id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
ids AS (SELECT id FROM v), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, component_id = id AS kept
FROM least LEFT JOIN n USING (id)""",
    "op2_jaccard": rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '{_W}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT id, hash(list_slice(w, i, i + 4)) AS s, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS t
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.t = b.t AND a.id < b.id
           GROUP BY a.id, b.id),
pairs AS (SELECT a, b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
ids AS (SELECT id FROM docs), {_REACH}
SELECT id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM least LEFT JOIN n USING (id)""",
    "op6_line_rules": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM docs),
scored AS (
  SELECT doc_id, l, k, len(regexp_extract_all(l, '{_W}')) AS w, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS c,
         row_number() OVER (PARTITION BY doc_id, l ORDER BY k) AS nth
  FROM lines),
tested AS (
  SELECT *, w > 0 AND (
    NOT (regexp_matches(l, '{line_rules.ENDED.replace("'", "''")}')
         OR regexp_matches(l, '{line_rules.SENTENCE.replace("'", "''")}'))
    OR 3 * len(regexp_extract_all(l, '{line_rules.SHOUT}')) > w
    OR 4 * len(regexp_extract_all(l, '{line_rules.SEPARATOR}')) > w
    OR 10 * length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > c
    OR regexp_matches(l, '{line_rules.BOILERPLATE}')) AS fails
  FROM scored),
by_line AS (
  SELECT doc_id, sum(w) AS n_words, sum(c) AS word_chars, count(*) FILTER (w > 0 AND nth > 1) AS n_dup_lines,
         count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(c) FILTER (fails), 0) AS removed_chars
  FROM tested GROUP BY doc_id),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '{_W}')) AS w,
         generate_subscripts(regexp_extract_all(t, '{_W}'), 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
  SELECT doc_id, i, CASE WHEN w2 IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, w, w1, w2) END AS n FROM windows),
covered AS (
  SELECT doc_id, max(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS r FROM counted),
repeated AS (SELECT doc_id, count(*) FILTER (r) AS n_repeat_words FROM covered GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(b.n_words AS BIGINT) AS n_words, CAST(b.word_chars AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(b.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(b.n_lines_removed AS BIGINT) AS n_lines_removed, CAST(b.removed_chars AS BIGINT) AS removed_chars
  FROM docs d JOIN by_line b USING (doc_id) LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PCT} * n_words AS base_failed,
       NOT (n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > {line_rules.MAX_REPEAT_PCT} * n_words)
         AND 100 * removed_chars <= {line_rules.MAX_REMOVED_PCT} * word_chars AS kept,
       n_lines_removed, removed_chars
FROM base""",
    "op9_url_bloom": rf"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
p AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '')
        || regexp_replace(path, '(/index)?(\.html)?/*$', '') END AS canon FROM p),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{url_bloom.LISTED_HOST}')),
rules(verdict, h, p) AS (VALUES {", ".join(f"('{v}', '{h}', '{q}')" for v, h, q in url_bloom.RULES)}),
fits AS (
  SELECT c.page_id, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.verdict, length(r.h || r.p)) AS verdict
  FROM c JOIN rules r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p)
  GROUP BY c.page_id)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       l.canon IS NOT NULL AS listed
FROM c LEFT JOIN fits f USING (page_id) LEFT JOIN listed l ON c.canon = l.canon""",
    "op11_turn_repair": rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM given),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM hurt),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen, left(role, 1) AS initial,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_char, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prior
  FROM numbered),
faults AS (
  SELECT *, last_char = '' AS blank, last_char <> '' AND seen AS duplicate,
         last_char <> '' AND NOT seen AND last_char NOT IN ('.', '!', '?') AS truncated FROM flagged),
counts AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (i > 1 AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faults GROUP BY c),
steps(a, initial, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
added(a, b, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'),
  (2, 3, 2, 'I'), (3, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')),
choices AS (
  SELECT c, i, k.a, k.b, 3 AS cost, 'D' AS letter FROM faults, (SELECT DISTINCT a, a AS b FROM added) k
  UNION ALL SELECT c, i, a, b, CAST(truncated AS INT), 'K' FROM faults JOIN steps USING (initial) WHERE NOT blank AND NOT duplicate
  UNION ALL SELECT c, i, a, b, 2 + CAST(truncated AS INT), 'R' FROM faults JOIN steps ON steps.initial IN ('u', 'a')
            WHERE NOT blank AND NOT duplicate),
best(c, i, state, v) AS (
  SELECT c, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': ''}} FROM counts
  UNION ALL
  SELECT x.c, x.i + 1, o.b, min({{'cost': CAST(x.v.cost + d.cost + o.cost AS INT), 'audit': x.v.audit || d.letters || o.letter}})
  FROM best x JOIN added d ON d.a = x.state JOIN choices o ON o.c = x.c AND o.i = x.i + 1 AND o.a = d.b GROUP BY x.c, x.i, o.b),
ended AS (
  SELECT x.c, min({{'cost': CAST(x.v.cost + d.cost AS INT), 'audit': x.v.audit || d.letters}}) AS v
  FROM best x JOIN counts USING (c) JOIN added d ON d.a = x.state AND d.b IN (0, 3) WHERE x.i = n GROUP BY x.c),
letters AS (
  SELECT c, generate_subscripts(string_split(v.audit, ''), 1) AS k, unnest(string_split(v.audit, '')) AS letter FROM ended WHERE v.audit <> ''),
placed AS (
  SELECT *, sum(CAST(letter <> 'I' AS INT)) OVER w AS i, sum(CAST(letter <> 'D' AS INT)) OVER w AS said FROM letters
  WINDOW w AS (PARTITION BY c ORDER BY k)),
led AS (SELECT p.c FROM placed p JOIN faults f USING (c, i) WHERE p.letter = 'K' AND p.said = 1 AND f.initial = 's'),
lines AS (
  SELECT p.c, k, CASE WHEN letter = 'K' THEN f.role WHEN (said - CAST(led.c IS NOT NULL AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
  FROM placed p LEFT JOIN faults f ON f.c = p.c AND f.i = p.i LEFT JOIN led ON led.c = p.c WHERE letter <> 'D'),
repaired AS (SELECT c, string_agg(line, chr(10) ORDER BY k) AS whole FROM lines GROUP BY c)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(v.cost, 0) AS BIGINT) AS cost,
       coalesce(v.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended USING (c) LEFT JOIN repaired USING (c)""",
    "op12_periodic": rf"""
WITH given AS (
  SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
placed AS (SELECT *, h // 10 AS g, len(w) AS n FROM given),
sized AS (SELECT *, g % greatest(n, 1) AS a FROM placed),
made AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
           w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM sized),
windows AS (
  SELECT doc_id, i, hash(list_slice(w, i + 1, i + 5)) AS k, list_slice(w, i + 1, i + 5) AS five
  FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM made WHERE n > 5)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island, x.i
  FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.k = y.k AND x.five = y.five AND x.i < y.i),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 4 + q AS len FROM same GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, s, len, min(q) AS q FROM stretches WHERE len >= greatest(6, 4 * q) GROUP BY doc_id, s, len),
summary AS (
  SELECT doc_id, count(*) AS n_runs, max({{'len': len, 's': -s, 'q': -q}}) AS best,
         string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM runs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM made WHERE doc_id IN (SELECT doc_id FROM runs)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS whole FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.len AS length, -best.q AS period,
       1000 * best.len // -best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(coalesce(whole, array_to_string(w, ' '))) AS collapsed_sha256
FROM made LEFT JOIN summary USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_chat_events": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
written AS (
  SELECT *, '<turn ' || regexp_replace(role, '([\\<>\n])', '\\\1', 'g') || '>' || chr(10)
            || regexp_replace(replace(text, '\', '\\'), '(</?turn)', '\\\1', 'g') || '</turn>' || chr(10) AS formatted FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id""",
}
