"""One JSON envelope read by many tasks: a structural index over file splits.

``{"version": .., "data": [contract, ..]}`` is one JSON document however large the
file is, and often one line.  Spark's text reader does split it when rows end at
``}`` instead of at a line feed.  Such a fragment can be placed without reading
what comes before it, but for two numbers: is it inside a string, and how deep?

1. Marks: of each fragment the parity of its quotes, and its brackets outside
   strings if it began outside a string, or inside one.
2. Index: per split the parity and, for both possible beginnings, the change of
   depth; sums over the splits of a file, in order, give the state at the start
   of each split.  The index has one row per split and is stored.
3. Pieces: with the state known, fragments between two contract ends (a ``}``
   that leads back to the list's depth) are put together inside their split and
   stored.  Only a piece that crosses the edge of a split, at most two a split,
   is put together with its neighbours.
4. A piece, which is one contract but for odd lists, is parsed as JSON, once.
   Its number is the number of elements before its split plus its place within.

Texts cross one shuffle, dealt by split, whatever the size of a file.  No row is
larger than a contract.  Files of one split need none of this: a task reads each
as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.operators.sizing import broadcast_if_small
from pactum.session import scratch_path
from pactum.sources.tables import spread

SPLIT_SIZE = "spark.sql.files.maxPartitionBytes"
#: Splits are packed into about so many tasks.
TASKS = "spark.sql.files.maxPartitionNum"
#: The key of the list, as a JSON string token followed by its value's bracket.
DATA_KEY = r'(?<!\\)"data"\s*:\s*\['
#: Depth inside the envelope's object, and inside the list of contracts.
ENVELOPE, LIST = 1, 2


def fragments(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(file, split, mid, v): the text of the files above ``limit`` bytes, cut behind each ``}`` (which is not part of ``v``).
    ``mid`` orders the fragments of a split; a fragment belongs to the split it begins in."""
    return spark.read.option("lineSep", "}").text(path).where(F.col("_metadata.file_size") > limit).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("v"))


def _skeleton(text: Column) -> Column:
    """Quotes and brackets only; escaped characters don't count."""
    return F.regexp_replace(text, r'(?s)[^"\[\]{}\\]+|\\.', "")


def _outside(skeleton: Column, inside: int = 0) -> Column:
    """The brackets outside strings, if the text begins outside a string, or ``inside`` one."""
    return F.regexp_replace(F.concat(F.lit('"'), skeleton) if inside else skeleton, '"[^"]*(?:"|$)', "")


def _net(brackets: Column) -> Column:
    """Opening minus closing brackets."""
    return F.length(F.translate(brackets, "}]", "")) - F.length(F.translate(brackets, "{[", ""))


def _lowest(brackets: Column, depth: Column) -> Column:
    """The least depth on the way through the brackets."""
    steps = F.filter(F.split(brackets, ""), lambda b: b != "")
    return F.aggregate(
        steps, F.struct(depth.cast("int").alias("now"), depth.cast("int").alias("low")),
        lambda acc, b: F.struct(
            (acc["now"] + F.when(b.isin("{", "["), 1).otherwise(-1)).alias("now"),
            F.least(acc["low"], acc["now"] + F.when(b.isin("{", "["), 1).otherwise(-1)).alias("low")),
        lambda acc: acc["low"])


def _sum_before(c: Column | str, window=None) -> Column:
    """Sum over the rows before this one, in its split if no window is given."""
    window = window or Window.partitionBy("file", "split").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def marked(frags: DataFrame) -> DataFrame:
    """Marks of each fragment (as they are, if it has them); ``p``: parity of the quotes before it in its split."""
    if "p" in frags.columns:
        return frags
    bones = frags.withColumns({"bones": _skeleton(F.col("v")), "blank": ~F.col("v").rlike(r"\S")})
    quotes = F.length("bones") - F.length(F.translate("bones", '"', ""))
    marks = bones.withColumns({"b0": _outside(F.col("bones")), "b1": _outside(F.col("bones"), 1), "odd": quotes % 2 == 1}).drop("bones")
    return marks.withColumn("p", _sum_before(F.col("odd").cast("int")) % 2)


def split_index(frags: DataFrame) -> DataFrame:
    """(file, split, inside, depth): the state at the start of each split, one row per split.
    Fails on a file whose quotes or brackets don't close, or with text behind its end."""
    m = marked(frags)

    def change(inside: int) -> Column:
        begins = (F.col("p") + inside) % 2
        brackets = F.when(begins == 0, F.col("b0")).otherwise(F.col("b1"))
        return _net(brackets) - F.when((begins + F.col("odd").cast("int")) % 2 == 0, 1).otherwise(0)

    totals = m.select("file", "split", "mid", "odd", change(0).alias("d0"), change(1).alias("d1"), "blank") \
        .groupBy("file", "split").agg((F.sum(F.col("odd").cast("int")) % 2).alias("odd"), F.sum("d0").alias("d0"),
                                      F.sum("d1").alias("d1"), F.max_by("blank", "mid").alias("blank"))
    # One row per split: the splits of one file are few (its size by the split size).
    by_file = Window.partitionBy("file").orderBy("split")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    states = totals.withColumn("inside", (_sum_before("odd", before) % 2).cast("int"))
    states = states.withColumn("d", F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1")))
    states = states.withColumns({"depth": _sum_before("d", before), "last": F.lead("split").over(by_file).isNull()})
    end = F.col("depth") + F.col("d")
    # Behind the last bracket there may be white space; it counts as a fragment, so as one bracket too many.
    closed = ((F.col("inside") + F.col("odd")) % 2 == 0) & ((end == 0) | ((end == -1) & F.col("blank")))
    depth = F.when(F.col("last") & ~closed, F.raise_error(F.concat(F.lit("broken JSON: "), "file"))).otherwise(F.col("depth"))
    return states.select("file", "split", "inside", depth.cast("int").alias("depth"))


def pieces(frags: DataFrame, index: DataFrame) -> DataFrame:
    """(file, split, k, text, begins, ends, closed): text between two ends of contracts, within splits.
    ``begins``: the list opens here; ``ends``: the envelope is reached; ``closed``: the piece ends in its split."""
    placed = marked(frags.join(broadcast_if_small(index), ["file", "split"]))
    s = (F.col("p") + F.col("inside")) % 2
    brackets = F.when(s == 0, F.col("b0")).otherwise(F.col("b1"))
    shut = (s + F.col("odd").cast("int")) % 2 == 0
    placed = placed.withColumn("b", F.concat(brackets, F.when(shut, F.lit("}")).otherwise(F.lit("")))).withColumn("s", s)
    placed = placed.withColumn("d", (F.col("depth") + _sum_before(_net(F.col("b")))).cast("int"))
    after = F.col("d") + _net(F.col("b"))
    # The list opens in a fragment that reaches the envelope; before its key it opens no object, since the
    # object's end would end the fragment.
    closers = F.length("b") - F.length(F.translate("b", "}]", ""))
    key_at = F.when(F.col("d") - closers <= ENVELOPE, F.expr(f"regexp_instr(v, r'{DATA_KEY}')")).otherwise(0)
    head = F.substring("v", F.lit(1), F.col("key_at") - 1)
    behind = F.substring("v", F.col("key_at") + F.length(F.regexp_extract("v", DATA_KEY, 0)), F.length("v"))
    placed = placed.withColumns({"after": after, "key_at": key_at})
    depth_at_key = F.col("d") + _net(F.when(F.col("s") == 0, _outside(_skeleton(head))).otherwise(_outside(_skeleton(head), 1)))
    placed = placed.withColumn("begins", F.when(F.col("key_at") > 0, depth_at_key == ENVELOPE).otherwise(False))
    placed = placed.withColumn("v", F.when(F.col("begins"), behind).otherwise(F.col("v")))
    inner = F.when(F.col("begins"), F.concat(_outside(_skeleton(F.col("v"))), F.when(shut, F.lit("}")).otherwise(F.lit("")))).otherwise(F.col("b"))
    start = F.when(F.col("begins"), F.lit(LIST)).otherwise(F.col("d"))
    low = F.when(F.col("begins") | (F.col("d") - closers <= ENVELOPE), _lowest(inner, start)).otherwise(LIST)
    placed = placed.withColumn("ends", low <= ENVELOPE)
    # What lies before the list's opening is no part of its first piece.
    next_begins = F.coalesce(F.lead("begins").over(Window.partitionBy("file", "split").orderBy("mid")), F.lit(False))
    placed = placed.withColumn("closes", F.col("ends") | ((F.col("after") == LIST) & shut) | next_begins)
    placed = placed.withColumn("k", _sum_before(F.col("closes").cast("int")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mid", "v"))), lambda r: F.concat(r["v"], F.lit("}"))), "")
    return placed.groupBy("file", "split", "k").agg(
        text.alias("text"), F.max("begins").alias("begins"), F.max("ends").alias("ends"), F.max("closes").alias("closed"))


def joined_pieces(stored: DataFrame) -> DataFrame:
    """Whole pieces: those that cross the edge of a split are put together, in the split where they end."""
    edge = (~F.col("closed")) | ((F.col("k") == 0) & (F.col("split") > 0))
    # At most two rows per split.
    so_far = Window.partitionBy("file").orderBy("split", "k").rowsBetween(Window.unboundedPreceding, -1)
    linked = stored.where(edge).withColumn("link", _sum_before(F.col("closed").cast("int"), so_far))
    place = F.struct("split", "k")
    opening = F.max(F.when(F.col("begins"), place))
    linked = linked.groupBy("file", "link").agg(
        F.max(place).alias("at"), opening.alias("opening"), F.sort_array(F.collect_list(F.struct("split", "k", "text"))).alias("parts"),
        F.max("begins").alias("begins"), F.max("ends").alias("ends"))
    own = F.filter("parts", lambda r: F.col("opening").isNull() | (F.struct(r["split"], r["k"]) >= F.col("opening")))
    linked = linked.withColumn("text", F.array_join(F.transform(own, lambda r: r["text"]), ""))
    return stored.where(~edge).select("file", "split", "k", "text", "begins", "ends").unionByName(
        linked.select("file", "at.split", "at.k", "text", "begins", "ends"))


def _parsed(text: Column) -> Column:
    """A piece as an array of VARIANT.  What follows the list's own bracket is not read."""
    body = F.concat(F.lit("["), F.regexp_replace(text, r"^\s*,", ""), F.lit("]"))
    return F.from_json(body, "array<variant>", {"mode": "FAILFAST"})


@contextmanager
def splits_of(spark: SparkSession, size: int, total: int | None = None) -> Iterator[None]:
    """This split size, for the reads inside.  When they read ``total`` bytes, small splits share
    tasks: a task takes as many as make up the split size that the session had."""
    new = {SPLIT_SIZE: str(size)}
    if total is not None:
        usual = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
        new[TASKS] = str(max(spark.sparkContext.defaultParallelism * 4, -(-total // usual)))
    before = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(file, split, k, c) of files that are one split anyway: a task reads such a file as one JSON document."""
    raw = (spark.read.schema("version STRING, data ARRAY<VARIANT>").option("multiLine", True).option("mode", "FAILFAST")
           .json(path).where(F.col("_metadata.file_size") <= limit))
    data = F.when(F.col("data").isNull(), F.raise_error(F.lit("invalid format: no list under the 'data' key"))
                  ).otherwise(F.col("data"))
    return raw.select(F.col("_metadata.file_path").alias("file"), data.alias("data")).select(
        "file", F.lit(0).cast("bigint").alias("split"), F.posexplode("data").alias("k", "c"))


def large_files(spark: SparkSession, path: str, limit: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(file, split, k, text, first) of the lists' pieces, and per split k0, n, odd: the least ``k``, the
    number of elements, and the pieces that are not one element (``more``: how many more than one)."""
    marks_path, index_path, pieces_path = (scratch_path(spark, f"envelope-{n}") for n in ("marks", "index", "pieces"))
    with splits_of(spark, limit, total):
        marked(fragments(spark, path, limit)).write.parquet(marks_path)  # the texts are cut and marked once
    marks = spark.read.parquet(marks_path)
    split_index(marks).write.parquet(index_path)
    index = spark.read.parquet(index_path)
    pieces(marks, index).write.parquet(pieces_path)
    whole = joined_pieces(spark.read.parquet(pieces_path))
    at = F.struct("split", "k")
    # Per file: where the list opens, and the first piece from there on that reaches the envelope.
    flags = whole.where("begins OR ends").select("file", at.alias("at"), "begins", "ends")
    opened = flags.groupBy("file").agg(F.min(F.when(F.col("begins"), F.col("at"))).alias("from"),
                                       F.count_if("begins").alias("n"))
    files = index.select("file").distinct().join(opened, "file", "left")
    ok = F.when(F.coalesce("n", F.lit(0)) != 1, F.raise_error(F.concat(
        F.lit("invalid format: no list under the 'data' key, or two of them: "), "file"))).otherwise(F.col("from"))
    lists = files.select("file", ok.alias("from")).join(flags.where("ends"), "file").where("at >= `from`") \
        .groupBy("file", "from").agg(F.min("at").alias("to"))
    inside = whole.join(broadcast_if_small(lists), "file").where(at.between(F.col("from"), F.col("to")))
    inside = inside.select("file", "split", "k", "text", (at == F.col("from")).alias("first"))
    # A piece that begins with an object is that object and nothing else; others are counted by parsing them.
    sole = F.col("text").rlike(r"^\s*,?\s*\{")
    n = F.when(sole, 1).otherwise(F.size(_parsed(F.col("text")))).cast("bigint")
    odd = F.when(~sole, F.struct(F.col("k"), (n - 1).alias("more")))
    return inside, inside.groupBy("file", "split").agg(F.min("k").alias("k0"), F.sum(n).alias("n"), F.collect_list(odd).alias("odd"))


def read_envelope(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """(contract_seq, c VARIANT) over all files under ``path``.

    ``contract_seq`` counts from 0 in the order (file path, position), so it is
    unique over any number of files.  Fails when a file has no list under the key
    ``data`` of its outermost object, or (in a large file) two of them, or when its
    JSON is broken.  Files above ``split_bytes`` (the session's split size unless
    given) are cut into splits of that size, for many tasks, and are UTF-8; smaller
    ones are read by one task each."""
    limit = split_bytes
    if limit is None:
        limit = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    path_of_small = scratch_path(spark, "envelope-rows")
    small_files(spark, path, limit).write.parquet(path_of_small)  # parsed once; numbered from the stored rows
    small = spark.read.parquet(path_of_small)
    counts = small.groupBy("file", "split").agg(F.min("k").alias("k0"), F.count(F.lit(1)).alias("n"),
                                                F.lit(None).cast("array<struct<k:bigint,more:bigint>>").alias("odd"))
    sizes = spark.read.format("binaryFile").load(path).select("length")
    pieces_of_large = None
    total = sizes.where(F.col("length") > limit).agg(F.sum("length")).first()[0]
    if total is not None:
        pieces_of_large, more_counts = large_files(spark, path, limit, total)
        counts = counts.unionByName(more_counts)
    # One row per split of all files.
    base = F.coalesce(F.sum("n").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = broadcast_if_small(counts.select("file", "split", "k0", base.alias("base"), "odd"))
    rows = spread(small).join(bases, ["file", "split"]).select((F.col("base") + F.col("k")).alias("contract_seq"), "c")
    if pieces_of_large is None:
        return rows
    # Elements are parted by commas: JSON that lacks one is broken.
    parted = F.col("first") | F.col("text").rlike(r"^\s*[,\]]")
    text = F.when(parted, F.col("text")).otherwise(F.raise_error(F.lit("broken JSON: no comma between two contracts")))
    more = F.aggregate(F.filter("odd", lambda o: o["k"] < F.col("k")), F.lit(0).cast("bigint"), lambda acc, o: acc + o["more"])
    large = pieces_of_large.join(bases, ["file", "split"]).select(
        (F.col("base") + F.col("k") - F.col("k0") + more).alias("first_seq"), F.posexplode(_parsed(text)).alias("pos", "c"))
    return rows.unionByName(large.select((F.col("first_seq") + F.col("pos")).alias("contract_seq"), "c"))
