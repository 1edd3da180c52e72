"""Repair of conversation structure by weighted interval parsing.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  The
cheapest edits that make it legal are found by bottom-up (CYK) parsing over
spans of its turns.

Grammar (Chomsky normal form).  A symbol names the output of a span by its first
and last initial: ``ua``, ``uu``, ``au``, ``aa``, ``s`` alone, ``su``, ``sa``, or the
empty output.  ``XY -> XM NY`` holds where ``MN`` is ``su``, ``ua`` or ``au``; the empty
symbol joins with any.  A turn yields a symbol by Keep (0), Rerole to user or
assistant (2), or the empty symbol by Delete (3); an undeleted truncated turn adds
1; a blank or repeated turn can only be deleted.  Insert (2) yields user or
assistant from no turn at all; the table of each turn is closed under insertions
before and after it, so that no larger span needs a rule for them.

A cell holds, for each symbol, the least (cost, audit), the audit being the edits'
initials in order.  Parts of one span and symbol with equal costs have audits of
which none is a prefix of another (the rest would be insertions, which cost), so
the least audit of a whole is made of the least audits of its parts.  Every
derivation divides at every place between two turns, so one division of a span
gives its least cells: spans grow by doubling, 1, 2, 4, ... turns.

Spark.  A narrow row per turn (keys and flags, no text) is sorted by
(conversation, turn) over all partitions, whatever the length of one
conversation, and stored once.  Stretches of ``2 ** chunk_bits`` rows are parsed in tasks;
the pieces of longer conversations are joined ``FAN`` at a time, so no task
holds more than a bounded stretch.  The cheapest edits go back to the turns,
and only then texts are fetched, one of each group of copies.

Defined results: a NULL role or text is one space; a NULL turn sorts first and
counts neither for gaps nor as a turn; NULL conv_id is one conversation; rows of
one turn follow each other by role, then by the text's hash; a turn whose role
has another initial than s, u, a (or none) can't be kept; exact copies of a
row are repeated turns; a conversation without rows has zeros and an empty
audit; an empty table gives an empty table; other columns are ignored, whatever
their names; a very long text stays in one row and is only hashed and copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import arrow_schema, materialize

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
ROLES = {"u": "user", "a": "assistant"}
#: Pairs of initials that may follow each other.
FOLLOWS = ("su", "ua", "au")
#: Symbols; the empty output first.
SYMBOLS = ("", "s", "su", "sa", "uu", "ua", "au", "aa")
ACCEPTED = ("", "sa", "ua")
#: Rows parsed as one stretch, as a power of two, and pieces joined at once.
CHUNK_BITS = 12
FAN_BITS = 6

_AT = {s: i for i, s in enumerate(SYMBOLS)}
#: Binary rules (parent, left, right) of non-empty symbols.
RULES = [(_AT["s" + y[-1]] if x == "s" else _AT[x[0] + y[-1]], _AT[x], _AT[y])
         for x in SYMBOLS[1:] for y in SYMBOLS[1:] if x[-1] + y[0] in FOLLOWS]
Cell = tuple  # one (cost, audit) or None for each symbol


def join(a: Cell, b: Cell) -> Cell:
    """The cell of a span from those of its two halves."""
    if a[0] is not None and b[0] is not None:
        best = [(a[0][0] + b[0][0], a[0][1] + b[0][1])]
    else:
        best = [None]
    best += [None] * (len(SYMBOLS) - 1)

    def offer(parent, x, y):
        if x is not None and y is not None:
            cost, now = x[0] + y[0], best[parent]
            if now is None or cost <= now[0]:
                found = (cost, x[1] + y[1])
                if now is None or found < now:
                    best[parent] = found

    for k in range(1, len(SYMBOLS)):
        offer(k, a[0], b[k])
        offer(k, a[k], b[0])
    for parent, x, y in RULES:
        offer(parent, a[x], b[y])
    return tuple(best)


def _symbol_cell(**cells) -> Cell:
    return tuple(cells.get(s or "empty") for s in SYMBOLS)


#: No turn at all: nothing, or one or two insertions (the least for each symbol).
_NONE = _symbol_cell(empty=(0, ""), uu=(2, "I"), aa=(2, "I"), ua=(4, "II"), au=(4, "II"))


def turn_cell(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one turn, closed under insertions on both sides."""
    cells = {"empty": (COST[DELETE], DELETE)}
    if not must_go:
        extra = TRUNCATED_COST if truncated else 0
        for own in "ua":
            cells[own * 2] = (COST[REROLE] + extra, REROLE)
        if initial in ("s", "u", "a"):
            cells["s" if initial == "s" else initial * 2] = (COST[KEEP] + extra, KEEP)
    return join(join(_NONE, _symbol_cell(**cells)), _NONE)


def parse(cells: list[Cell]) -> Cell:
    """The cell of all turns: cells of neighbouring spans are joined, shortest first."""
    while len(cells) > 1:
        joined = [join(cells[i], cells[i + 1]) for i in range(0, len(cells) - 1, 2)]
        cells = joined + cells[len(cells) - len(cells) % 2:]
    return cells[0]


def cheapest(cell: Cell) -> tuple[int, str, bool]:
    """(cost, audit, starts with s) of the least accepted symbol."""
    cost, audit, symbol = min((*cell[_AT[s]], s) for s in ACCEPTED if cell[_AT[s]] is not None)
    return cost, audit, symbol == "sa"


def outputs(audit: str, starts_with_s: bool, first: int, steps: list[tuple[int, int]]) -> Iterator[tuple]:
    """(at, sub, edit, role) of every turn that the edits leave, in order.  Kept turns have
    no new role.  An insertion stands before the next turn's row (sub < 0), or after the last one."""
    expected, waiting, last = "u", [], None
    turns = (at + k for at, n in steps for k in range(n))
    begun = False
    for edit in audit:
        if edit == INSERT:
            waiting.append(ROLES[expected])
        else:
            last = next(turns)
            for k, role in enumerate(waiting):
                yield last, k - len(waiting), INSERT, role
            waiting = []
            if edit != DELETE:
                yield last, 0, edit, None if edit == KEEP else ROLES[expected]
        if edit != DELETE:
            if starts_with_s and not begun:
                begun = True
                continue
            begun = True
            expected = "a" if expected == "u" else "u"
    for k, role in enumerate(waiting):
        yield (first if last is None else last), k + 1, INSERT, role


PIECE = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("chunk", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("n_rows", "lo", "hi", "n_turns", "blank", "duplicate", "truncated", "illegal")],
    T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))])
_COUNTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")


def with_cell(piece: dict, cell: Cell) -> dict:
    return {**piece, "costs": [None if c is None else c[0] for c in cell], "audits": [None if c is None else c[1] for c in cell]}


def piece_cell(piece: dict) -> Cell:
    return tuple(None if a is None else (int(c), a) for c, a in zip(piece["costs"], piece["audits"]))


def add_up(pieces: list[dict]) -> dict:
    """The counts of neighbouring pieces of one conversation, in order."""
    total = dict(pieces[0])
    for p in pieces[1:]:
        for n in _COUNTS:
            total[n] += p[n]
        total["illegal"] += total["last"] + p["first"] not in FOLLOWS
        if p["lo"] is not None:
            total["n_turns"] -= total["hi"] == p["lo"]
            total["lo"] = p["lo"] if total["lo"] is None else total["lo"]
            total["hi"] = p["hi"]
        total["last"] = p["last"]
    return total


def piece_of(conv_id: int | None, chunk: int, rows: list[tuple], cells: dict) -> dict:
    """One piece from its rows (turn, initial, blank, repeated, truncated)."""
    own = []
    for turn, initial, blank, repeated, cut in rows:
        key = (initial, blank or repeated, cut)
        if key not in cells:
            cells[key] = turn_cell(*key)
        own.append(cells[key])
    turns = [r[0] for r in rows if r[0] is not None]
    piece = {
        "conv_id": conv_id, "chunk": chunk, "n_rows": len(rows), "lo": turns[0] if turns else None,
        "hi": turns[-1] if turns else None, "n_turns": len(set(turns)), "blank": sum(r[2] for r in rows),
        "duplicate": sum(r[3] and not r[2] for r in rows), "truncated": sum(r[4] and not (r[2] or r[3]) for r in rows),
        "illegal": sum(a[1] + b[1] not in FOLLOWS for a, b in zip(rows, rows[1:])),
        "first": rows[0][1], "last": rows[-1][1]}
    return with_cell(piece, parse(own))


def batch_of(rows: list, schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=arrow_schema(schema))


def chunk_parser(bits: int):
    """Rows sorted by ``at`` -> one piece for each conversation of each ``2 ** bits`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, Cell] = {}
        key, rows, done = None, [], []
        for batch in batches:
            for at, conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                now = (conv_id, at >> bits)
                if now != key:
                    if rows:
                        done.append(piece_of(*key, rows, cells))
                    key, rows = now, []
                rows.append(tuple(row))
            if len(done) > 1000:
                yield batch_of(done, PIECE)
                done = []
        if rows:
            done.append(piece_of(*key, rows, cells))
        if done:
            yield batch_of(done, PIECE)
    return run


def join_pieces(table: pa.Table) -> pa.Table:
    """Neighbouring pieces of one conversation -> one."""
    pieces = table.select(PIECE.names).sort_by("chunk").to_pylist()
    whole = with_cell(add_up(pieces), parse([piece_cell(p) for p in pieces]))
    return pa.Table.from_pylist([whole], schema=arrow_schema(PIECE))


def one_piece_each(pieces: DataFrame, fan_bits: int) -> DataFrame:
    """Pieces of the same conversation joined until each has one; only those with several are touched."""
    level = 0
    done = None
    while True:
        counts = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        many = counts.where("n > 1").select(F.col("conv_id").alias("c"), F.lit(True).alias("open"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return pieces if done is None else done.unionByName(pieces)
        marked = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
        alone = marked.where("open IS NULL").drop("open")
        level += 1
        last = most <= 1 << fan_bits
        group = F.lit(0).cast("bigint") if last else F.shiftright("chunk", fan_bits * level)
        joined = marked.where("open").drop("open").groupBy("conv_id", group.alias("g")).applyInArrow(join_pieces, PIECE)
        done = alone if done is None else done.unionByName(alone)
        pieces = materialize(joined, "repair-pieces")


def same_text_key(*parts: Column) -> Column:
    """128 bits that name a tuple of strings (each with its length, so that none runs into the next)."""
    return F.unhex(F.md5(F.concat(*[F.concat(F.coalesce(F.length(p).cast("string"), F.lit("-")), F.lit(":"),
                                             F.coalesce(p, F.lit(""))) for p in parts])))


class Repair:
    """Lazily built results of one repair: ``summary`` and ``turns``."""

    def __init__(self, summary: DataFrame, turns: DataFrame):
        self.summary, self.turns = summary, turns


def repair_conversations(turns: DataFrame, chunk_bits: int = CHUNK_BITS, fan_bits: int = FAN_BITS) -> Repair:
    """``turns`` (conv_id, turn, role, text) -> ``summary`` and the repaired ``turns``.

    ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every
    conversation with a row.  ``turns``: conv_id, at, sub (the order within a conversation),
    turn (NULL for an insertion), role, text, edit (K, R or I)."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        role.alias("role"), text.alias("text"))
    key = same_text_key(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"), F.col("text"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv_id", "turn", "role", key.alias("key"), same_text_key(F.col("role"), F.col("text")).alias("said"),
        F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("place"))  # spreads copies of one row over partitions
    order = ("conv_id", "turn", "role", "said")
    sorted_rows = (narrow.repartitionByRange(*order, "place").sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()).drop("place"))
    stored = materialize(sorted_rows, "repair-rows")
    # ``at`` grows along the order: the first of several equal turns of a conversation has the least.
    firsts = (stored.groupBy("conv_id", "said").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first_at"))
    flagged = (stored.select("at", "conv_id", "turn", "initial", "blank", "said", "cut")
               .join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
               .select("at", "conv_id", "turn", "initial", "blank",
                       F.coalesce(F.col("at") > F.col("first_at"), F.lit(False)).alias("repeated"), "cut"))
    chunk = F.shiftright("at", chunk_bits)
    dealt = flagged.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunk) \
        .sortWithinPartitions("at")
    pieces = materialize(dealt.mapInArrow(chunk_parser(chunk_bits), PIECE), "repair-pieces")
    parsed = one_piece_each(pieces, fan_bits)

    verdict = T.StructType([*[T.StructField(n, T.LongType()) for n in (
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        T.StructField("audit", T.StringType()), T.StructField("starts_with_s", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                gaps = 0 if p["lo"] is None else p["hi"] - p["lo"] + 1 - p["n_turns"]
                out.append(dict(zip(verdict.names, (p["conv_id"], gaps, p["blank"], p["duplicate"], p["truncated"],
                                                    p["illegal"], *cheapest(piece_cell(p))))))
            yield batch_of(out, verdict)

    judged = materialize(parsed.mapInArrow(judge, verdict), "repair-verdicts")
    return Repair(judged.drop("starts_with_s"), repaired_turns(rows.withColumn("key", key), stored, judged))


def repaired_turns(rows: DataFrame, stored: DataFrame, judged: DataFrame) -> DataFrame:
    """The turns that the edits leave, with texts."""
    # Consecutive rows of one conversation have consecutive ``at`` within a partition of the sort.
    steps = (stored.groupBy("conv_id", F.shiftright("at", 33).alias("part"))
             .agg(F.struct(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).alias("step"))
             .groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_list("step")).alias("steps")))
    edits = T.StructType([
        T.StructField("conv", T.LongType()), T.StructField("at", T.LongType()), T.StructField("sub", T.IntegerType()),
        T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType())])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, audit, starts, parts in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = [(p["at"], p["n"]) for p in parts]
                for at, sub, edit, role in outputs(audit, starts, pairs[0][0], pairs):
                    out.append({"conv": conv_id, "at": at, "sub": sub, "edit": edit, "new_role": role})
                    if len(out) == 10_000:
                        yield batch_of(out, edits)
                        out = []
            if out:
                yield batch_of(out, edits)

    left = (judged.join(steps, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", "audit", "starts_with_s", "steps").mapInArrow(spell, edits))
    left = materialize(left, "repair-edits")
    own = left.where(F.col("edit") != INSERT).join(stored.select("at", "key", "turn", "role"), "at")
    # One text of each group of copies: copies of a turn are deleted, so a key is kept once at most.
    texts = rows.groupBy("key").agg(F.any_value("text").alias("text"))
    kept = own.join(texts, "key").select(
        F.col("conv").alias("conv_id"), "at", "sub", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    added = left.where(F.col("edit") == INSERT).select(
        F.col("conv").alias("conv_id"), "at", "sub", F.lit(None).cast("bigint").alias("turn"),
        F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return kept.unionByName(added)
