"""Periodic runs of words: maximal stretches that repeat one block of words.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) and length >= max(``min_length``, ``min_exponent * q``) that
no neighbouring word extends with the same period.

Method, for each text:

1. Words become numbers.  A word that lies in no repeated window of
   ``window_size`` words can't be in a run, nor extend one; it cuts the text
   into stretches (an exact bound, see ``window_size``).
2. The first phase of Baier's suffix sorter groups the suffixes of a stretch by
   their longest Lyndon prefix.  It runs under the order of the numbers and
   under the reversed order, and yields the Lyndon array of each directly; no
   suffix array is made.
3. A run shows as consecutive Lyndon roots of its period under one of the two
   orders.  The first of them is extended to both sides by longest common
   extensions; roots inside a run already found are skipped.

Work is linear in the words but for the extensions, which compare each run once;
memory is a few numbers a word of one text.

Defined results: a NULL or empty text, or one of white space only, has no words
and no run; equal rows are treated alike, each for itself; the id is passed
through, NULL included; other columns are ignored, whatever their names; an
empty table gives an empty table; a very long text is one row in one task, with
memory linear in it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import map_rows, mix64

MIN_LENGTH = 6
MIN_EXPONENT = 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
          T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def window_size(min_length: int, min_exponent: int) -> int:
    """The longest window of which every occurrence inside a run has another one
    a period before or after it: ``length + 1 - 2 * period`` at the shortest run
    of each period."""
    size, q = min_length - 1, 1
    while min_exponent * q < min_length:
        q += 1
        size = min(size, max(min_length, min_exponent * q) + 1 - 2 * q)
    return max(1, min(size, (min_exponent - 2) * q + 1))


def stretches(codes: np.ndarray, width: int) -> list[tuple[int, int]]:
    """[a, b) of the words covered by consecutive windows that occur twice or more."""
    n = len(codes) - width + 1
    if n < 2:
        return []
    key = np.zeros(n, np.uint64)
    for k in range(width):  # equal windows have equal keys; a clash only keeps more words
        key = mix64(key + codes[k: k + n].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(n + 2, bool)
    again[order[1:][same] + 1] = True
    again[order[:-1][same] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(int(a), int(b) + width - 1) for a, b in zip(edges[::2], edges[1::2])]


def lyndon_array(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each position.

    Suffixes lie in ``place`` by groups in ascending order; a group has a start,
    an end and the length of the prefix that its suffixes share.  Groups are
    handled from the last to the first.  Each member points to the nearest
    earlier suffix of a lower group; the suffixes pointed to ``l`` times leave
    their group for a new one right behind it, whose prefix is longer by ``l``
    times that of the group in hand.  What a group's prefix is when its turn
    comes is the longest Lyndon prefix of its members.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    ends = np.append(starts[1:], n)
    by_place = np.repeat(starts, ends - starts)
    group_of = np.empty(n, np.int64)
    group_of[order] = by_place
    spot = np.empty(n, np.int64)
    spot[order] = np.arange(n)
    place, group, at = order.tolist(), group_of.tolist(), spot.tolist()
    stop, width, before = [0] * (n + 1), [1] * (n + 1), list(range(-1, n - 1))
    for a, b in zip(starts.tolist(), ends.tolist()):
        stop[a] = b
    lengths = [0] * n
    end = n
    while end:
        start = group[place[end - 1]]
        size = width[start]
        pointed: dict[int, int] = {}
        for i in sorted(place[start:end]) if end - start > 1 else (place[start],):
            lengths[i] = size
            j = before[i]
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = start
        for times in sorted(set(pointed.values()), reverse=True):
            left: dict[int, int] = {}
            for i, k in pointed.items():
                if k == times:
                    g = group[i]
                    left.setdefault(g, stop[g])
                    stop[g] = last = stop[g] - 1
                    here, other = at[i], place[last]
                    place[here], at[other] = other, here
                    place[last], at[i] = i, last
            for g, b in left.items():
                new = stop[g]
                width[new], stop[new] = width[g] + times * size, b
                if new != g:
                    for k in range(new, b):
                        group[place[k]] = new
    return np.array(lengths, np.int64)


def common_extension(codes: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` on equal those from ``b`` > a on; compared in doubling blocks."""
    n, k, step = len(codes) - b, 0, 16
    while k < n:
        m = min(step, n - k)
        differs = codes[a + k: a + k + m] != codes[b + k: b + k + m]
        first = int(differs.argmax())
        if differs[first]:
            return k + first
        k, step = k + m, step * 2
    return n


def runs_of(codes: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of one stretch."""
    n, found = len(codes), set()
    back = codes[::-1]
    for signed in (codes, -codes):
        lengths = lyndon_array(signed)
        root = np.arange(n)
        fits = root + (min_exponent - 1) * lengths <= n
        for k in range(1, min_exponent - 1):  # as many whole roots follow each other in every run
            fits &= lengths[np.minimum(root + k * lengths, n - 1)] == lengths
        known: dict[int, int] = {}
        for i in np.flatnonzero(fits).tolist():
            q = int(lengths[i])
            if i < known.get(q, 0):
                continue
            start = i - common_extension(back, n - i - q, n - i)
            stop = i + q + common_extension(codes, i, i + q)
            known[q] = stop - q
            if stop - start >= max(min_length, min_exponent * q):
                found.add((start, stop - start, q))
    return found


def find_runs(words: list[str], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs of a list of words, by start and period."""
    if len(words) < min_length:
        return []
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for a, b in stretches(codes, window_size(min_length, min_exponent)):
        if b - a >= min_length:
            found += [(a + s, n, q) for s, n, q in runs_of(codes[a:b], min_length, min_exponent)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, without those that any run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period: start + length] = False
    return " ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): number of words, its runs by start and
    period, and the text with each run cut down to its first period."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            counts, runs, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORD.findall(text or "")
                got = find_runs(words, min_length, min_exponent)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in got])
                texts.append(collapse(words, got))
            return {"n_words": counts, "runs": runs, "collapsed": texts}
        return step

    return map_rows(docs, {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text")}, RESULT, make, carry)
