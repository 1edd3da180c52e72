"""Equal 100-byte strings inside one block of text, by a suffix sort with a difference cover.

``COVER`` is a set of residues modulo ``PERIOD`` such that every difference
occurs once: for any two positions there is a shift below ``PERIOD`` that takes
both to sampled positions.  The sampled suffixes (6 of 31) are ranked first, by
prefix doubling, to a depth of 4 * 31 bytes.  Then the wanted suffixes are
sorted one bucket of leading bytes at a time: by their first 31 bytes, and long
ties by the ranks of the sampled positions at the common shift.  So a tie costs
one comparison however long the common passage is, and only one bucket is held
besides the text and the sample's ranks.
"""

from __future__ import annotations

import numpy as np

PERIOD = 31
#: A perfect difference set modulo 31 (fixed values).
COVER = np.array([1, 5, 11, 24, 25, 27])
DEPTH = 4 * PERIOD
#: Suffixes sorted at once, about.
BUCKET = 1 << 18


def _shifts() -> np.ndarray:
    """[a, b]: the shift below PERIOD that takes residues a and b into the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    member = np.zeros(PERIOD, bool)
    member[COVER] = True
    for d in range(PERIOD - 1, -1, -1):
        at = member[(np.arange(PERIOD) + d) % PERIOD]
        out[np.ix_(at, at)] = d
    return out


SHIFT = _shifts()


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k: k + len(text)]
    return out


def _prefix(w: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The first PERIOD bytes from positions ``at``, as four numbers."""
    return [w[at + k] for k in (0, 8, 16, PERIOD - 8)]


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Ranks (equal for equal rows) of rows compared column by column."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(w: np.ndarray, n: int) -> np.ndarray:
    """Rank of the DEPTH bytes from each sampled position on; other positions hold 0.
    ``w`` covers ``n`` positions and DEPTH + 8 more of padding."""
    at = np.flatnonzero(np.isin(np.arange(n + DEPTH) % PERIOD, COVER))
    rank = np.zeros(n + 2 * DEPTH + PERIOD, np.int64)
    rank[at] = _dense(_prefix(w, np.minimum(at, len(w) - 32))) + 1
    for step in (PERIOD, 2 * PERIOD):
        rank[at] = _dense([rank[at], rank[at + step]]) + 1
    return rank


def _resolve(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions ``at``, in groups that tie on their first bytes, sorted inside
    each group by sample ranks: a quicksort of all groups at once."""
    at = at.copy()
    live = np.arange(len(at))
    tie = group.copy()
    while len(live):
        own = tie[live]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        size = np.diff(np.concatenate([first, [len(live)]]))
        pivot = np.repeat(at[live[first + size // 2]], size)
        x = at[live]
        shift = SHIFT[x % PERIOD, pivot % PERIOD]
        side = np.sign(rank[x + shift] - rank[pivot + shift])
        number = np.repeat(np.arange(len(first)), size)
        order = np.argsort(number * 3 + side, kind="stable")
        at[live] = x[order]
        part = (number * 3 + side)[order]
        new = np.concatenate([[True], part[1:] != part[:-1]])
        tie[live] = live[new][np.cumsum(new) - 1]
        again = (side[order] != 0) & (np.diff(np.concatenate([np.flatnonzero(new), [len(live)]]))[np.cumsum(new) - 1] > 1)
        live = live[again]
    return at


def repeats(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions ``starts`` (ascending) begin a string of ``length``
    bytes (at most DEPTH) that an earlier one of them also begins."""
    if length > DEPTH or length <= PERIOD:
        raise ValueError(f"length must be above {PERIOD} and at most {DEPTH}")
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    n = len(text)
    w = words(np.concatenate([text, np.zeros(2 * DEPTH + 32, np.uint8)]))
    rank = sample_ranks(w, n)
    head = w[starts]
    by_head = np.argsort(head, kind="stable")
    head = head[by_head]
    edges = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1], [True]]))
    a = 0
    while a < len(edges) - 1:
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BUCKET, side="right")) - 1)
        bucket = by_head[edges[a]: edges[b]]
        a = b
        if len(bucket) < 2:
            continue
        at = starts[bucket]
        prefix = _prefix(w, at)
        order = np.lexsort(prefix[::-1])
        same = np.ones(len(order), bool)
        same[0] = False
        for c in prefix:
            s = c[order]
            same[1:] &= s[1:] == s[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        order, group = order[tied], np.cumsum(~same)[tied]
        if not len(order):
            continue
        at = _resolve(at[order], group, rank)
        equal = np.ones(len(at) - 1, bool)
        for k in [*range(0, length - 8, 8), length - 8]:
            equal &= w[at[1:] + k] == w[at[:-1] + k]
        cls = np.concatenate([[0], np.cumsum(~equal)])
        first = np.full(cls[-1] + 1, n)
        np.minimum.at(first, cls, at)
        late = at[at != first[cls]]
        out[np.searchsorted(starts, late)] = True
    return out
