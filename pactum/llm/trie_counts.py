"""Token counts: trie-shared dynamic programming over distinct pre-tokens.

The distinct words of a block are inserted into a trie level by level.  Every
trie node is a prefix; its forward score (the best unigram score of the prefix
and the number of tokens on that path) is computed once, for all nodes of a
level together, from its ancestors at most ``max_len`` levels up.  The count
stored at a word's terminal node is the word's token count, and a text's count
is the sum over its words.  Only the last ``max_len`` levels are held.

Scores, ties and unknown characters are those of :mod:`pactum.llm.pieces`, so
the counts equal the lengths of the Viterbi encodings.

Defined results: a NULL or empty text has 0 tokens; equal rows have equal
counts; a very long word is a path of its own, linear in its length; the id is
passed through; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import WORD_BYTES, map_rows
from pactum.llm.pieces import _BASE, Pieces

#: Distinct characters' worth of words in one trie, at most (or one word).
TRIE_CHARS = 1 << 21
MEMORY = 500_000
RESULT = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
          T.StructField("n_tokens", T.LongType())]


def trie_counts(words: list[str], v: Pieces) -> np.ndarray:
    """Token count of each (distinct, non-empty) word."""
    lengths = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = np.zeros(len(words), np.int64)
    node = np.zeros(len(words), np.int64)  # of each word at the level reached
    live = np.arange(len(words))
    # Per level, oldest first: best score, tokens, prefix hash, and the parent of each node.
    levels = [(np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.uint64), None)]
    tails: list[np.ndarray] = []  # character of each node
    unknown_cost = {}
    depth = 0
    while len(live):
        char = codes[starts[live] + depth].astype(np.int64)
        edge, first, node_of = np.unique(node[live] << 21 | char, return_index=True, return_inverse=True)
        node[live] = node_of
        parent, char = edge >> 21, char[first]
        h = levels[-1][2][parent] * _BASE + char.astype(np.uint64) + np.uint64(1)
        levels.append((None, None, h, parent))
        tails.append(char)
        top, tokens = np.full(len(edge), -np.inf), np.zeros(len(edge), np.int64)
        up = [np.arange(len(edge))]
        for k in range(1, min(v.max_len, len(levels) - 1) + 1):
            up.append(levels[-k][3][up[-1]])
        for k in range(len(up) - 1, 0, -1):
            best, below, hashes, _ = levels[-1 - k]
            at, hit = v.probe(h - hashes[up[k]] * v.power[k] + np.uint64(k))
            for j in range(k):  # the characters themselves, last first
                some = np.flatnonzero(hit)
                same = v.codes[at[some], k - 1 - j] == tails[-1 - j][up[j][some]]
                hit[some[~same]] = False
            score = np.where(hit, best[up[k]] + v.score[at], -np.inf)
            more = np.ones(len(edge), np.int64)
            if k == 1:
                lone = np.flatnonzero(~hit)
                score[lone] = best[up[1][lone]] + v.unknown_score
                for c in np.unique(char[lone]).tolist():
                    if c not in unknown_cost:
                        unknown_cost[c] = len(v.unknown_ids(c))
                more[lone] = [unknown_cost[c] for c in char[lone].tolist()]
            better = score > top
            top[better] = score[better]
            tokens[better] = (below[up[k]] + more)[better]
        levels[-1] = (top, tokens, h, parent)
        if len(levels) > v.max_len + 1:
            levels.pop(0)
            tails.pop(0)
        depth += 1
        ended = lengths[live] == depth
        counts[live[ended]] = tokens[node_of[ended]]
        live = live[~ended]
    return counts


def token_counts(docs: DataFrame, path: str | None = None, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words (pre-tokens), n_tokens."""

    def make():
        v = Pieces(path)
        known: dict[str, int] = {}

        def step(batch: pa.RecordBatch) -> dict:
            split = [v.split(t or "") for t in batch.column("text").to_pylist()]
            if len(known) > MEMORY:
                known.clear()
            fresh = sorted({w for words in split for w in words if w not in known})
            cuts = np.concatenate([[0], np.cumsum([len(w) for w in fresh])])
            a = 0
            while a < len(fresh):
                b = max(a + 1, int(np.searchsorted(cuts, cuts[a] + TRIE_CHARS, side="right")) - 1)
                known.update(zip(fresh[a:b], trie_counts(fresh[a:b], v).tolist()))
                a = b
            get = known.__getitem__
            return {"n_words": list(map(len, split)), "n_tokens": [sum(map(get, words)) for words in split]}
        return step

    return map_rows(docs, {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text")}, RESULT, make, carry, WORD_BYTES)
