"""SentencePiece encoding and decoding: batched numpy Viterbi over equal-length words.

The distinct words of a block are grouped by length.  One group advances
together, one character at a time: the hashes of all substrings that end there
probe the sorted piece keys, a vectorised maximum over their starts keeps the
best score and a backpointer, and the backpointers are followed for all words
at once.  Encodings of words are remembered per task in a bounded table.

Defined results: a NULL or empty text has no ids and decodes to the empty
text; equal rows are encoded alike; a very long word is a group of its own,
linear in its length; ids that are NULL or out of range in ``decode`` are
skipped; the id column is passed through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import WORD_BYTES, map_rows
from pactum.llm.pieces import Pieces, poly_hash

#: Characters of equal-length words that advance together, at most (or one word).
GROUP_CHARS = 1 << 19
#: Remembered words per task.
MEMORY = 400_000


def viterbi(codes: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of equal-length words ``codes`` (words, length):
    (piece length, table row or -1) of the piece that ends at each character
    of the best path; length 0 where none ends."""
    m, n = codes.shape
    h = np.concatenate([np.zeros((m, 1), np.uint64), poly_hash(codes)], axis=1)
    best = np.zeros((m, n + 1))
    back = np.zeros((m, n + 1), np.int32)
    row = np.full((m, n + 1), -1, np.int32)
    for j in range(1, n + 1):
        top = np.full(m, -np.inf)
        for k in range(min(v.max_len, j), 0, -1):
            at, hit = v.probe(h[:, j] - h[:, j - k] * v.power[k] + np.uint64(k))
            some = np.flatnonzero(hit)
            if len(some):
                same = (v.codes[at[some], :k] == codes[some, j - k: j]).all(axis=1)
                hit[some[~same]] = False
            score = np.where(hit, best[:, j - k] + v.score[at], -np.inf)
            if k == 1:
                lone = ~hit
                score[lone] = best[lone, j - 1] + v.unknown_score
            better = score > top
            top[better] = score[better]
            back[better, j] = k
            row[better, j] = np.where(hit[better], at[better], -1)
        best[:, j] = top
    taken = np.zeros((m, n + 1), np.int32)
    where, words = np.full(m, n), np.arange(m)
    while len(words):
        step = back[words, where[words]]
        taken[words, where[words]] = step
        where[words] -= step
        words = words[where[words] > 0]
    return taken[:, 1:], row[:, 1:]


def encode_words(words: list[str], v: Pieces) -> dict[str, bytes]:
    """word -> its ids as little-endian int32."""
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    out = {}
    for n, group in by_length.items():
        size = max(1, GROUP_CHARS // n)
        for a in range(0, len(group), size):
            part = group[a: a + size]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            taken, row = viterbi(codes, v)
            where = np.nonzero(taken)
            rows = row[where]
            ids = np.where(rows >= 0, v.id[rows], -1)
            cuts = np.searchsorted(where[0], np.arange(len(part) + 1))
            unknown = np.flatnonzero(ids < 0)
            strange = set(where[0][unknown].tolist())
            raw = ids.astype("<i4").tobytes()
            for i, w in enumerate(part):
                own = raw[4 * cuts[i]: 4 * cuts[i + 1]]
                if i in strange:
                    spelled = []
                    for k in range(cuts[i], cuts[i + 1]):
                        spelled += [int(ids[k])] if ids[k] >= 0 else v.unknown_ids(int(codes[i, where[1][k]]))
                    own = np.array(spelled, "<i4").tobytes()
                out[w] = own
    return out


class Encoder:
    """Texts to ids, with a bounded memory of words."""

    def __init__(self, path: str | None = None):
        self.pieces, self.known = Pieces(path), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces.split(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = {w for words in split for w in words if w not in self.known}
        self.known.update(encode_words(list(fresh), self.pieces))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def encode(docs: DataFrame, path: str | None = None, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text, ids (array<int>)."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
              T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def make():
        encoder = Encoder(path)

        def step(batch: pa.RecordBatch) -> dict:
            got = encoder([t or "" for t in batch.column("text").to_pylist()])
            flat = np.frombuffer(b"".join(got), "<i4")
            cuts = np.concatenate([[0], np.cumsum([len(b) // 4 for b in got])]).astype(np.int32)
            return {"ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))}
        return step

    return map_rows(docs, {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text")}, fields, make, carry, WORD_BYTES)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids, any others ignored): doc_id, n_tokens, ids_crc32, decoded."""
    import zlib

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
              T.StructField("decoded", T.StringType())]

    def make():
        v = Pieces(path)
        n = len(v.text)

        def step(batch: pa.RecordBatch) -> dict:
            texts, sizes, sums = [], [], []
            for ids in batch.column("ids"):
                a = ids.values
                a = np.zeros(0, "<i4") if a is None else a.drop_null().to_numpy().astype("<i4")
                a = a[(a >= 0) & (a < n)]
                texts.append(v.decode(a.tolist()))
                sizes.append(len(a))
                sums.append(zlib.crc32(a.tobytes()))
            return {"n_tokens": sizes, "ids_crc32": sums, "decoded": texts}
        return step

    cols = {"doc_id": F.col("doc_id").cast("bigint"), "text": F.col("text"), "ids": F.col("ids").cast("array<int>")}
    return map_rows(encoded, cols, fields, make)
