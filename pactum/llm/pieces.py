"""A piece vocabulary (SentencePiece model file) as sorted hash keys, read as a
unigram model: every piece has a score, a segmentation has the sum of its
pieces' scores, the best segmentation has the largest sum.

Equal sums: the segmentation whose last piece is longest, then so on to the
left.  A character that is no
piece of its own costs the lowest score less 10 and is spelled in byte pieces
where the vocabulary has them, else it is the unknown id.
"""

from __future__ import annotations

import re
from functools import cached_property

import numpy as np

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MARK_BITS = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Vocabulary of one model file."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.byte_id = np.full(256, -1, np.int32)
        normal = []
        for i in range(n):
            if model.is_byte(i):
                self.byte_id[int(self.text[i][1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
        self.special = {i for i in range(n) if model.is_control(i)}
        scores = np.array([model.get_score(i) for i in normal], np.float64)
        self.unknown_score = scores.min() - UNKNOWN_PENALTY
        codes = [np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32) for i in normal]
        self.max_len = max(map(len, codes))
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.max_len, _BASE))])
        keys = np.array([poly_hash(c[None, :])[0, -1] for c in codes], np.uint64) + np.array(
            [len(c) for c in codes], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.score = keys[order], scores[order]
        self.id = np.array(normal, np.int32)[order]
        self.mark = np.zeros(1 << _MARK_BITS, bool)
        self.mark[self.slot(self.keys)] = True
        self.codes = np.zeros((len(normal), self.max_len), np.uint32)
        for row, k in enumerate(order):
            self.codes[row, : len(codes[k])] = codes[k]
        inner = any(SPACE in p.lstrip(SPACE) for p in (self.text[i] for i in normal))
        breaks = any("\n" in self.text[i] for i in normal)
        # No piece goes on from another character into a space mark, or over a
        # line break: the best segmentation of a text is that of its words.
        self.word = None if inner else re.compile(
            f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if breaks else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in the sorted table, found?) for each key.  Most keys are no piece
        and fall out at a table of marked slots, before the binary search."""
        at, hit = np.zeros(len(keys), np.int64), self.mark[self.slot(keys)]
        some = np.flatnonzero(hit)
        found = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        at[some] = found
        hit[some] = self.keys[found] == keys[some]
        return at, hit

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _MARK_BITS)

    def split(self, text: str) -> list[str]:
        """Independent words of a text, its spaces marked; joined they give it back."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.word.findall(marked) if self.word else [marked]

    def unknown_ids(self, code: int) -> list[int]:
        own = self.byte_id[list(chr(code).encode("utf-8", "replace"))]
        return own.tolist() if (own >= 0).all() else [self.unknown]

    @cached_property
    def spelled(self) -> list[bytes]:
        """What each id stands for in decoded text."""
        out = [b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)]
        for b, i in enumerate(self.byte_id):
            if i >= 0:
                out[i] = bytes([b])
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def poly_hash(codes: np.ndarray) -> np.ndarray:
    """(rows, length) hashes of all prefixes of each row, modulo 2**64."""
    out = np.empty(codes.shape, np.uint64)
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        out[:, j] = h
    return out
