"""Word-shingle sets of whole texts as sorted 64-bit hashes, vectorised over UTF-8 bytes.

A-Z are lower-cased; a word is a run of bytes other than space and 0x09-0x0D; a
shingle is five words in a row, or the whole sequence of a text with fewer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from pactum.llm.common import mix64

#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
WIDTH = 5
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, equal for A-Z and a-z.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_PLACE = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, n), _powers(_BACK, n)


def word_hashes(offsets: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the first word of each text and the total)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    power, back = _tables(BLOCK_BYTES) if n <= BLOCK_BYTES else (_powers(_STEP, n), _powers(_BACK, n))
    word = _IN_WORD[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]  # a word doesn't go on into the next text
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * power[:n])])
    h = (total[end] - total[start]) * back[start]
    return mix64(h ^ (end - start).astype(np.uint64)), np.searchsorted(start, offsets)


def shingle_sets(offsets: np.ndarray, buf: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = word_hashes(offsets, buf)
    five = h[: max(len(h) - WIDTH + 1, 0)] * _PLACE[0]
    for k in range(1, WIDTH):
        five = five + h[k: len(h) - WIDTH + 1 + k] * _PLACE[k]
    five = mix64(five)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            own = np.sort(five[a: b - WIDTH + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            own = h[a:b] * _PLACE[: b - a] + np.uint64(b - a)
            out.append(mix64(np.array([own.sum(dtype=np.uint64)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(own: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit checksums of a set."""
    one = mix64(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    two = mix64(own ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))
