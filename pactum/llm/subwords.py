"""Token ids of whole texts by the ``tokenizers`` library, each distinct word once.

The library's encoding of a text is the concatenation of the encodings of its
white-space-separated words when the tokenizer normalises and splits without
looking across white space.  ``word_bpe_49k.json`` does; a tokenizer that is
not known to is called on whole texts instead.  Ids of words are remembered in
a bounded table per Python worker.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Words remembered per Python worker, in each of two generations.
MEMORY = 400_000
#: Characters that Python's ``str.split`` takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
#: Letters of which lower-casing and composition act on each one alone, then plain punctuation.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """word -> ids as little-endian bytes; call it with a text."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        super().__init__()
        path = path or default_path()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: The smallest unsigned type that holds every id.
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        split = json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = (steps == ["NFC", "Replace", "Lowercase"] and r"[^\\s\\p{L}\\p{N}]+" in split
                        and '"behavior": "Removed", "invert": true' in split
                        and not any(t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", [])))
        pre = self.tokenizer.pre_tokenizer
        self.spelling = {c: "".join(p for p, _ in pre.pre_tokenize_str(chr(c))) for c in range(0x100)
                         if _PLAIN.fullmatch(chr(c)) or chr(c) in "!-&(-/:-@"} if self.by_word else {}
        for c in map(ord, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"):
            self.spelling[c] = chr(c)
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            plain = _PLAIN.fullmatch(word)
            if plain is None or "<|" in word:
                ids = self.whole(word)
            else:
                letters, marks = plain.groups()
                ids = self.part(letters.lower()) + (self.part(marks) if marks else b"")
        self[word] = ids
        return ids

    def part(self, letters: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model."""
        ids = self.parts.get(letters)
        if ids is None:
            ids = self.older_parts.get(letters)
            if ids is None:
                got = self.tokenizer.model.tokenize(letters.translate(self.spelling))
                ids = self.pack([t.id for t in got])
            if len(self.parts) > MEMORY:
                self.older_parts, self.parts = self.parts, {}
            self.parts[letters] = ids
        return ids

    def pack(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if not self.by_word or _NOT_SPACE.search(text):
            return self.whole(text)
        if len(self) > MEMORY:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))

    def array(self, text: str) -> np.ndarray:
        return np.frombuffer(self(text), self.kind)


@lru_cache(1)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder: the tasks that one Python worker runs share its words."""
    return Encoder(path)
