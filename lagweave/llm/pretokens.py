"""Rank files of byte-level tokenizers, and the split of texts into pre-tokens."""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import regex

#: A character that is neither space, letter nor number.
STAND_IN = "☃"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank. The file's size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def foreign_characters(pattern: str) -> str:
    """Characters that the regex module takes for letters or numbers and the tiktoken library does not.

    The two carry tables of different Unicode versions. Only characters that are unassigned in Python's own older
    table can differ, so only those are put to tiktoken, with a toy vocabulary that joins them to a letter or digit.
    """
    import tiktoken

    ranks = {bytes([b]): b for b in range(256)}
    for first in b"a1":
        ranks |= {bytes([first, b]): len(ranks) + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    new = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn")
    joined = lambda a, c: probe.encode_ordinary(a + c)[0] > 255
    return "".join([c for c in regex.findall(r"\p{L}", new) if not joined("a", c)] + [c for c in regex.findall(r"\p{N}", new) if not joined("1", c)])


class Splitter:
    """Cuts a text into the matches of the pattern, as the tiktoken library would."""

    def __init__(self, pattern: str, foreign: str):
        self.pattern, self.foreign = pattern, foreign
        self._build()

    def _build(self):
        self._find = regex.compile(self.pattern)
        self._table = {ord(c): STAND_IN for c in self.foreign}
        self._odd = frozenset(self.foreign)
        self._least = min(self.foreign, default="\U0010ffff")

    def __getstate__(self):
        return self.pattern, self.foreign

    def __setstate__(self, state):
        self.pattern, self.foreign = state
        self._build()

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or max(text) < self._least or self._odd.isdisjoint(text):
            return self._find.findall(text)
        return [text[m.start() : m.end()] for m in self._find.finditer(text.translate(self._table))]
