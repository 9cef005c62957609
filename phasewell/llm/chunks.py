"""Pieces of text whose byte-level BPE ids don't depend on what stands around them.

The split pattern of these vocabularies always begins a pre-token at a single space between two characters that
aren't white space, and at a run of signs after a letter. So the ids of a text are those of the parts cut there,
one after another, and a worker remembers the ids of parts that it has seen. Most different parts occur once, so a part
is remembered when it comes again: what a task holds is what it uses.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOUBLE = re.compile(r"\s\s")
#: Parts that a worker remembers, the longest part that it remembers, and the marks, a byte each, of parts seen before.
REMEMBERED = 200_000
LONGEST = 48
MARKS = 1 << 20
#: Signs whose last run, after a letter, is a pre-token; not the apostrophe, which can begin one. Runs that a worker remembers.
SIGNS = "!\"#$%&()*+,-.:;<=>?@[\\]^_`{|}~"
REMEMBERED_SIGNS = 5_000
_LAST_LATIN = "ɏ"


def is_word(part: str) -> bool:
    """Is the part one pre-token, after its space: letters alone, of scripts that every regex engine knows?"""
    return part.isalpha() and (part.isascii() or max(part) <= _LAST_LATIN)


class Remembered(dict):
    """part -> ids, as little-endian unsigned 32-bit bytes, of a space and the part; forgets all when it is full.

    A part that hasn't been seen is only marked, so those that occur once take no room.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.plain = encode
        self.signs: dict[str, bytes] = {}
        self.marks = bytearray(MARKS)

    def __missing__(self, part: str) -> bytes:
        word = part.rstrip(SIGNS)
        if word and len(word) < len(part) and word[-1].isalpha() and word[-1] <= _LAST_LATIN:
            ids = self[word] + self._sign(part[len(word) :])
        else:
            ids = self.plain(" " + part)
        if len(part) <= LONGEST:
            mark = hash(part) % MARKS
            if not self.marks[mark]:
                self.marks[mark] = 1
            else:
                if len(self) >= REMEMBERED:
                    self.clear()
                    self.marks = bytearray(MARKS)
                self[part] = ids
        return ids

    def _sign(self, run: str) -> bytes:
        ids = self.signs.get(run)
        if ids is None:
            ids = self.plain(run)
            if len(run) <= LONGEST:
                if len(self.signs) >= REMEMBERED_SIGNS:
                    self.signs.clear()
                self.signs[run] = ids
        return ids


def parts(text: str) -> list[str]:
    """The text cut at spaces that begin a pre-token; these spaces are left out."""
    if text[:1] != " " and text[-1:] != " " and not _DOUBLE.search(text):
        return text.split(" ")
    return _CUT.split(text)


def encode(text: str, remembered: Remembered) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit bytes."""
    if not text:
        return b""
    found = parts(text)
    found[0] = remembered.plain(found[0])
    found[1:] = map(remembered.__getitem__, found[1:])
    return b"".join(found)
