"""Encoding whole texts piece by piece with a cache, for tokenizers that never join tokens over a space.

A single space between two visible characters always starts a new pre-token in the byte-level
pattern, so the encoding of a text is that of its pieces, each with its leading space, in order.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache

if sys.byteorder != "little":
    raise ImportError("ids are written as the machine holds them, which must be little-endian")

_SAFE = re.compile(r"(?<=\S) (?=\S)")
MARKS = ".,;:!?%$#&*|"  # after a word or number, a run of these is one pre-token
LONGEST_KEPT = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if visible, else the next letter from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in visible else chr(spare))
        spare += b not in visible
    return out


BYTE_LETTERS = dict(enumerate(byte_letters()))


class Recent(dict):
    """A bounded cache: when full, what was not asked for since the last time it filled up goes."""

    def __init__(self, room: int):
        super().__init__()
        self.room, self.old = room // 2, {}

    def find(self, key):
        """The value of a key that is not in the newer half, moved there; None if there is none."""
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.room:
            self.old = dict(self)  # the object itself stays, so its bound methods do too
            self.clear()
        self[key] = value

    def forget(self) -> None:
        self.clear()
        self.old = {}


class Worked(Recent):
    """A :class:`Recent` that works out what it does not hold; long keys are not kept."""

    def __init__(self, room: int, work):
        super().__init__(room)
        self.work = work

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
        if len(key) <= LONGEST_KEPT:
            self.put(key, got)
        return got


class WholeTextEncoder:
    """Ids of a text as little-endian integers, equal to the library's encoding of the text as a whole.

    The library encodes every piece; a piece met again comes from a bounded cache. Text between two
    safe spaces is never cut, so a text of any length needs memory for its longest piece only.
    """

    def __init__(self, path: str, bytes_per_id: int, room: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.code = {2: "H", 4: "I"}[bytes_per_id]
        self.pieces, self.lines, self.marks = Worked(room, self._piece), Worked(room // 8, self._line), {}
        self.line_break = self.ids("\n")

    def ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _mark(self, mark: str) -> bytes:
        got = self.marks.get(mark)
        if got is None:
            if len(self.marks) > 1000:
                self.marks.clear()
            got = self.marks[mark] = self.ids(mark)
        return got

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token; the model takes it in byte-level letters."""
        letters = word.replace(" ", "\u0120") if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece with its space; empty if the spaces beside the piece are no safe cuts."""
        word = piece.rstrip(MARKS)
        if word.isalpha() or word.isascii() and word.isdigit():
            # a word or number with its space is one pre-token
            return self.pieces[word] + self._mark(piece[len(word):]) if len(word) < len(piece) else self._word(" " + word)
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return b""
        head, _, tail = piece.partition("\n")
        if tail and not head[-1].isspace() and not tail[0].isspace():
            # a single line break between two visible characters is a pre-token of its own
            return self.pieces[head] + self.line_break + self.lines[tail]
        return self.ids(" " + piece)

    def _line(self, piece: str) -> bytes:
        """Ids of a piece that follows a line break."""
        word = piece.rstrip(MARKS)
        if not word.isalpha():
            return self.ids(piece)
        return self.lines[word] + self._mark(piece[len(word):]) if len(word) < len(piece) else self._word(word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            got = list(map(self.pieces.__getitem__, rest))
            if b"" not in got:
                return self.ids(first) + b"".join(got)
        first, *rest = _SAFE.split(text)
        return self.ids(first) + b"".join([self.pieces[p] or self.ids(" " + p) for p in rest])


@lru_cache(maxsize=2)
def whole_text_encoder(path: str, bytes_per_id: int) -> WholeTextEncoder:
    """The encoder of a file, once for each Python worker: the tasks of a worker share what is cached."""
    return WholeTextEncoder(path, bytes_per_id)
