"""Byte-pair encoding and decoding by scanning a contiguous array of ranks.

A word is held as the boundaries of its parts with, beside each, the rank of joining that part with the
next. The lowest rank is looked for by a scan, its boundary is deleted, and the ranks of the two
neighbours are looked up anew, until no join is left. Words longer than ``SHORT`` parts use a heap of
(rank, place) over linked boundaries instead, since repeated scans would cost the square of their length.
"""

from __future__ import annotations

import json
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import BATCH_BYTES
from chromaspark.llm.pieces import BYTE_LETTERS, Recent, Worked

SHORT = 256
MOST_PIECES, MOST_WORDS = 400_000, 200_000  # cached in a worker
_NONE = 1 << 60
# White space as the tokenizer's patterns understand it, and its word pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"


class WordBpe:
    """Encoder and decoder of one vocabulary file with lower-cased words that end in a mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(WORD)
        self.apart = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        # ids as bytes, which take half the room of tuples
        self.words, self.pieces = Recent(MOST_WORDS), Worked(MOST_PIECES, self._piece)

    def parts(self, word: str) -> list[str]:
        """The parts a word ends up in."""
        symbols = list(word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(BYTE_LETTERS))
        if not symbols:
            return []
        symbols[-1] += self.end
        return self._scan(symbols) if len(symbols) <= SHORT else self._heap(symbols)

    def _scan(self, parts: list[str]) -> list[str]:
        rank = self.ranks.get
        beside = [rank(pair, _NONE) for pair in zip(parts, parts[1:])]
        while beside:
            low = min(beside)
            if low == _NONE:
                break
            i = beside.index(low)
            parts[i] += parts[i + 1]
            del parts[i + 1], beside[i]
            if i < len(beside):
                beside[i] = rank((parts[i], parts[i + 1]), _NONE)
            if i:
                beside[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
        return parts

    def _heap(self, parts: list[str | None]) -> list[str]:
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the two has been joined meanwhile
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((parts[a], parts[b]))) is not None:
                    heapq.heappush(queue, (r, a, parts[a], parts[b]))
        return [p for p in parts if p is not None]

    def _new(self, word: str) -> bytes:
        return array("I", [self.ids[p] for p in self.parts(word) if p in self.ids]).tobytes()

    def _word(self, word: str) -> bytes:
        got = self.words.find(word)
        if got is None:
            got = self._new(word)
            self.words.put(word, got)
        return got

    def _piece(self, piece: str) -> bytes:
        """Ids of text between two spaces; no word and no composed letter reaches over a space."""
        low = piece.lower()
        if low.isascii() and low.isalpha():
            # most words stand between spaces only: as a piece such a word is kept once
            return self.words.get(low) or (self._word(low) if low != piece or low in self.words.old else self._new(low))
        if not self.apart.search(piece):
            return self._plain(piece)
        out: list[bytes] = []
        at = 0
        for m in self.apart.finditer(piece):
            out += self._plain(piece[at: m.start()]), array("I", [self.special[m.group()]]).tobytes()
            at = m.end()
        return b"".join(out) + self._plain(piece[at:])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a capital sigma at the end of a word has no form of its own here
        text = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
        return b"".join([self.words.get(w) or self._word(w) for w in self.pattern.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return array("I", b"".join(map(self.pieces.__getitem__, text.split(" ")))).tolist()

    def forget(self) -> None:
        """Drop what is cached; the worker may go on with tasks of other stages, which need the memory."""
        self.words.forget()
        self.pieces.forget()

    def decode(self, ids: list[int]) -> str:
        """The parts joined by spaces, as a file without a decoder of its own asks for; unknown ids give nothing."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The encoder of a file, once for each Python worker."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>, decoded string)`` for each row of ``docs``.

    A null or empty text has no ids and decodes to the empty string. Repeated rows, null keys and further
    columns (not looked at) change nothing for a row; an empty table gives an empty result. Every text is
    encoded whole, whatever its length; results travel in small batches.
    """
    kind = docs.select(F.col(key)).schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        try:
            for b in batches:
                keys, ids, decoded, size, since = b.column(0), [], [], 0, 0
                for n, t in enumerate(b.column(1), 1):
                    ids.append(bpe.encode(t.as_py()))
                    decoded.append(bpe.decode(ids[-1]))
                    size += 4 * len(ids[-1]) + len(decoded[-1])
                    if size >= BATCH_BYTES or n == b.num_rows:
                        yield pa.RecordBatch.from_arrays(
                            [keys.slice(since, n - since), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                            ["key", "ids", "decoded"],
                        )
                        ids, decoded, size, since = [], [], 0, n
        finally:
            bpe.forget()

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, ids array<int>, decoded string"
    )
    return out.withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of ids and checksums of the ids and of the decoded text."""
    return encoded.select(
        key, F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
