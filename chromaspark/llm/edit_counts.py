"""Token counts that follow edits.

A document is held as segments of whole pre-tokens and a tree of sums over their token counts. An edit
re-encodes only the segments it touches, with those whose border it comes near, and then the sums on the
way to the root. Segments are cut at single spaces between visible characters, where the pattern of
byte-level tokenizers always starts a new pre-token, so counts equal those of the whole edited text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromaspark.llm.common import BATCH_BYTES
from chromaspark.llm.pieces import whole_text_encoder

SEGMENT = 256  # characters a segment has at the least, but for the last
_CUT = re.compile(r"(?<=\S) (?=\S)")
_STATE = "array<int>"


def cut_segments(text: str, least: int = SEGMENT) -> list[int]:
    """Starts of the segments of a text."""
    starts, at = [0], least
    while (m := _CUT.search(text, max(1, at))) is not None:
        starts.append(m.start())
        at = m.start() + least
    return starts


class SumTree:
    """Sums over leaves in heap order: node i has the children 2i and 2i + 1, leaves start at ``size``."""

    def __init__(self, leaves: list[int] | np.ndarray):
        n = max(1, len(leaves))
        self.size = 1 << (n - 1).bit_length()
        self.nodes = np.zeros(2 * self.size, dtype=np.int64)
        self.nodes[self.size: self.size + len(leaves)] = leaves
        level = self.size
        while level > 1:
            self.nodes[level // 2: level] = self.nodes[level: 2 * level: 2] + self.nodes[level + 1: 2 * level: 2]
            level //= 2

    @classmethod
    def stored(cls, nodes: list[int]) -> SumTree:
        tree = cls.__new__(cls)
        tree.nodes, tree.size = np.array(nodes, dtype=np.int64), len(nodes) // 2
        return tree

    def total(self) -> int:
        return int(self.nodes[1])

    def set(self, leaf: int, value: int) -> None:
        i = leaf + self.size
        change = value - self.nodes[i]
        while i:
            self.nodes[i] += change
            i //= 2


class EditedText:
    """A text with its segments and counts; :meth:`apply` takes all edits of one version together."""

    def __init__(self, text: str, starts: list[int], tree: SumTree, count):
        self.text, self.starts, self.tree, self.count = text, starts, tree, count
        self.encoded = 0  # characters encoded again so far

    @classmethod
    def new(cls, text: str, count) -> EditedText:
        starts = cut_segments(text)
        ends = [*starts[1:], len(text)]
        return cls(text, starts, SumTree([count(text[a:b]) for a, b in zip(starts, ends)]), count)

    def apply(self, edits: list[tuple[int, int, str]]) -> tuple[str, int]:
        """The edited text, and the number of edits that were left out.

        ``edits`` are (start, end, replacement) in characters of the text as it was, in order. Places
        outside are moved to the nearest one inside; an edit that begins before the end of the one
        before it, or ends before its own start, is left out. Text, starts and tree are those of the
        edited text afterwards. The tree keeps its leaves: what the edits touch is cut anew into at most as
        many segments as it had, and leaves left over are empty segments behind them.
        """
        n, done, skipped, last = len(self.text), [], 0, -1
        for a, b, new in edits:
            a, b = min(max(a, 0), n), min(max(b, 0), n)
            if b < a or a < last:
                skipped += 1
                continue
            done.append((a, b, new))
            last = b
        starts = np.array(self.starts)
        groups: list[list] = []  # first and last segment, edits
        for e in done:
            # one character before a border and two after it decide that it is one
            low = int(np.searchsorted(starts, e[0] - 2, side="right")) - 1
            high = int(np.searchsorted(starts, e[1] + 1, side="right")) - 1
            low, high = max(0, low), max(0, high)
            if groups and low <= groups[-1][1]:
                groups[-1][1] = max(high, groups[-1][1])
                groups[-1][2].append(e)
            else:
                groups.append([low, high, [e]])
        ends = [*self.starts[1:], n]
        out, at, shift, moved = [], 0, 0, starts.copy()
        for low, high, own in groups:
            begin, end = self.starts[low], ends[high]
            parts, p = [], begin
            for a, b, new in own:
                parts += [self.text[p:a], new]
                p = b
            piece = "".join([*parts, self.text[p:end]])
            self.encoded += len(piece)
            leaves = high - low + 1
            cuts = cut_segments(piece, max(SEGMENT, -(-len(piece) // leaves))) if leaves > 1 else [0]
            cuts += [len(piece)] * (leaves + 1 - len(cuts))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]), low):
                self.tree.set(i, self.count(piece[a:b]) if b > a else 0)
                moved[i] = begin + shift + a
            shift += len(piece) - (end - begin)
            moved[high + 1:] = starts[high + 1:] + shift
            out += [self.text[at:begin], piece]
            at = end
        out.append(self.text[at:])
        self.text, self.starts = "".join(out), moved.tolist()
        return self.text, skipped


def counter(tokenizer_path: str):
    encode = whole_text_encoder(tokenizer_path, 4).encode
    return lambda text: len(encode(text)) // 4


def build(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text, starts, nodes)``: each text with its segment starts and tree of token counts.

    A null text is held as an empty one. Repeated rows are held as often as given; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            rows, size, since = [], 0, 0
            for i, t in enumerate(b.column(1), 1):
                rows.append(EditedText.new(t.as_py() or "", count))
                size += len(rows[-1].text)
                if size >= BATCH_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).slice(since, i - since), pa.array([r.text for r in rows], pa.string()),
                        pa.array([r.starts for r in rows], pa.list_(pa.int32())), pa.array([r.tree.nodes for r in rows], pa.list_(pa.int32())),
                    ], ["key", "text", "starts", "nodes"])
                    rows, size, since = [], 0, i

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, text string, starts {_STATE}, nodes {_STATE}"
    )
    return got.withColumnRenamed("key", key)


def apply_edits(state: DataFrame, edits: DataFrame, tokenizer_path: str, key: str = "doc_id", with_state: bool = False) -> DataFrame:
    """``(key, text, n_before, n_tokens, n_edits, n_skipped, n_encoded)`` after one round of edits.

    ``with_state`` adds ``starts`` and ``nodes`` of the edited texts: written as a table, the result is the
    ``state`` of the next round, which encodes only what its own edits touch.

    ``edits`` is ``(key, start, end, replacement)`` in characters of the held text (a null place or key: no
    edit; a null replacement: none). Of several edits at one start the smallest by (end, replacement)
    counts, so a document has no more edits than places; of edits that overlap, the earlier counts.
    ``n_encoded`` is the number of characters that had to be encoded again. Documents without edits keep
    their counts. Edits of an unknown key do nothing; all rows with the key are edited.
    """
    one = edits.select(F.col(key).alias("edited"), F.col("start").cast("bigint"), F.col("end").cast("bigint"), F.coalesce("replacement", F.lit("")).alias("replacement"))
    one = one.where("edited IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL").groupBy("edited", F.greatest("start", F.lit(0)).alias("start")).agg(
        F.min(F.struct("end", "replacement")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    of = one.groupBy("edited").agg(F.sum("n").alias("given"), F.sort_array(F.collect_list(F.struct("start", "m.end", "m.replacement"))).alias("edits"))
    both = state.join(of, F.col(key) == F.col("edited"), "left").select(F.col(key).alias("key"), "text", "starts", "nodes", "edits", "given")
    kind = state.schema[key].dataType.simpleString()
    kinds = {"text": pa.string()} | dict.fromkeys(("before", "after", "edits", "skipped", "encoded"), pa.int64())
    more = ("starts", "nodes") if with_state else ()
    kinds |= dict.fromkeys(more, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for b in batches:
            out: dict[str, list] = {c: [] for c in kinds}
            size, since, columns = 0, 0, [b.column(i) for i in range(1, 6)]
            for i, row in enumerate(zip(*columns), 1):
                text, starts, nodes, edits_, given = (x.as_py() for x in row)
                held = EditedText(text, starts, SumTree.stored(nodes), count)
                before, new, skipped = held.tree.total(), text, 0
                if edits_:
                    new, skipped = held.apply([(e["start"], e["end"], e["replacement"]) for e in edits_])
                    skipped += given - len(edits_)
                for c, v in zip(out, (new, before, held.tree.total(), given or 0, skipped, held.encoded, held.starts, held.tree.nodes)):
                    out[c].append(v)
                size += len(new)
                if size >= BATCH_BYTES or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(since, i - since), *[pa.array(v, t) for v, t in zip(out.values(), kinds.values())]], ["key", *out]
                    )
                    out, size, since = {c: [] for c in out}, 0, i

    schema = f"key {kind}, text string, before bigint, after bigint, edits bigint, skipped bigint, encoded bigint"
    got = both.mapInArrow(run, ", ".join([schema, *[f"{c} {_STATE}" for c in more]]))
    return got.select(
        F.col("key").alias(key), "text", F.col("before").alias("n_before"), F.col("after").alias("n_tokens"), F.col("edits").alias("n_edits"),
        F.col("skipped").alias("n_skipped"), F.col("encoded").alias("n_encoded"), *more,
    )
