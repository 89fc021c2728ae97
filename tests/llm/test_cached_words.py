"""What the cached encoders keep, and for how long."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

from chromaspark.llm import bpe


def test_a_word_between_spaces_is_kept_once_and_not_after_the_task(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    mine = bpe.WordBpe(path)
    assert mine.encode("zebra Zebra zebra, zebra") == mine.encode("zebra") * 2 + mine.encode("zebra,") + mine.encode("zebra")
    mine = bpe.WordBpe(path)
    mine.encode("zebra lion")
    assert set(mine.pieces) == {"zebra", "lion"} and not mine.words

    held = {}

    class Docs:
        def select(self, *a):
            return self

        schema = [spark.range(1).schema[0]]

        def mapInArrow(self, run, schema):
            held["rows"] = sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["zebra lion", None])], ["key", "text"])])))
            return self

        def withColumnRenamed(self, *a):
            return self

    bpe.encode_decode(Docs(), path)
    kept = bpe.word_bpe(path)
    assert held["rows"] == 2 and not kept.pieces and not kept.words and not kept.pieces.old
