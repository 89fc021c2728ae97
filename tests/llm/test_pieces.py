"""The cached encoder beside whole texts and line breaks."""

from __future__ import annotations

import random

import public_tokenizers

from chromaspark.llm.pieces import WholeTextEncoder, whole_text_encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_lines_equal_the_library():
    bits = ["a", "the", "É", "12", "٣", "½", " ", "\n", "\n\n", ".", ",", "!?", "'s", "\t", "\x85", "<|endoftext|>", "x-y", "中", "&*"]
    encoder, rng = WholeTextEncoder(BYTES, 4, room=50), random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 12)))
        assert encoder.encode(text) == encoder.ids(text)


def test_line_breaks_and_numbers_need_no_whole_encoding():
    encoder, asked = WholeTextEncoder(BYTES, 4), []
    text = " ".join(["go", *[f"{a}x{b}.\nThen {n}," for n, (a, b) in enumerate(zip("abcdefgh", "ijklmnop"))]])
    want, plain = encoder.ids(text), encoder.ids
    encoder.ids = lambda t: asked.append(t) or plain(t)
    assert encoder.encode(text) == want
    assert sorted(asked) == [",", ".", "go"]


def test_tasks_of_a_worker_share_an_encoder():
    first = whole_text_encoder(BYTES, 2)
    first.encode("some words are met again")
    again = whole_text_encoder(BYTES, 2)
    assert again is first and "words" in again.pieces
