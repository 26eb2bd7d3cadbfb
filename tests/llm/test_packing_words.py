"""Word ids of the packing operator against the whole tokenizer."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from exposure.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
MARKS = ("'s", "'ll", "'D", "<|endoftext|>", "é", "É", "Ÿ", "İ", "ŉ", "ſ", "ƀ", "Ω", "中", "́", "­", "½", "²", "ª", "\u0085", " ", "\x00", "\x1c")


def whole(words: packing.WordIds, text: str) -> bytes:
    return np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_words_have_the_ids_of_the_whole_tokenizer():
    words, rng = packing.WordIds(PATH), random.Random(5)
    letters = [*"abcxyzAZ019'.,<>|-_\" ", *MARKS]
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        assert packing.token_bytes(text.encode(), words) == whole(words, text), repr(text)


def test_latin_words_with_punctuation_need_no_whole_tokenizer():
    words = packing.WordIds(PATH)
    texts = ["aique&&&", "Éllere", "ción.", "don't", "a-b", "12,5", "(x)"]
    wanted = [whole(words, t) for t in texts]
    words.tokenizer = None
    assert [packing.token_bytes(t.encode(), words) for t in texts] == wanted
