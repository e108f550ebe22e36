"""The memoised encoder gives the library's ids."""

import random

import numpy as np
import public_tokenizers

from textforge.llm import token_files


def test_encoder_equals_library(monkeypatch):
    monkeypatch.setattr(token_files, "LEARN", 7)
    monkeypatch.setattr(token_files, "MEMO", 500)
    encoder = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = ["a", "b", "é", " ", " ", "  ", "\n", "\t", "\r", " ", " ", "'s", "'", "12", ".", "!", "日", "<|endoftext|>", "Ġ", "😀"]
    rng = random.Random(1)
    texts = ["", " ", "\n"] + ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(5000)]
    for lo in range(0, len(texts), 200):
        some = texts[lo : lo + 200]
        plain = encoder.tokenizer.encode_batch(some, add_special_tokens=False)
        assert encoder.encode_batch(some) == [np.array(x.ids, dtype="<u4").tobytes() for x in plain]
