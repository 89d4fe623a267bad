"""Ids of odd words are those of tokenizers, and equal words are looked up once for all their cases and marks."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from ledgerlens.llm import packing

ODD = ["a", "B", "h", "H", "Word", "the", "ß", "É", "ö", "œ", "İ", "ı", "Σ", "ς", "ẖ", "×", "÷", "·", "̱", "́", "̇", "̊", "中", "x" * 25, "Y" * 24, " ", " ", " ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "\x00", ".", ",", "!", "'", "'s", "'LL", "-", "’", "—", "&&&", "#" * 9, "1", "23", "²", "_", "|", "<", "<|endoftext|>", "<|ENDOFTEXT|>", "🙂"]


def test_ids_of_odd_words_and_what_is_looked_up(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(0, 14))) for _ in range(4000)] + [None, "", " "]
    monkeypatch.setattr(packing, "CACHE", 500)
    monkeypatch.setattr(packing, "BLOCK_WORDS", 300)
    encoder = packing.Encoder(packing.default_tokenizer(), 1)
    for step in (7, 500):
        for k in range(0, len(texts), step):
            some = texts[k : k + step]
            ids, counts = encoder.encode(pa.array(["before", *some], pa.string())[1:])
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in some]

    asked = []
    monkeypatch.setattr(packing.Encoder, "word", lambda self, word, f=packing.Encoder.word: asked.append(word) or f(self, word))
    texts = [f"{w}{m}" for w in ("Thing", "thing", "THING", "chauß", "Chauß") for m in ("", ".", ",", "!!", "&&&", ".")]
    ids, counts = packing.Encoder(packing.default_tokenizer(), 1).encode(pa.array([" ".join(texts)] * 3))
    assert len(asked) == 6 and counts.tolist() == [len(ids) // 3] * 3
