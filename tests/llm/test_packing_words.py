"""Words of packing: the ids are the tokenizer's own, and a word that keeps coming back is looked up once."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from screenwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(4)
    odd = ["The", "don't", "O'Neil's", "STRASSE", "Straße", "ÉCOLE,", "×÷", "İΣ", "J̌", "Å", "K", "µª", "²½", "日本", "“so”", "a—b"]
    odd += ["<|endoftext|>", "x<|startoftext|>Y", "<|ENDOFTEXT|>", "</w>", "\t", "\r\n", "\x0b\x0c", "\x85", "\xa0", "\xad", "\x00\x1c", "42.5%", "(a_b)", "\U0001f600"]
    texts = [None, "", " ", "\n"] + ["".join(rng.choice([*odd, " ", "\n", "e", ","]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 255), rng.randint(32, 126), 32])) for _ in range(60)) for _ in range(400)]
    words, whole = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for kind in (pa.string(), pa.large_string()):
        for first in range(0, len(texts), 97):
            part = pa.array(texts, kind).slice(first, 97)
            want = [whole.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
            assert [ids.tolist() for ids in words.of(part)] == want


def test_a_word_that_comes_back_is_looked_up_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 100)
    words, asked = packing.WordIds(PATH), []
    spelled = words.spelled
    words.spelled = lambda new: asked.append(new) or spelled(new)
    rng = random.Random(7)
    common = ["".join(rng.choice("aeioulmnrst") for _ in range(6)) for _ in range(20)]
    for k in range(40):
        rare = [f"{a}{b}qx{'z' * k}" for a in "abcde" for b in "klmno"]
        texts = [" ".join([*common, *rare]), " ".join(f"({w.capitalize()}, {w.upper()}." for w in common)]
        words.of(pa.array(texts))
        assert len(words.memory) <= 100
    assert len(asked) == 40
    new = [word for words in asked for word in words]
    assert all(new.count(word) == 1 for word in {*common, "(", ",", "."})
    assert len(new) == len(set(new))
