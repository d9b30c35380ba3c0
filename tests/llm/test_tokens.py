"""Ids of texts cut into pieces equal the library's, on white space and added tokens of every kind."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sediment.llm.tokens import PieceEncoder

_SPACES = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​"]
_PIECES = [*_SPACES, " ", "\n", "a", "Zeta", "don't", "it's", "'re", "x's'", "42", "3.14", "--", "!!", "(a)", "naïve", "ÄÖ", "漢字", "かな", "😀", "é", "é", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "_", "İ", "ß", "�", "\x00"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    path = public_tokenizers.path(name)
    library, rng = Tokenizer.from_file(path), random.Random(2)
    texts = ["".join(t) for n in range(5) for t in itertools.product(_SPACES[:8], repeat=n)] if name.startswith("byte") else ["".join(t) for n in range(4) for t in itertools.product(_SPACES, repeat=n)]
    texts += ["".join(rng.choice(_PIECES) for _ in range(rng.randrange(1, 12))) for _ in range(30_000)]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    found = [np.frombuffer(i, "<u4").tolist() for i in PieceEncoder(path).encode(texts)]
    wrong = [t for t, a, b in zip(texts, found, expected, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:5])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_few_remembered_pieces_give_the_same_ids(name, monkeypatch):
    """What is remembered is bounded, also within one call, and changes no ids."""
    from sediment.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_PIECES", 20)
    monkeypatch.setattr(tokens, "RECENT_PIECES", 7, raising=False)
    path, rng = public_tokenizers.path(name), random.Random(3)
    texts = [" ".join(rng.choice(["Word", "naïve,", "42", "it's", "(a)", "x" * 150]) + rng.choice("abcdefgh.,") for _ in range(40)) for _ in range(50)]
    encoder, sizes = PieceEncoder(path), []
    learn = encoder._learn
    encoder._known._learn = lambda piece: sizes.append(len(encoder._known)) or learn(piece)
    assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert max(sizes) == 20 and len(encoder._known._recent) <= 7
