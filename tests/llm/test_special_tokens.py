"""Literal special tokens in a text encode as the library encodes them by default."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sediment.llm.tokens import PieceEncoder


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_literal_special_tokens(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = []
    for special in ("<|endoftext|>", "<|startoftext|>"):
        texts += [f"see {special} here", special, f"a{special}b", f"{special} {special}\nx", f"see  {special}  here", f"\n{special}\n", f"{special}{special} a", f"a, {special}.", special[:-1]]
    assert [np.frombuffer(i, "<u4").tolist() for i in PieceEncoder(path).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
