"""Texts with very long runs of white space are encoded as by the tokenizers library."""

import public_tokenizers
import pytest
from textloom.llm import packing
from tokenizers import Tokenizer


@pytest.mark.parametrize("space", [" ", "\n", "\t", "\u3000", " \n", "\x00", "x", "."])
def test_a_million(space):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a" + space * (1_000_000 // len(space)) + "b"
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
