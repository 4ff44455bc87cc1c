"""Added tokens of a tokenizer file within texts."""

import numpy as np

from formwright.llm import packing
from formwright.llm.queries import tokenizer


def test_added_token_in_text():
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["one <|endoftext|> two", "one<|endoftext|>two", "<|endoftext|>", "<|endoftext|>\n\nnext <|endoftext", "one two", "<|endoftext|> <|endoftext|>"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encode(texts, path)]
    assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert got[0] == [505, 220, 50256, 734]
