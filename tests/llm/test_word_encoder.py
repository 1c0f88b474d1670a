"""The word-by-word encoder against the tokenizers library on whole texts."""

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlspan.llm import token_store

PATH = P.path("word_bpe_49k.json")
LIBRARY, WORDS = Tokenizer.from_file(PATH), token_store.WordEncoder(PATH)
PARTS = [*"aBz0 9.,!'&-\n\t", "é", "É", "ß", "ẞ", "ÿ", "Ÿ", "×", "µ", "ª", "́", "İ", "Σ", "\x1c", "\x85", "\xa0", "日", "😀", "don't ", "can'll", "10,0", "&&&", "word ", "###"]


def check(encoder, texts):
    got = [np.frombuffer(x, encoder.type).tolist() for x in encoder.encode(texts, 2)]
    assert got == [[*LIBRARY.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), min_size=1, max_size=4))
def test_equals_library(texts):
    check(WORDS, texts)


def test_cache_turns_over(monkeypatch):
    monkeypatch.setattr(token_store, "WORDS", 20)
    encoder = token_store.WordEncoder(PATH)
    for k in range(30):
        check(encoder, [" ".join(f"{a}{b}ét" for a in "abcdeÉ" for b in "xyz"[: 1 + k % 3]) + f" {'q' * k}. same, again!", "same again " + "long" * 40 + "!!"])
