"""Words of packed texts: work grows with the new words, ids are the tokenizer's, with and without room in the cache."""

import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import best_fit_packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_known_words_are_looked_up_once():
    words, text = best_fit_packing.Words(PATH), "one two three. four " * 5000
    text += "end"
    words.ids(text)
    calls = 0

    def count(frame, event, what):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        words.ids(text + " unseen")
    finally:
        sys.setprofile(None)
    assert calls < 200  # 20,002 words, one of them new


@pytest.mark.parametrize("cached", [0, 3, 1000])
def test_ids_whatever_the_room(monkeypatch, cached):
    monkeypatch.setattr(best_fit_packing, "CACHED", cached)
    whole, words = Tokenizer.from_file(PATH), best_fit_packing.Words(PATH)
    for text in ("a b, b, b A Éa! x1 12 don't", " a b", "a  b b", "a b ", "a\n b\tc d  e", " ", "", "q w </s> e </s>r", "b, b, new\nline b,"):
        for _ in range(2):
            assert words.ids(text) == best_fit_packing._packed(whole.encode(text, add_special_tokens=False).ids), text
            assert len(words.known) <= cached
