"""The counter of pre-tokens against the library on whole texts."""

import public_tokenizers
import pytest

from corpusloom.llm import token_cache

TEXTS = ["", " ", "Two words", "\x00\x7f\xa0 \xad\t\n", "<|endoftext|> a", "\U0001f600\u00e9\u4e2d\u6587  ", "a" * 5000, " " * 3000 + "x", "\u00e9" * 200, "it's 12.5%\r\n"]


@pytest.mark.parametrize("memo", [token_cache.MEMO, 1])
def test_counts_as_the_library(monkeypatch, memo):
    monkeypatch.setattr(token_cache, "MEMO", memo)  # with 1 the memo's generations change at every text
    count = token_cache.JsonCounter(public_tokenizers.path("byte_bpe_50k.json"))
    assert count.by_piece
    for text in TEXTS * 2:
        assert count(text) == (count.whole(text) if text else 0)
