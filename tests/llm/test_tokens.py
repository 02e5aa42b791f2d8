import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexikv.llm.tokens import TokenIds

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "a\x1cb", "é  \n\n x", "<|endoftext|>hi", "  lead", "tail \n", "İß ΑΣ Σ", "á ́b", "it's don't 'S", "\x01 a", "日本語 テスト", "a b", "x　y", "a\r\nb", "\n", " \x01 ", "Foo's bar,BAZ.qux", "a²b É.é ñ.\u0301x y\u0301.", "ÀÉ! ẞ. İ, ΑΣ. µm; ª. ÷z"]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library(name):
    library, own = Tokenizer.from_file(public_tokenizers.path(name)), TokenIds(public_tokenizers.path(name))
    for text, ids in zip(ODD, own.ids(ODD), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert own.ids([None]) == [b""]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab 's.\n\t1é\x01 "), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_any_text(name, texts):
    path = public_tokenizers.path(name)
    for text, ids in zip(texts, TokenIds.of(path).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TokenIds.of(path).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_encoded_in_parts(name, monkeypatch):
    from lexikv.llm import tokens

    monkeypatch.setattr(tokens, "_SPAN", 50)
    own = TokenIds(public_tokenizers.path(name))
    for text in ["one two  three\nfour, five-six " * 40, "été \x85 word end\u200b next word " * 30, "x" * 5000, "a b " * 300 + "<|endoftext|> c d" * 20]:
        assert len(own._spans(text)) > 1 or " " not in text
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_kept_chunks_are_bounded(monkeypatch):
    from lexikv.llm import tokens

    monkeypatch.setattr(tokens, "_KEEP_BYTES", 20_000)
    own = TokenIds(public_tokenizers.path(FILES[0]))
    for k in range(20):
        own.ids([" ".join(f"w{k}x{i}" for i in range(100))])
        assert len(own._kept) < 400


@pytest.mark.parametrize("seed", ["0", "1", "2"])
def test_ids_do_not_depend_on_the_order_of_chunks(seed):
    """Under seed 1 a mark once joined blank chunks and still gave the right number of marks."""
    import os
    import subprocess
    import sys

    check = "from tests.llm.test_tokens import *\nfor name in FILES: test_ids_equal_the_library(name)"
    subprocess.run([sys.executable, "-c", check], check=True, env=os.environ | {"PYTHONHASHSEED": seed})
