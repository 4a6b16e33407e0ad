import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkfold.llm.tokens import TextEncoder

PARTS = st.sampled_from([" ", "  ", "\n", "\n\n", " \n", "\t", "\x1c", "\x85", "\xa0", " ", "a", "the", "Don't", "é", "é", "日本", "😀", "12", "...", "<|endoftext|>", "<|startoftext|>", "É", "ÿ", "×", "Straße", "ABC", "naïve,", "x1y22", "²", "°", "Ω", "ς", "<|", "I'll", "_", "​", "\r\n"])


@pytest.mark.parametrize(("file", "space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_equals_the_library(file, space):
    path = public_tokenizers.path(file)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    own = TextEncoder(path, space, cache_words=40)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(PARTS, max_size=12))
    def check(parts):
        text = "".join(parts)
        assert own.batch([text], 2)[0].tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2]

    check()


def test_nulls_and_long():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = TextEncoder(path, True)
    lib = Tokenizer.from_file(path)
    long = "word other\nline " * 20_000 + "x" * 5_000
    got = own.batch([None, "", long])
    assert [len(x) for x in got[:2]] == [0, 0]
    assert np.array_equal(got[2], lib.encode(long, add_special_tokens=False).ids)


def test_long_texts_go_piece_by_piece(monkeypatch):
    from inkfold.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_BYTES", 1_000)
    for file, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = public_tokenizers.path(file)
        own, lib = TextEncoder(path, space, cache_words=300), Tokenizer.from_file(path)
        long = " ".join(f"Wort{i % 97}é, don't" + ("\nnext" if i % 5 == 0 else "") for i in range(3_000)) + " " + "y" * 4_000 + " end"
        assert np.array_equal(own.batch([long, "short one"])[0], lib.encode(long, add_special_tokens=False).ids)


def test_other_tokenizers_go_by_words(tmp_path):
    import json

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        d = json.load(f)
    d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+|[^\s\p{L}]+"
    (tmp_path / "other.json").write_text(json.dumps(d))
    own, lib = TextEncoder(str(tmp_path / "other.json"), False), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert own.parted is None
    text = "Ab1 22 it's, é£x"
    assert own.batch([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
