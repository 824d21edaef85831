import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edgelens.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None,
    "",
    " ",
    "Hello  world, it's we'll I'D 12 345!!  \n\n\t end ",
    "<|endoftext|>",
    "a<|endoftext|>b <|endoftext|><|endoftext|> <|endoftext",
    "naïve café Ünïcödé ßß Ελλάδα Привет",
    "漢字かな交じり文 ① ½ ² ՘ x y　z 👩‍👩‍👧 é ﻿",
    "x" * 5000 + " " * 3000 + "\n" * 100,
    "The quick brown fox " * 2000,
    "word" + "\x00\x01\x7f" + "\r\n",
]


def test_counts_are_the_librarys(documents, prose):
    texts = TEXTS + [prose(i, 40 * i) for i in range(20)]
    tokenizer = Tokenizer.from_file(PATH)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.token_counts(documents(list(enumerate(texts)), extra=True), PATH).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {
        (i, len((t or "").encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, want))
    }
    assert any(n > 512 for n in want)


def test_rare_pieces_meet_their_counts_in_the_join(documents, prose, monkeypatch):
    monkeypatch.setattr(token_counts, "HEAD", 5)
    texts = [prose(i % 7, 50) for i in range(30)] + TEXTS
    tokenizer = Tokenizer.from_file(PATH)
    got = token_counts.token_counts(documents(list(enumerate(texts))), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {
        i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)
    }


def test_every_character_splits_as_in_the_library():
    tokenizer = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as file:
        parts = token_counts.pre_tokens(file.read())
    for code in [*range(0xD800), *range(0xE000, 0x3000 + 0xE000), *range(0x1F000, 0x20000)]:
        text = f"a{chr(code)}1 {chr(code)}!"
        want = [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert parts(text)[0] == want, hex(code)


def test_repeats_nulls_and_empty_tables(documents):
    got = token_counts.token_counts(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("None", 1)]
    assert token_counts.token_counts(documents([]), PATH).count() == 0


def test_other_tokenizers_are_refused(documents):
    with pytest.raises(ValueError):
        token_counts.token_counts(documents([(1, "a")]), public_tokenizers.path("word_bpe_49k.json"))
