import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from edgelens.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None,
    "",
    " ",
    "  two  spaces ",
    "Hello world, it's <|endoftext|> and <s> </s> <unk> [INST]",
    "naïve café 漢字かな ① 👩‍👩‍👧 \x00\x01\r\n",
    "▁ lower ▁one eighth block",
    "x" * 3000,
    "﻿ﬁ　x",
]



def _plain(texts):
    """The report, token by token."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(c): c for c in shown}
    alphabet |= {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    rows, corpus = [], Counter()
    for text in texts:
        spaced = " " + (text or "")
        found = a.encode(spaced, add_special_tokens=False)
        left = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        right = [(i, of_b(i)) for i in b.encode(text or "")]
        if not text or any(b"".join(t for _, t in side) != spaced.encode() for side in (left, right)):
            rows.append(None)
            continue
        ends = []
        for side in (left, right):
            at, of_side = 0, {}
            for place, (i, t) in enumerate(side):
                at += len(t)
                of_side[at] = (place, i)
            ends.append(of_side)
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e][1], ends[1][e][1]) for e in common]
        groups, last = [], (0, 0)
        for e in common:
            here = ends[0][e][0] + 1, ends[1][e][0] + 1
            ids = [",".join(str(i) for i, _ in side[x:y]) for side, x, y in zip((left, right), last, here)]
            groups.append("|".join(ids))
            last = here
        corpus.update(links)
        rows.append((len(left), len(right), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, j), n in corpus.items():
        highest[j] = max(highest[j], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        *sizes, links, groups = row
        best = sum(corpus[l] == highest[l[1]] for l in links)
        total = sum(corpus[l] for l in links)
        out.append((*sizes, len(links), best, total, hashlib.sha256(groups.encode()).hexdigest()))
    return out


def _got(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return {r.doc_id: tuple(r[c] for c in names) for r in alignment.report(df, A, B).collect()}


@pytest.fixture(scope="module")
def texts():
    import random

    rng = random.Random(3)
    words = "the of and naïve über café Straße 12,345 don't foo_bar (x) antidisestablishmentarianism 東京 é́".split()
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(60)]
    return ODD + prose + prose[:5]


def test_same_as_token_by_token(documents, texts):
    assert _got(documents(list(enumerate(texts)), parts=4, extra=True)) == dict(enumerate(_plain(texts)))


def test_many_small_chunks_streams_and_rounds(documents, texts, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 60)
    monkeypatch.setattr(alignment, "HELD", 10)
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    monkeypatch.setattr(alignment, "TASK_RECORDS", 50)
    monkeypatch.setattr(alignment, "KNOWN", 20)
    assert _got(documents(list(enumerate(texts)), parts=6)) == dict(enumerate(_plain(texts)))


def test_groups_give_the_text_back(documents, texts):
    tokenizer = Tokenizer.from_file(A)
    rows = alignment.alignments(documents(list(enumerate(texts))), A, B).collect()
    there = 0
    for row in rows:
        text = texts[row.doc_id]
        if row.groups:
            there += 1
            assert tokenizer.decode([i for g in row.groups for i in g.a], skip_special_tokens=False) == " " + text
            assert row.groups[-1].end == len((" " + text).encode())
            assert all(g.a and g.b for g in row.groups)
    assert there > 50


def test_one_text_makes_up_most_rows(documents):
    texts = ["the same text again"] * 300 + [f"other {i}" for i in range(40)]
    assert _got(documents(list(enumerate(texts)), parts=5)) == dict(enumerate(_plain(texts)))


def test_parts_encode_like_the_whole_text():
    """Every character beside blanks and line breaks; nothing merges over the places of the cuts."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        sides = alignment.Sides(a.read(), b.read())
    codes = [*range(1, 0x2100), 0x2581, 0x3000, 0xFEFF, 0xAC00, 0x1F600]
    marks = [" a", "a ", " ", "  ", "\n", "\n ", " \n", "'s", " 's", "1 2", "!? "]
    texts = [f" x{chr(c)}{m}{chr(c)} {chr(c)}\n{chr(c)}y{m}" for c in codes for m in marks[c % 4 :: 4]]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [ids.tolist() for ids in sides.encode_a(texts)] == want


def _sides():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return alignment.Sides(a.read(), b.read())


def test_b_encodes_parts_like_the_whole_text():
    sides = _sides()
    codes = [*range(1, 0x2100), 0x2581, 0x3000, 0xFEFF, 0xAC00, 0x1F600]
    marks = [" a", "a ", " ", "  ", "\n", "\n ", " \n", "'s", " 's", "1 2", "!? ", "\t", "x  \n\n  y"]
    texts = [f"x{chr(c)}{m}{chr(c)} {chr(c)}\n{chr(c)}y{m}" for c in codes for m in marks[c % 4 :: 4]]
    there = 0
    for text, found in zip(texts, sides.align(texts), strict=True):
        want = sides.b.encode(text)
        if b"".join(map(sides.b_bytes.__getitem__, want)) != (" " + text).encode():
            assert found is None
            continue
        groups = found.groups(sides.a_sizes)
        assert [i for _, _, b in groups for i in b] == want and found.n_b == len(want)
        assert groups[-1][0] == len((" " + text).encode())
        there += 1
    assert there > 20_000


def test_a_part_meets_both_tokenizers_once():
    sides, seen = _sides(), []
    b = sides.b

    class Counting:
        def encode(self, text, **options):
            seen.append(text if isinstance(text, str) else "".join(text))
            return b.encode(text, **options)

    sides.b = Counting()
    assert len(list(sides.align(["the same words again and again"] * 100))) == 100
    assert sum(map(len, seen)) < 100


def test_long_parts_are_not_kept_without_limit(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_CHARACTERS", 1000)
    sides = _sides()
    for i in range(20):
        list(sides.align([f"{i}漢字" * 100]))
    assert sum(map(len, sides.parts)) < 3000


def test_texts_that_cannot_be_cut_are_encoded_whole(documents, texts, monkeypatch):
    monkeypatch.setattr(alignment, "_cuts", lambda model: False)
    assert _got(documents(list(enumerate(texts)), parts=4)) == dict(enumerate(_plain(texts)))


def test_b_is_cut_only_where_no_piece_lies_over_the_place():
    model = sentencepiece_model_pb2.ModelProto()
    with open(B, "rb") as b:
        model.ParseFromString(b.read())
    assert alignment._cuts(model.SerializeToString())
    model.pieces[1000].piece = "of▁the"
    assert not alignment._cuts(model.SerializeToString())
    model.pieces[1000].piece = "▁the"
    model.normalizer_spec.remove_extra_whitespaces = True
    assert not alignment._cuts(model.SerializeToString())


def test_heap_merge_sums_streams():
    streams = [(np.array([1, 5, 9]), np.array([1, 2, 3])), (np.array([5, 10]), np.array([10, 4])), (np.array([0]), np.array([7]))]
    keys, sums = alignment.heap_merged([alignment._packed_counts(k, s) for k, s in streams])
    assert (keys.tolist(), sums.tolist()) == ([0, 1, 5, 9, 10], [7, 1, 12, 3, 4])


def test_repeats_nulls_and_empty_tables(documents):
    got = alignment.report(documents([(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), A, B).collect()
    assert sorted((str(r.doc_id), r.n_a, r.n_best) for r in got) == [("1", 2, 2), ("1", 2, 2), ("2", 0, 0), ("None", 1, 1)]
    assert alignment.report(documents([]), A, B).count() == 0
    assert alignment.report(documents([(1, None), (2, "")]), A, B).count() == 2
