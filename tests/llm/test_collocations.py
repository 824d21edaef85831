import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from edgelens.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _plain(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for k in range(1, longest + 1):
                f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = any(
                100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
                if len(q) > len(p)
            )
            if not inside:
                cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return out


def _rows(seed, n, vocabulary=12):
    rng = random.Random(seed)
    words = ["A", "b", "Cc", "d\x01", "d", "é", "日本", "Éf", "(g)", "h'", "i-j", "a\x01"][:vocabulary]
    joins = [" ", "  ", "\t", " ", " ", " ", ". ", "\n", ", ", " ;"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([text, text, text, None])))
    return rows + [("en", "new york city hall. new york city hall!")] * 12 + [("en", None), (None, "")]


def _got(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    df = df.selectExpr("*", "1 as w1", "2 as n", "3 as f", "'x' as words", "4 as key")
    return {tuple(r) for r in C.collocations(df, **options).collect()}


@pytest.mark.parametrize("seed,ranges", [(1, None), (2, 1), (3, 40)])
def test_same_as_counting_everything(spark, seed, ranges):
    rows = _rows(seed, 300)
    want = _plain(rows)
    assert len(want) > 30
    assert _got(spark, rows, ranges=ranges) == want


def test_other_lengths_and_limits(spark):
    rows = _rows(4, 80, 6)
    for options in ({"longest": 2, "least": 5}, {"longest": 4, "least": 3, "share": 80, "top": 7}):
        assert _got(spark, rows, ranges=9, **options) == _plain(rows, **options)


def test_small_chunks_and_a_full_filter_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_WORDS", 50)
    monkeypatch.setattr(C, "HELD", 20)
    monkeypatch.setattr(C, "BATCH_ROWS", 7)
    monkeypatch.setattr(C, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(C, "BITS_EACH", 1)
    rows = _rows(5, 200)
    assert _got(spark, rows) == _plain(rows)


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "HASH_BITS", 20)
    rows = _rows(7, 200)
    assert _got(spark, rows) == _plain(rows)


def test_one_word_begins_and_ends_most_phrases(spark):
    rng = random.Random(6)
    rows = [("en", " ".join(f"the {rng.choice('abcdefghijklmnopqrst')}" for _ in range(200))) for _ in range(30)]
    assert _got(spark, rows, ranges=25) == _plain(rows)


def test_phrases_of_a_chunk():
    chunk = C._Chunk()
    chunk.add("en", b"x y z x y z. x y")
    stored = C._Stored(*(column[0].as_py() for column in chunk.row().columns))
    at, codes = stored.places(3, np.full(16, ~np.uint64(0)))
    assert len(at) == len(codes) == 4 and len(set(codes.tolist())) == 3
    columns, n = stored.counted(at, 3)
    assert sorted(zip(*(c.tolist() for c in columns), n.tolist())) == [(1, 2, 3, 2), (2, 3, 1, 1), (3, 1, 2, 1)]


def test_held_hashes_take_little_memory():
    """What a task counts before it passes it on; two such workers share 3,000 MB with a JVM."""
    held, rng = C._HashCounts(), np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, 1 << C.HASH_BITS, 700_000, np.uint64)) for _ in range(6)]
    passed = 0
    tracemalloc.start()
    try:
        for part in parts:
            if held.add(part, np.ones(len(part), np.int64)):
                passed += int(held.fold()[1].sum())
                held.__init__()
        passed += int(held.fold()[1].sum())
        assert tracemalloc.get_traced_memory()[1] < 100_000_000
    finally:
        tracemalloc.stop()
    assert passed == sum(map(len, parts))


def test_distinct_hashes_are_folded_a_few_times(monkeypatch):
    monkeypatch.setattr(C, "HELD", 100)
    held, folds = C._HashCounts(), []
    fold = held.fold
    held.fold = lambda: folds.append(1) or fold()
    for start in range(0, 10_000, 10):
        held.add(np.arange(start, start + 10, dtype=np.uint64), np.ones(10, np.int64))
    assert len(fold()[0]) == 10_000 and len(folds) < 10


def test_whole_numbers_of_any_size(spark):
    big = 3 * 10**15
    rows = [("en", ["a", "b"], big, big + 1, None, big + 7, None)]
    ddl = "lang string, words array<string>, f bigint, left_1 bigint, left_2 bigint, right_1 bigint, right_2 bigint"
    got = C._scored(spark.createDataFrame(rows, ddl), 3).first()
    assert got.score == 10**6 * big * big // ((big + 1) * (big + 7))


def test_empty_tables(spark):
    assert _got(spark, [("en", "a b")] * 3) == set()
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).count() == 0
