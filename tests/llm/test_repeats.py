import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from edgelens.llm import repeats


def brute(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(documents, rows):
    want = Counter((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows])))
    got = repeats.report(documents(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(r.has_repeats == (r.n_removed > 0) for r in got)
    return sum(k[2] * n for k, n in want.items())


def random_text(rng, n, letters="abcdefgh ijklmnop"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_passages_of_all_lengths(documents):
    rng = random.Random(5)
    base, rows = random_text(rng, 3000), []
    for i in range(50):
        at, n = rng.randrange(2400), rng.randrange(300, 900)
        rows.append((i, random_text(rng, rng.randrange(600)) + base[at : at + n] + random_text(rng, rng.randrange(600))))
    rows += [(100, base), (100, base), (None, base[:401]), (101, None), (102, ""), (103, base[:500] * 2)]
    assert same(documents, rows) > 10_000


def test_exactly_400_bytes_and_one_less(documents):
    rng = random.Random(6)
    p, q = random_text(rng, 400), random_text(rng, 399)
    rows = [(i, random_text(rng, 90) + f"{i}{p}{i}" + random_text(rng, 91) + f"{i}{q}{i}" + random_text(rng, 50)) for i in range(3)]
    assert same(documents, rows) == 1200


def test_runs_periods_and_multibyte_text(documents):
    rng = random.Random(7)
    rows = [(1, "a" * 1000), (2, "a" * 399), (3, "b" * 400), (4, "b" * 400), (5, "Orre " * 300), (6, "xOrre " * 200)]
    rows += [(7, "ab" * 500 + random_text(rng, 50) + "ab" * 300), (8, "ö" * 700), (9, "漢字" * 200 + random_text(rng, 30))]
    rows += [(10, "".join(f"{w} " * 7 for w in random_text(rng, 900).split()))] * 2
    same(documents, rows)


def test_a_common_passage_among_many_different_edges(documents):
    rng = random.Random(8)
    passage = random_text(rng, 700)
    rows = [(i, random_text(rng, 40, "xyz") + passage + random_text(rng, 40, "xyz")) for i in range(120)]
    assert same(documents, rows) >= 120 * 700


def test_splits_may_change_between_the_passes(spark, documents, monkeypatch):
    """Cores that come or go let Spark split the files anew."""
    conf = "spark.sql.files.minPartitionNum"
    rng = random.Random(10)
    passage = random_text(rng, 500)
    rows = [(i, random_text(rng, 100 + 40 * i) + passage + random_text(rng, 30)) for i in range(12)]
    settle = repeats.settle

    def settle_on_other_splits(nodes):
        spark.conf.set(conf, "100")
        return settle(nodes)

    monkeypatch.setattr(repeats, "settle", settle_on_other_splits)
    spark.conf.set(conf, "1")
    try:
        assert same(documents, rows) >= 12 * 500
    finally:
        spark.conf.unset(conf)


def test_empty_tables(documents):
    assert repeats.report(documents([])).count() == 0
    assert same(documents, [(1, "short")]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_every_string_belongs_to_one_node(seed):
    """Parsing covers each string of each text once, whatever the triggers."""
    rng = random.Random(seed)
    texts = [random_text(rng, rng.choice([0, 10, 399, 400, 401, 3000]), "ab" if seed % 2 else "abcdefg") for _ in range(8)]
    texts += ["a" * 900, "ab " * 500]
    buffer, starts, ends = repeats._side_by_side([t.encode() for t in texts])
    b, lo, hi = repeats.parse(buffer, starts, ends)
    covered = np.concatenate([np.arange(x - h, x - n + 1) for x, n, h in zip(b, lo, hi)])
    want = [i for s, e in zip(starts, ends) for i in range(s, e - 399)]
    assert sorted(covered.tolist()) == want
    for size in repeats.SIZES:
        whole, at, low, high, grid = repeats.cut(b, lo, hi, size)
        assert ((low >= grid) & (high < grid + size)).all()
        assert int((high - low + 1).sum()) == len(want)


def test_triggers_hang_on_their_bytes_alone(monkeypatch):
    rng = random.Random(9)
    text = random_text(rng, 5000).encode()
    sparse, dense = repeats.trigger_places(text)
    assert set(sparse.tolist()) <= set(dense.tolist()) and len(dense) > len(sparse) > 30
    monkeypatch.setattr(repeats, "HASHED", 777)
    assert repeats.trigger_places(text)[1].tolist() == dense.tolist()
    inner = repeats.trigger_places(text[1003:4000])[1] + 1003
    assert inner.tolist() == [p for p in dense.tolist() if 1003 <= p <= 4000 - repeats.GRAM]
