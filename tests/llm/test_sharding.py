import zlib
from collections import Counter, defaultdict

import numpy as np

from edgelens.llm import sharding


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    return out


def test_law_sizes_and_slots(documents, prose):
    docs = [(i, prose(i, 20 + i % 90)) for i in range(900)]
    rows = sharding.shard(documents(docs, extra=True)).collect()
    texts = dict(docs)
    assert len(rows) == 900 and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()))
    shards = by_shard(rows)
    assert set(shards) == set(range(16))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    for total in (lambda r: r.size, lambda r: r.tokens, lambda r: 1):
        sums = np.array([sum(map(total, s)) for s in shards.values()])
        assert sums.max() < 1.04 * sums.mean()


def test_equal_texts_stay_together_unless_they_fill_half_a_shard(documents, prose):
    docs = [(i, prose(i % 300, 40)) for i in range(900)]
    rows = sharding.shard(documents(docs)).collect()
    assert all(len({r.shard for r in rows if r.doc_id % 300 == g}) == 1 for g in range(300))


def test_a_group_of_a_third_of_all_rows_is_split(documents, prose):
    docs = [(i if i < 1000 else 7, prose(0 if i % 3 == 0 else i, 40)) for i in range(1500)]
    sizes = [sum(r.size for r in s) for s in by_shard(sharding.shard(documents(docs)).collect()).values()]
    assert len(sizes) == 16 and max(sizes) < 1.2 * min(sizes)


def test_nulls_repeats_and_empty_tables(documents):
    docs = [(1, None), (1, None), (None, ""), (2, "é"), (2, "é"), (None, None), (3, "x" * 200_000)]
    rows = sharding.shard(documents(docs)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs
    )
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by_shard(rows).values())
    assert sharding.shard(documents([])).count() == 0


def test_items_go_where_the_dot_product_is_highest():
    items = np.array([[0.3, 0.1], [0.1, 0.3], [0.3, 0.1], [0.1, 0.3], [0.2, 0.2]])
    assert sharding.place(items, 2).tolist()[:4] == [0, 1, 1, 0]
