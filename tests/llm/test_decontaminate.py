import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from edgelens.llm import decontaminate as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - 12) if found else 0):
            windows[tuple(found[i : i + 13])].update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        found, hit, seen = words(text), [0] * len(words(text)), set()
        for n in {len(w) for w in windows}:
            for i in range(len(found) - n + 1):
                if (w := tuple(found[i : i + n])) in windows:
                    hit[i : i + n] = [1] * n
                    seen |= windows[w]
        digest = hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()
        out.append((doc, len(found), sum(hit), len(seen), digest, sum(hit) > 0 and 20 * sum(hit) >= len(found)))
    return sorted(map(str, out))


def as_rows(df):
    return sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


@pytest.fixture
def case(prose):
    rng = random.Random(3)
    items = [(i, prose(1000 + i, rng.randint(14, 60))) for i in range(12)]
    items += [(20, "short item"), (21, "one"), (10, prose(5, 30)), (22, None), (23, "!?"), (None, prose(6, 20)), (2, prose(7, 13)), (24, items[0][1])]
    docs = []
    for i in range(80):
        text = prose(i, rng.randint(0, 300))
        if i % 3 == 0:
            source = words(rng.choice(items)[1] or "")
            at = rng.randrange(max(1, len(source)))
            text = " ".join([text, "...".join(source[at : at + rng.randint(5, 40)]).upper(), prose(-i, 20)])
        docs.append((i, text))
    docs += [(80, None), (81, ""), (82, "SHORT--item"), (83, "one two"), (83, items[3][1]), (None, items[4][1]), (84, "w " * 50_000 + items[5][1])]
    docs += [(85, "naïve Élan ÉLAN " * 5)]
    return docs, items


def test_against_brute_force(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert as_rows(D.report(documents(docs, extra=True), bench)) == brute(docs, items)


def test_a_benchmark_of_many_blocks_gives_the_same(spark, documents, case, monkeypatch):
    docs, items = case
    monkeypatch.setattr(D, "BLOCK_BYTES", 9000)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert as_rows(D.report(documents(docs), bench)) == brute(docs, items)


def test_clean_keeps_whole_rows(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = documents(docs, extra=True)
    kept = D.clean(table, bench)
    assert kept.columns == table.columns
    left = sorted(str(r.doc_id) for r in kept.collect())
    assert left == sorted(row.split(",")[0][1:] for row in brute(docs, items) if row.endswith("False)"))


def test_a_passage_without_item_id_contaminates_and_names_no_item(spark, documents, prose, tmp_path):
    """Query, stage and check SQL agree on it."""
    import duckdb

    from edgelens.llm.oracle import DECONTAMINATE

    passage = prose(77, 30)
    bench = spark.createDataFrame([(None, passage), (1, prose(78, 20)), (None, "tiny one")], "item_id bigint, text string")
    docs = documents([(1, passage), (2, prose(79, 40)), (3, "a tiny one b")])
    rows = as_rows(D.report(docs, bench))
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    bench.coalesce(1).write.parquet(str(tmp_path / "b"))
    con = duckdb.connect()
    for name, path in (("documents", "d"), ("benchmark", "b")):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / path}/*.parquet'")
    want = con.execute(DECONTAMINATE).fetchall()
    assert rows == sorted(map(str, want)) and rows[0].startswith("(1, 30, 30, 0,")


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert as_rows(D.report(documents([(1, "a b")]), none)) == brute([(1, "a b")], [])
    assert D.report(documents([]), none).count() == 0
    assert D.clean(documents([]), none).count() == 0


@pytest.mark.parametrize("length", [1, 2, 3, 13])
def test_search_on_few_words(length):
    """A small vocabulary makes shared blocks, overlaps and repeats of all kinds."""
    rng = np.random.default_rng(length)
    rows = np.unique(rng.integers(1, 4, (30, length)).astype(np.int32), axis=0)
    ids = rng.integers(0, 4, 3000).astype(np.int32)
    ends, found = D.Patterns(rows, np.arange(len(rows), dtype=np.int32)).find(ids)
    want = {
        (i + length - 1, k)
        for i in range(len(ids) - length + 1)
        for k, row in enumerate(rows)
        if (ids[i : i + length] == row).all()
    }
    assert len(ends) == len(want) and set(zip(ends.tolist(), found.tolist())) == want
