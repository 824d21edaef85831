"""The pipeline's stages, each against a plain statement of what it should keep."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from edgelens.llm import catalog

from .test_decontaminate import brute as contaminated_rows
from .test_simhash import plain_print, reachable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def folder(spark, tmp_path, prose):
    rng, rows, labels = random.Random(9), [], []
    items = [(i, prose(5000 + i, 40)) for i in range(5)]
    for i in range(400):
        text, good = prose(i if i % 10 else i // 100, rng.randint(30, 60) if i % 10 else 50), i % 7 != 0
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 11 == 0:
            text += " " + items[i % 5][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    path = str(tmp_path / "data")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items, dict((i, g) for i, g, _ in labels)


def test_each_stage_on_what_its_predecessor_kept(spark, folder, tmp_path):
    path, items, good = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen[name] = (before, docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
            assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in before}
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert sum((r.doc_id in kept) == bool(good[r.doc_id]) for r in before) >= 0.97 * len(before)
    before, after = seen["near duplicates"]
    prints = {r.doc_id: plain_print(r.text) for r in before}
    firsts = reachable(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert sorted(r.doc_id for r in after) == sorted(set(firsts.values())) and len(after) < len(before)
    before, after = seen["decontamination"]
    clean = [r for r in contaminated_rows([(r.doc_id, r.text) for r in before], items) if r.endswith("False)")]
    assert sorted(str(r.doc_id) for r in after) == sorted(r.split(",")[0][1:] for r in clean) and len(after) < len(before)
    before, after = seen["mixing"]
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert words(after) == pytest.approx(1.5 * words(before), rel=0.02)
    before, after = seen["sharding"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.drop("slot", "shard").collect())) == sorted(str(r) for r in docs.drop("slot", "shard").collect())


def test_stages_take_odd_rows_and_empty_tables(spark, folder):
    path, *_ = folder
    rows = [(1, "a b c d", "en", None, 3)] * 2 + [(None,) * 5, (None, "", "xx", "s", 0), (2, "A b C d", None, "s", 9)]
    rows.append((3, "word " * 50_000, "en", "s", 1))
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    odd = odd.selectExpr("*", *(f"{i} as {c}" for i, c in enumerate(["print", "key", "size", "n", "found", "draw", "times", "row", "shard"])))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns and out.count() > 0
        assert stage(spark, odd.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd, path).count() == len(rows)


def test_every_operator_has_its_query():
    assert [n for k in range(1, 14) for n in catalog.QUERIES if n.startswith(f"op{k}_")] == [
        n for n in catalog.QUERIES if n != "pipeline"
    ]
    assert catalog.QUERIES["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
