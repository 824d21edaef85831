import random

import numpy as np
import pytest

from edgelens.llm import quality


def corpus(prose, n=600):
    """Clean prose and three kinds of junk; sources lean to one or the other."""
    rng, rows, labels = random.Random(2), [], []
    for i in range(n):
        text, good = prose(i, rng.randint(5, 120)), i % 5 != 0
        if not good:
            text = [
                " ".join(w.upper() + "!!" for w in text.split()),
                " ".join(w + "%%%" for w in text.split()),
                " ".join(f"{w} {w} {w}" for w in text.split()),
            ][(i // 5 + i // 15) % 3]
        source = rng.choice(["web", "news"]) if good else rng.choice(["web", "dump"])
        rows.append((i, text, "en", source, len(text)))
        if i % 3:
            labels.append((i, int(good), 0))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_unlabelled_documents_are_told_apart(spark, documents, prose):
    rows, labels = corpus(prose)
    known = {i for i, _, _ in labels}
    got = quality.classify(documents(rows, extra=True), table(spark, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.p_good <= 1 for r in got)
    held = [(r.good, r.doc_id % 5 != 0) for r in got if r.doc_id not in known]
    assert len(held) == 200 and sum(a == b for a, b in held) >= 190


def test_views_teach_each_other(prose):
    rows, _ = corpus(prose, 900)
    numbers = np.array([quality.text_numbers(t.encode()) for _, t, *_ in rows])
    places = np.array([(1, {"web": 2, "news": 3, "dump": 4}[r[3]]) for r in rows])
    lengths = np.array([float(r[4]) for r in rows])
    truth = np.array([i % 5 != 0 for i in range(900)], int)
    free = np.arange(900) % 3 == 0
    pool = lambda lesson: lesson.sums(numbers[free], places[free], lengths[free])
    model = quality.Model(numbers[~free], places[~free], lengths[~free], truth[~free], pool)
    assert any(a for a, _ in model.given) and any(b for _, b in model.given)
    assert np.mean((model.chance(numbers, places, lengths) >= 0.5) == truth) > 0.95
    alone = quality.Logistic.fit(model.metadata.columns(places, lengths)[~free], truth[~free].astype(float))
    assert np.mean((alone.score(model.metadata.columns(places, lengths)) >= 0) == truth) < 0.95


def test_the_result_does_not_hang_on_the_layout(spark, documents, prose):
    rows, labels = corpus(prose, 200)
    first, second = (
        sorted((r.doc_id, round(r.p_good, 9)) for r in quality.classify(documents(rows, parts=p), table(spark, labels)).collect())
        for p in (1, 4)
    )
    assert first == second


def test_sure_labels_stop_where_others_mix_in():
    held = np.arange(200.0)
    y = np.where(held >= 100, 1, 0)
    y[[120, 121, 122]] = 0
    assert 50 < quality.sure_limit(held, y, 1) <= 130
    assert 50 <= quality.sure_limit(held, y, 0) < 130
    assert quality.sure_limit(held[:10], y[:10], 1) == np.inf and quality.sure_limit(held[:10], y[:10], 0) == -np.inf
    assert quality.sure_limit(held, np.arange(200) % 2, 1) == np.inf


def test_good_rows_stay_whole(spark, documents, prose):
    rows, labels = corpus(prose, 200)
    docs = documents(rows, extra=True)
    kept = quality.good_only(docs, table(spark, labels))
    assert kept.columns == docs.columns and 120 < kept.count() < 200


def test_sums_over_tasks_are_those_of_one_table(spark, documents, prose):
    rows, labels = corpus(prose, 300)
    docs = documents(rows, parts=5)
    seen = quality.seen_by_views(docs, "doc_id", "text", quality.METADATA)
    taken = quality._arrays(*([r[c] for r in seen.collect()] for c in ("numbers", "a", "b", "c")))
    text, metadata = quality.TextView(taken[0]), quality.MetadataView(taken[2])
    x = [text.columns(taken[0]), metadata.columns(*taken[1:])]
    views = [quality.Logistic.fit(v, (np.arange(len(v)) % 2).astype(float)) for v in x]
    lesson = quality.Lesson(text, metadata, views, [(-0.1, 0.1)] * 2, views)
    for got, want in zip(quality._pool(seen)(lesson), lesson.sums(*taken)):
        assert got.shape == want.shape and np.allclose(got, want)


def test_all_unlabelled_documents_take_part(spark, documents, prose, monkeypatch):
    """Not a sample of them; and one labelled id that fills most rows is one document."""
    met = []
    real = quality._pool
    monkeypatch.setattr(quality, "_pool", lambda free: met.append(free.count()) or real(free))
    rows, labels = corpus(prose, 400)
    known = {i for i, _, _ in labels}
    first = min(known)
    quality.classify(documents(rows + [(first, prose(i, 9)) for i in range(900)] + [(None, "x")]), table(spark, labels)).count()
    assert met == [len(rows) - len(known) + 1]


def test_many_pseudo_labels_do_not_drown_the_sample():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100, 2))
    y = (x[:, 0] > 0).astype(float)
    once = quality.Logistic.fit(x, y)
    slope, curve = quality._sums(quality._with_constant(x), y, once.weights)
    weight = lambda n: quality.PSEUDO_WEIGHT * min(1.0, 100 / n)
    few = once.step(x, y, weight(100) * slope, weight(100) * curve)
    many = once.step(x, y, weight(10**6) * slope * 10**4, weight(10**6) * curve * 10**4)
    assert np.allclose(few.weights, many.weights)


def test_nulls_repeats_and_empty_tables(spark, documents, prose):
    rows, labels = corpus(prose, 200)
    odd = [(None, None, None, None, None), (None, "", None, "web", 3), (5, "word " * 60_000, "xx", None, None), (5, "a", "en", "web", -1)]
    odd_labels = [(None, 1, 0), (3, None, 0), (5, 0, 0), (5, 1, 1), (99_999, 0, 0)]
    got = quality.classify(documents(rows + odd + odd), table(spark, labels + odd_labels)).collect()
    assert len(got) == 208 and all(0 <= r.p_good <= 1 for r in got)
    assert quality.classify(documents([]), table(spark, labels)).count() == 0
    assert [r.good for r in quality.classify(documents(odd), table(spark, [])).collect()] == [True] * 4


@pytest.mark.parametrize("text", [None, b"", b" \n", b"a", "é!".encode() * 1000])
def test_numbers_of_odd_texts(text):
    assert len(quality.text_numbers(text)) == quality.N_TEXT and np.isfinite(quality.text_numbers(text)).all()
