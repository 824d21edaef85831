import random

import numpy as np
import pytest

from edgelens.llm import toxicity

RUDE = ["vileness", "rotter", "scoundrel", "blackguard"]


def corpus(prose, n=900, rude_every=6):
    rng, rows, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(i, rng.randint(5, 150)).split()
        toxic = i % rude_every == 0
        for _ in range(rng.choice([1, 2, 4, 9]) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(RUDE) + rng.choice(["", "s", "!"]))
        rows.append((i, " ".join(words)))
        if i % 2 or i % 4 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents(spark, documents, prose):
    rows, labels = corpus(prose)
    known = {i for i, _, _ in labels}
    got = toxicity.toxicity(documents(rows, extra=True), table(spark, labels)).collect()
    assert len(got) == len(rows)
    held = [(r.toxic, r.doc_id % 6 == 0) for r in got if r.doc_id not in known]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and any(b for _, b in held)
    assert all(0 <= r.severity <= 3 and r.toxic == (r.p_toxic >= 0.5) for r in got)
    hits = {i: sum(t.count(w) for w in RUDE) for i, t in rows}
    words = {i: len(t.split()) for i, t in rows}
    dense = {i: hits[i] / words[i] for i in hits if hits[i]}
    low, high = np.quantile(list(dense.values()), [0.33, 0.67])
    severity = {i: r.severity for r in got for i in [r.doc_id]}
    mild = np.mean([severity[i] for i, d in dense.items() if d <= low])
    strong = np.mean([severity[i] for i, d in dense.items() if d >= high])
    assert np.mean([severity[i] for i in hits if not hits[i]]) < 0.2 < mild < strong


def test_grades_are_held_out_and_do_not_follow_length(spark, prose):
    rows = [(i, (prose(i, 40) + " rotter") if i % 2 else prose(i, 40), i % 2) for i in range(200)]
    rows += [(200 + 2 * i, " ".join([prose(300 + i, 40) + " rotter"] * 5), 1) for i in range(20)]
    rows += [(301 + 2 * i, prose(400 + i, 3) + " rotter", 1) for i in range(20)]
    sample = spark.createDataFrame(rows, "number bigint, text string, toxic int")
    odds = {r.number: r.odds for r in toxicity.held_out_odds(sample).collect()}
    assert len(odds) == 240
    assert np.mean([odds[i] for i in range(1, 200, 2)]) > np.mean([odds[i] for i in range(0, 200, 2)])
    long, short = (np.mean([odds[s + 2 * i] for i in range(20)]) for s in (200, 301))
    assert short > long
    # The word of one half alone says nothing there, as its own label does not count.
    alone = spark.createDataFrame([(0, "zap a", 1), (2, "zap a", 1), (1, "a", 0), (3, "a", 1)], "number bigint, text string, toxic int")
    found = {r.number: r.odds for r in toxicity.held_out_odds(alone).collect()}
    assert found[0] == found[2] == 0 and found[1] == found[3] > 0


def test_long_words_that_begin_alike_are_different_features():
    a, b = b"x" * 100 + b"a", b"x" * 100 + b"b"
    assert toxicity.features_of(a)[0] != toxicity.features_of(b)[0] and len(toxicity.features_of(a)[0]) < 64


def test_unseen_endings_and_long_texts(spark, documents, prose):
    rows, labels = corpus(prose)
    model = toxicity.train(documents(rows), table(spark, labels))
    assert model.names and len(model.names) <= toxicity.FEATURES
    odd = [(1, "scoundrelish vilenesses"), (2, prose(5, 30_000)), (3, None), (4, ""), (4, "ROTTER scoundrel VILENESS")]
    docs = documents(odd, extra=True)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "severity_", "p_toxic", "grade", "toxic"]
    got = sorted((r.doc_id, r.n_chars, r.toxic) for r in scored.na.fill(-1, ["n_chars"]).collect())
    assert [(i, t) for i, _, t in got] == [(1, True), (2, False), (3, False), (4, False), (4, True)]


def test_layouts_agree(spark, documents, prose):
    rows, labels = corpus(prose, 300)
    first, second = (
        sorted((r.doc_id, round(r.severity, 9)) for r in toxicity.toxicity(documents(rows, parts=p), table(spark, labels)).collect())
        for p in (1, 4)
    )
    assert first == second


def test_without_labels_nothing_is_toxic(spark, documents, prose):
    rows, _ = corpus(prose, 30)
    for labels in ([], [(1, 1, 0)], [(1, 1, 1)], [(None, 1, 1), (2, 1, None)]):
        got = toxicity.toxicity(documents(rows), table(spark, labels)).collect()
        assert {(r.severity, r.toxic) for r in got} == {(0.0, False)} and len(got) == 30
    assert toxicity.toxicity(documents([]), table(spark, [(1, 1, 1)])).count() == 0


def test_thresholds_rise_and_the_slope_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(6, 3, replace=False).tolist()), rng.uniform(1, 3, 3).tolist()) for _ in range(400)]
    x = toxicity.Sparse(rows, 6)
    truth = np.array([2.0, 1.0, 0.5, 0.0, -1.0, -2.0])
    noise = rng.logistic(size=400)
    grades = np.searchsorted([0.0, 2.0, 4.0], x.dot(truth) + noise)
    weights, theta = toxicity.fit(x, grades)
    assert (np.diff(theta) > 0).all()
    assert np.corrcoef(weights, truth)[0, 1] > 0.95
    expected = toxicity.above(x.dot(weights), theta).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.75
    assert x.back(np.ones(400)) == pytest.approx([sum(v for p, vs in rows for i, v in zip(p, vs) if i == k) for k in range(6)])
