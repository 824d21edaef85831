import random
import re
from collections import Counter, defaultdict

import pytest

from edgelens.llm import mixing


def plain_targets(sizes):
    """Shares by weight; what a full source cannot give is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, goal = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        rate = (goal - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * rate > 2 * sizes[s]]
        if not over:
            return full | {s: weight[s] * rate for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def table(prose, n=400, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "Z", "é", None, "c", "d"]
    rows = [(i, prose(i, rng.randint(1, 80)), "en", rng.choices(sources, [30, 5, 5, 3, 4, 2, 1])[0], 1) for i in range(n)]
    return rows + [(n, None, "en", "a", 1), (n + 1, "", "en", "empty", 1), (n + 2, " ", "en", "b", None), (None, "one two", "en", "b", 1)]


def test_targets_sizes_and_taken_words(documents, prose):
    rows = table(prose)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += size(text)
    want = plain_targets(sizes)
    got = mixing.mix(documents(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((d, s, size(t)) for d, t, _, s, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source], rel=1e-9))
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(3, 0.01 * target)


def test_reruns_and_other_layouts_agree(documents, prose):
    rows = table(prose)
    first, second = (sorted(map(str, mixing.mix(documents(rows, parts=p)).collect())) for p in (1, 5))
    assert first == second


def test_cells_fly_on_until_one_is_left(documents, prose, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 20)
    got = mixing.mix(documents(table(prose))).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source, r.target] += r.taken
    for (_, target), words in taken.items():
        assert abs(words - target) <= max(60, 0.02 * target)


def test_a_flight_keeps_both_totals():
    rng = random.Random(4)
    sizes = [float(rng.randint(0, 500)) for _ in range(300)]
    for chance in (0.1, 0.5, 0.93):
        out = mixing.flight(sizes, [chance] * 300, random.Random(1))
        assert sum(0 < p < 1 for p in out) <= 2
        assert sum(out) == pytest.approx(300 * chance)
        assert sum(p * s for p, s in zip(out, sizes)) == pytest.approx(chance * sum(sizes))
    assert sum(mixing.flight([7.0] * 40, [0.25] * 40, random.Random(1))) == pytest.approx(10)


def test_inclusion_chances_are_kept_on_average():
    sizes = [float(5 + i % 9) for i in range(30)]
    draws = [mixing.flight(sizes, [0.3] * 30, random.Random(s)) for s in range(600)]
    for i in range(30):
        assert sum(d[i] for d in draws) / 600 == pytest.approx(0.3, abs=0.09)


def test_the_mix_holds_rows_as_often_as_taken(documents, prose):
    rows = table(prose)
    docs = documents(rows + rows[:3], extra=True)
    times = Counter()
    for r in mixing.mix(docs).collect():
        times[r.doc_id] += r.times
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +times


@pytest.mark.parametrize("fan", [1 << 16, 7])
def test_a_third_of_all_rows_alike(documents, prose, monkeypatch, fan):
    """They fly in many cells, and the mix holds as many of them as it takes."""
    monkeypatch.setattr(mixing, "CELL", 50)
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = table(prose, 300) + [(7000, "one and the same", "en", "a", 3)] * 150 + [(None, None, "en", None, 1)] * 20
    docs = documents(rows, parts=6, extra=True)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    alike = [r.times for r in got if r.doc_id == 7000]
    assert len(alike) == 150 and max(alike) - min(alike) <= 1
    words = defaultdict(int)
    for r in got:
        words[r.source, r.target] += r.taken
    for (_, target), taken in words.items():
        assert abs(taken - target) <= max(80, 0.02 * target)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.times
    assert Counter(r.doc_id for r in out.collect()) == +want
    again = mixing.mix(documents(rows, parts=2)).collect()
    assert Counter(map(str, again)) == Counter(str(r) for r in got)


def test_empty_tables(documents):
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mixed(documents([])).count() == 0
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]
