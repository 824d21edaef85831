import numpy as np
import pytest

from edgelens.llm import embeddings as E

NAN, INF = float("nan"), float("inf")


def brute(rows, threshold=0.9):
    """n_links and component of each row, by all pairs in double precision."""
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in good}
    links = {i: [] for i in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= threshold - 1e-12:
                    links[a].append(b)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), first, vec_id == first))
    return sorted(map(str, out))


def found(spark, rows, kind="double", extra=""):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    df = df.selectExpr("*", "1 as key", "2 as vector", "3 as n", "4 as label")
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in E.near_duplicates(df).collect())


def cloud(seed, n, dims, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    points = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * spread
    return np.float32(points * rng.uniform(0.01, 50, (n, 1))).astype(float).tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("spread", [0.2, 0.45])
def test_against_all_pairs(spark, monkeypatch, kind, spread):
    monkeypatch.setattr(E, "BLOCK", 60)
    vectors = cloud(int(spread * 100), 300, 24, spread)
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(40)]
    assert found(spark, rows, kind) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0] * 3)]
    rows += [(7, [1.0, None, 2.0]), (8, [NAN, 1.0, 1.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0, 3.1]), (12, [-1.0, -2.0, -3.0])]
    rows += [(11, [1e300, 2e300, 3e300]), (13, [INF, 1.0, 1.0]), (14, [1e-300, 2e-300, 3e-300]), (None, None), (15, [5.0] * 2000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_the_bound_holds_and_products_are_exact():
    rng = np.random.default_rng(3)
    for dims in (1, 3, 64, 1500):
        raw = rng.normal(size=(200, dims)) ** 3
        keys = np.arange(200)
        block = E.Block(200, dims, keys.tobytes(), keys.tobytes(), raw.tobytes())
        whole = block.codes.astype(np.int64)
        assert (E.code_products(block.codes, block.codes) == whole @ whole.T).all()
        unit = raw / np.linalg.norm(raw, axis=1)[:, None]
        near = unit @ unit.T >= 0.9
        marked = np.zeros_like(near)
        for i, j in E.candidates(block, block, 0.9):
            marked[i, j] = True
        assert not (near & ~marked).any()


def test_a_forest_joins_what_links_join():
    rng = np.random.default_rng(4)
    forest, pairs = E.Forest(100), rng.integers(0, 100, (60, 2))
    for at in range(0, 60, 7):
        forest.add(pairs[at : at + 7, 0], pairs[at : at + 7, 1])
    label = np.arange(100)
    for _ in range(100):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert (forest.label == label).all()


def test_tiles_move_no_block_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 10)
    plans, write = {}, E.written

    def written(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(E, "written", written)
    rows = list(enumerate(cloud(5, 120, 8, 0.3)))
    assert found(spark, rows) == brute(rows)
    assert "InArrow" in plans["links"] and "Exchange" not in plans["links"]


def test_common_vectors_in_small_batches_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 9)
    monkeypatch.setattr(E, "PART_BYTES", 4000)
    monkeypatch.setattr(E, "REMEMBERED", 5)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "7")
    try:
        vectors = cloud(6, 150, 12, 0.35)
        rows = [(i % 140, v) for i, v in enumerate(vectors)] + [(200 + i, vectors[i % 3]) for i in range(100)]
        rows += [(None, vectors[1]), (400, [-0.0, 1.0]), (401, [0.0, 1.0]), (402, [3.0]), (403, [-3.0]), (404, [5.0])]
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set(batch, before)


def test_a_class_without_its_vector_fails(spark):
    classes = spark.createDataFrame([(2, 1, 1, 0, 1), (2, 5, 5, 1, 1)], "dims int, one bigint, two bigint, key bigint, copies bigint")
    vectors = spark.createDataFrame([(2, 1, 1, [1.0, 2.0])], "dims int, one bigint, two bigint, vector array<double>")
    with pytest.raises(Exception, match="not the same when read again"):
        E.tile_links(classes, vectors, 0.9).count()
