import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens.operators import forest


def hours(spark, n, seed=0, planted=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(1000, 100, (n, 4)).round().astype(int)
    if planted is not None:
        x[planted] = 5000
    rows = [(f"b{i:05d}", *map(int, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "bucket string, " + ", ".join(f"{c} bigint" for c in forest.FEATURES))


@pytest.mark.parametrize("n, found", [(4, None), (5, 1), (11, 1), (12, 2), (20, 2), (21, 2), (169, 2)])
def test_number_of_flagged_hours(spark, n, found):
    flagged = forest.detect(hours(spark, n))
    if found is None:
        assert flagged is None
        return
    assert forest.anomalies(flagged).count() == found
    low, high = flagged.agg(F.min("raw"), F.max("raw")).first()
    assert -1 <= low <= high < 0


def test_planted_hour_is_first(spark):
    flagged = forest.detect(hours(spark, 100, planted=37))
    assert flagged.orderBy("raw").first().bucket == "b00037"


def test_same_for_any_partitioning(spark):
    data = hours(spark, 60)
    one = forest.detect(data)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = forest.detect(data.repartition(7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert rows_of(one) == rows_of(other)


def test_offset_is_the_contamination_quantile(spark):
    for n in (5, 12, 20, 21, 150):
        scores = -np.random.default_rng(n).random(n)
        frame = spark.createDataFrame([(float(s),) for s in scores], "raw double")
        assert forest.offset(frame, n) == pytest.approx(np.quantile(scores, min(0.1, 2 / n)))


def test_mean_path():
    assert list(forest.mean_path(np.array([0, 1, 2]))) == [0, 0, 1]
    assert forest.mean_path(np.array([256]))[0] == pytest.approx(10.2448, abs=1e-3)


def test_trees_split_every_row_apart_or_reach_the_limit():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame(rng.random((100, 4)), columns=forest.FEATURES).assign(
        tree=7, row_key=[f"r{i:03d}" for i in range(100)]
    )
    nodes = forest.grow(rows)
    leaves = nodes[nodes["feature"] < 0]
    assert leaves["size"].sum() == 100
    assert nodes["depth"].max() <= 7
    assert ((leaves["size"] == 1) | (leaves["depth"] == 7)).all()
    inner = nodes[nodes["feature"] >= 0]
    for _, n in inner.iterrows():
        assert n["size"] == nodes.loc[n["low"], "size"] + nodes.loc[n["high"], "size"]
    shuffled = forest.grow(rows.sample(frac=1, random_state=1))
    pd.testing.assert_frame_equal(nodes, shuffled)


def test_equal_rows_make_one_leaf():
    rows = pd.DataFrame(np.ones((9, 4)), columns=forest.FEATURES).assign(tree=0, row_key=list("abcdefghi"))
    assert len(forest.grow(rows)) == 1


def test_sample_of_a_large_input_is_exact(spark):
    """The hash threshold keeps what an exact ranking would choose."""
    data = spark.range(20_000).select(
        F.format_string("k%06d", "id").alias("bucket"), *(F.col("id").alias(c) for c in forest.FEATURES)
    )
    got = forest.sample(data, "bucket", 20_000).where("tree < 3").select("tree", "row_key")
    draws = data.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree")).withColumn(
        "draw", F.xxhash64("bucket", "tree", F.lit(forest.SEED))
    )
    want = draws.toPandas().sort_values(["tree", "draw"]).groupby("tree").head(forest.SAMPLE)
    assert {tuple(r) for r in got.collect()} == set(zip(want["tree"], want["bucket"]))
    counts = forest.sample(data, "bucket", 20_000).groupBy("tree").count()
    assert {r["count"] for r in counts.collect()} == {forest.SAMPLE}


def test_scores_match_a_plain_walk(spark):
    data = hours(spark, 40)
    flagged = forest.detect(data).orderBy("bucket").toPandas()
    nodes = forest.fit(data, "bucket", 40)
    depth = np.zeros(40)
    for _, tree in nodes.groupby("tree"):
        tree = tree.set_index("node")
        for i, row in enumerate(flagged[forest.FEATURES].to_numpy(float)):
            node = tree.loc[0]
            while node["feature"] >= 0:
                node = tree.loc[node["low"] if row[int(node["feature"])] <= node["threshold"] else node["high"]]
            depth[i] += node["depth"] + forest.mean_path(np.array([node["size"]]))[0]
    raw = -np.exp2(-depth / 100 / forest.mean_path(np.array([40]))[0])
    assert flagged["raw"].to_numpy() == pytest.approx(raw)


def test_a_tree_with_too_few_rows_stops_the_fit(spark):
    rows = [(f"b{i}", i, i, i, 1) for i in range(40)]
    hours = spark.createDataFrame(rows, "bucket string, total_requests int, total_bytes int, total_threats int, unique_countries int")
    assert len(forest.fit(hours, "bucket", 40).query("depth == 0")) == forest.TREES
    with pytest.raises(RuntimeError, match="fewer rows"):
        forest.fit(hours, "bucket", 10_000)
