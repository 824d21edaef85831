"""The checks of the two fits pass on a fit and fail on anything else."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgelens.operators import forest, personas, rollups


@pytest.fixture(scope="module")
def hours(spark):
    rng = np.random.default_rng(5)
    rows = [(f"h{i:03d}", int(rng.integers(50, 900)), int(rng.integers(1, 9999)), int(rng.integers(0, 9)), 3) for i in range(400)]
    return spark.createDataFrame(rows, "bucket string, total_requests bigint, total_bytes bigint, total_threats bigint, unique_countries bigint")


def test_trees_hold_against_their_sample(spark, hours):
    nodes = forest.fit(hours, "bucket", 400)
    sampled = forest.sample(hours, "bucket", 400)

    def checks(table):
        return forest.tree_checks(sampled, forest.node_table(spark, table)).where("tree = 7").first()

    good = checks(nodes)
    assert good.root_size == 256 and good.sizes and good.splits and good.leaves and good.depths
    first = nodes.index[(nodes["tree"] == 7) & (nodes["node"] == 0)][0]
    moved = nodes.copy()
    moved.loc[first, "threshold"] = 1e9
    assert not checks(moved).splits and not checks(moved).sizes
    cut = nodes.copy()
    cut.loc[first, "feature"] = -1
    assert not checks(cut).leaves


def test_scores_are_those_of_the_walk(spark, hours):
    nodes = forest.fit(hours, "bucket", 400)
    table = forest.node_table(spark, nodes)
    scored = hours.select("bucket", forest.scorer(nodes, 256)(*(F.col(c) for c in forest.FEATURES)).alias("scored"))
    both = scored.join(forest.walked_scores(hours, "bucket", table, 256), "bucket")
    assert both.count() == 400 and both.where(F.abs(F.col("scored") - F.col("raw")) > 1e-9).isEmpty()
    fewer = table.withColumn("size", F.when(F.col("node") == 0, F.col("size")).otherwise(F.col("size") + 1))
    assert not scored.join(forest.walked_scores(hours, "bucket", fewer, 256), "bucket").where(
        F.abs(F.col("scored") - F.col("raw")) > 1e-9
    ).isEmpty()


def test_only_a_settled_fit_is_a_fixed_point(hourly):
    rng = np.random.default_rng(6)
    fitted = personas.fit(hourly(*((f"b{i}", f"C{i % 7}", int(rng.integers(1, 400)), {"threats": int(rng.integers(0, 50))}) for i in range(200))))
    good = personas.fixed_point(fitted).first()
    assert good.clusters_used == 6 and good.nearest and good.central and good.cheapest
    turned = dataclasses.replace(fitted, points=fitted.points.withColumn("cluster", (F.col("cluster") + 1) % 6))
    bad = personas.fixed_point(turned).first()
    assert not bad.nearest and not bad.central and not bad.cheapest
    dearer = dataclasses.replace(fitted, costs=[c / 2 for c in fitted.costs])
    assert not personas.fixed_point(dearer).first().cheapest


def test_sketches_merge_like_one(spark):
    rows = spark.range(0, 50_000, 1, 7).select((F.col("id") * 7919 % 50_000).alias("v"), (F.col("id") % 30).alias("d"))
    sketches = rollups.quantile_sketches(rows, "v", F.col("d"))
    assert sketches.count() == 30
    found = rollups.sketched_quantiles(sketches, [0.25, 0.5, 0.9]).first()
    assert found.n == 50_000
    assert all(abs(got - want) < 500 for got, want in zip(found[1:], (12_500, 25_000, 45_000)))
    assert rollups.sketched_quantiles(sketches.where("false"), [0.5]).first().q50 is None
