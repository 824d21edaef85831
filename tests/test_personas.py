import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens.operators import features, personas

SCHEMA = (
    "cluster int, size bigint, avg_requests double, avg_bytes double, total_threats bigint, "
    "threat_ratio double, top_countries array<struct<country: string, count: bigint>>"
)


def labels(spark, *profiles, q=(25.0, 50.0, 90.0)):
    """Names for (mean requests, threat ratio, country) profiles, busiest first."""
    rows = [
        (i, 1, float(avg), 0.0, 0, ratio, [(country, 1)] if country else [])
        for i, (avg, ratio, country) in enumerate(profiles)
    ]
    cut = F.struct(*(F.lit(v).alias(n) for n, v in zip(("q25", "q50", "q90"), q)))
    named = personas.label(spark.createDataFrame(rows, SCHEMA), cut)
    return [(r.cluster, r.label) for r in named.orderBy("rank").collect()]


def test_every_naming_rule(spark):
    assert labels(
        spark,
        (100, 0.2, "A"),
        (95, 0.06, "B"),
        (91, 0.0, "C"),
        (60, 0.0, "D"),
        (40, 0.0, "E"),
        (10, 0.0, "F"),
    ) == [
        (0, "Suspicious Traffic"),
        (1, "Elevated Threat"),
        (2, "High-Volume Visitors"),
        (3, "Moderate Traffic"),
        (4, "Mixed Traffic"),
        (5, "Low-Volume / Crawlers"),
    ]


def test_used_names_fall_through_and_mixed_repeats(spark):
    assert labels(
        spark,
        (200, 0.3, "A"),
        (190, 0.3, "B"),
        (180, 0.3, "C"),
        (170, 0.3, "D"),
        (160, 0.3, "E"),
        (150, 0.3, None),
    ) == [
        (0, "Suspicious Traffic"),
        (1, "Elevated Threat"),
        (2, "High-Volume Visitors"),
        (3, "Moderate Traffic"),
        (4, "Mixed Traffic"),
        (5, "Mixed Traffic (Unknown)"),
    ]
    assert labels(spark, (45, 0.0, "A"), (40, 0.0, "B"), (35, 0.0, "C"))[1:] == [
        (1, "Mixed Traffic (B)"),
        (2, "Mixed Traffic (C)"),
    ]


def test_limits_are_strict_and_ties_go_to_the_lower_cluster(spark):
    assert labels(spark, (90, 0.1, "A"), (90, 0.05, "B"), (25, 0.0, "C")) == [
        (0, "Elevated Threat"),
        (1, "Moderate Traffic"),
        (2, "Low-Volume / Crawlers"),
    ]


def test_profiles_and_top_countries(spark):
    rows = [(0, "B", 10, 1, 0)] * 2 + [(0, "A", 20, 1, 6)] * 2 + [(0, "C", 0, 1, 0), (0, "D", 0, 1, 0), (1, "A", 0, 0, 3)]
    assigned = spark.createDataFrame(
        rows, "cluster int, country string, request_count bigint, bytes_total bigint, threats bigint"
    )
    profiled = personas.profiles(personas.measures(assigned))
    assert rows_of(profiled, "cluster", "size", "avg_requests", "avg_bytes", "total_threats", "threat_ratio") == [
        (0, 6, 10.0, 1.0, 12, 0.2),
        (1, 1, 0.0, 0.0, 3, 3.0),
    ]
    assert rows_of(personas.top_countries(profiled)) == [
        (0, 1, "A", 2), (0, 2, "B", 2), (0, 3, "C", 1), (1, 1, "A", 1),
    ]
    assert [tuple(r) for r in personas.in_order(profiled).orderBy("rank").select("rank", "cluster").collect()] == [(0, 0), (1, 1)]


def test_weights_count_equal_rows(spark):
    rows = [(0, "A", 5, 7, 1, 3), (1, "B", 2, 2, 0, 2)]
    weighted = spark.createDataFrame(
        rows, "cluster int, country string, request_count bigint, bytes_total bigint, threats bigint, w bigint"
    )
    repeated = weighted.withColumn("w", F.explode(F.sequence(F.lit(1), "w"))).drop("w")
    a = personas.labelled_profiles(weighted, "w").orderBy("rank").collect()
    b = personas.labelled_profiles(repeated).orderBy("rank").collect()
    assert a == b


def test_category_codes_are_byte_ordered(spark):
    frame = spark.createDataFrame([(c,) for c in ["b", "B", "a", "a", None]], "x string")
    assert rows_of(features.category_codes(frame, "x", "code")) == [("B", 0), ("a", 1), ("b", 2)]


def test_z_scores_population_and_constant_column(spark):
    frame = spark.createDataFrame([(1, 5), (2, 5), (6, 5)], "x int, y int")
    got = features.z_scores(frame, ["x", "y"]).orderBy("x").collect()
    want = (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])
    assert [r.x_z for r in got] == pytest.approx(list(want))
    assert [r.y_z for r in got] == [0.0] * 3


def blobs(spark, n=60):
    rng = np.random.default_rng(5)
    rows = []
    for c, centre in enumerate((10, 500, 3000)):
        for i in range(n):
            r = int(centre + rng.integers(0, 5))
            rows.append(("t", f"b{i}", "US", "", 0, "", r, r * 10, c, 0, i, None))
    from edgelens.schemas import HOURLY_TRAFFIC

    return spark.createDataFrame(rows, HOURLY_TRAFFIC)


def test_fit_separates_blobs_and_keeps_totals(spark):
    ht = blobs(spark)
    fitted = personas.fit(ht)
    assert (fitted.n_clusters, fitted.rows) == (6, 180)
    got = fitted.points.agg(
        F.sum("weight"), F.sum(F.col("request_count") * F.col("weight")), F.sum(F.col("threats") * F.col("weight"))
    ).first()
    want = ht.agg(F.count("*"), F.sum("request_count"), F.sum("threats")).first()
    assert tuple(got) == tuple(want)
    mixed = fitted.points.groupBy("cluster").agg(F.countDistinct("threats").alias("blobs")).agg(F.max("blobs"))
    assert mixed.first()[0] == 1


def test_fit_is_the_same_for_any_shuffle_setting(spark):
    ht = blobs(spark)
    one = personas.fit(ht)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = personas.fit(ht.repartition(5))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one.inertia == pytest.approx(other.inertia, rel=1e-9)
    assert rows_of(one.points) == rows_of(other.points)


def test_cost_is_that_of_the_standardised_rows(spark):
    """The weighted cost equals the inertia over single rows."""
    fitted = personas.fit(blobs(spark))
    rows = fitted.points.toPandas()
    rows = rows.loc[rows.index.repeat(rows["weight"])]
    x = rows[["request_count", "bytes_total", "threats"]].to_numpy(float)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    inertia = sum(
        ((z[rows["cluster"] == c] - z[rows["cluster"] == c].mean(axis=0)) ** 2).sum() for c in rows["cluster"].unique()
    )
    assert fitted.inertia == pytest.approx(inertia, rel=1e-3)


def test_too_few_rows(spark, hourly):
    assert personas.fit(hourly(*((f"b{i}", "US", i) for i in range(4)))) is None
    assert personas.fit(hourly(*((f"b{i}", None, i) for i in range(9)))) is None
    assert personas.fit(hourly(*((f"b{i}", "US", i) for i in range(5)))).n_clusters == 2


def test_the_cached_input_goes_when_the_fit_is_done(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert personas.fit(blobs(spark)).n_clusters == 6
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
