"""Visitor personas: clusters, their profiles and their names."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.functions import numeric as N
from edgelens.operators import features as X
from edgelens.operators.rollups import exact_quantiles
from edgelens.operators.windows import MIN_ROWS
from edgelens.session import checkpoint, written

# Restarts, seed, iteration limit of the fit; it has settled when the
# squared moves of all centres, in units of the feature variance, add up to this.
RESTARTS, SEED, MAX_ITER, SETTLED = 10, 42, 300, 1e-4
KEY = ["country", "request_count", "bytes_total", "threats"]
FEATURES = ["country_code", "request_count", "bytes_total", "threats"]
# Quantiles that the naming rules compare with.
NAMING_QUANTILES = [0.25, 0.5, 0.9]
TOP_COUNTRIES = 3

# Points of a part, and parts at least: the layout hangs on the points alone.
POINTS_PER_TASK, LEAST_PARTS = 100_000, 8


@dataclass
class Personas:
    """A fit: weighted points with their cluster and standard scores, cluster count,
    cost, centres, and the cost of every restart."""

    points: DataFrame
    n_clusters: int
    rows: int
    inertia: float
    centres: list[list[float]]
    costs: list[float]


def _points(ht: DataFrame) -> DataFrame:
    """Equal rows collapsed to one weighted point.

    K-Means over weighted points has the same objective as over the rows, and
    all later sums work from the points, so the table is read once for the fit.
    """
    return X.cluster_input(ht).groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"))


def _scaled(points: DataFrame) -> DataFrame:
    """Points with the standard score of each feature, weights counted as rows.

    Means come first and deviations from them second, which keeps the digits
    that a sum of squares would lose; each is one row of four numbers.
    """
    coded = X.with_codes(points, "country", "country_code")
    total = F.sum("weight")
    means = coded.agg(*(F.sum(F.col(c) * F.col("weight")) / total for c in FEATURES)).first()
    gaps = [F.col(c) - F.lit(float(m)) for c, m in zip(FEATURES, means)]
    stds = coded.agg(*(F.sqrt(F.sum(g * g * F.col("weight")) / total) for g in gaps)).first()
    scores = [
        (g / F.lit(float(s)) if s > 0 else F.lit(0.0)).alias(f"{c}_z")
        for c, g, s in zip(FEATURES, gaps, stds)
    ]
    return coded.select(*KEY, F.col("weight").cast("double").alias("weight"), *scores)


def fit(ht: DataFrame, min_rows: int = MIN_ROWS) -> Personas | None:
    """Best of ten K-Means runs; nothing below ``min_rows`` rows.

    Points are kept in the shared folder, so a lost executor costs a re-read and
    not a rebuild. They are laid out by hash into a number of parts
    that depends on their count alone and sorted within each, which makes the
    choice of start centres the same for any shuffle setting. One cached copy serves
    all ten runs.
    """
    spark = ht.sparkSession
    points = written(_points(ht), "points")
    rows, distinct = points.agg(F.sum("weight"), F.count(F.lit(1))).first()
    if not rows or rows < min_rows:
        return None
    data = checkpoint(
        VectorAssembler(inputCols=[f"{c}_z" for c in FEATURES], outputCol="features")
        .transform(_scaled(points))
        .select(*KEY, "weight", "features")
        .repartition(max(LEAST_PARTS, -(-distinct // POINTS_PER_TASK)), *KEY)
        .sortWithinPartitions(*KEY)
    ).persist(StorageLevel.MEMORY_AND_DISK)
    k = min(max(2, rows // 20), 6)
    # Spark bounds the move of each single centre.
    move = math.sqrt(SETTLED / k)

    def run(seed: int) -> tuple[float, int, KMeansModel]:
        kmeans = KMeans(
            k=k, seed=seed, maxIter=MAX_ITER, tol=move, weightCol="weight", initMode="k-means||"
        )
        model = kmeans.fit(data)
        return model.summary.trainingCost, seed, model

    # All runs read the one cached copy; a fit makes its own only of an uncached input.
    with ThreadPoolExecutor(RESTARTS) as pool:
        runs = list(pool.map(inheritable_thread_target(spark)(run), range(SEED, SEED + RESTARTS)))
    best = min(runs, key=lambda r: r[:2])[2]
    centres = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in best.clusterCenters()))
    gaps = F.zip_with(
        vector_to_array("features"), F.get(centres, F.col("prediction")), lambda x, c: (x - c) * (x - c)
    )
    assigned = checkpoint(
        best.transform(data).select(
            *KEY,
            F.col("weight").cast("bigint").alias("weight"),
            F.col("prediction").alias("cluster"),
            vector_to_array("features").alias("scores"),
            F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b).alias("gap"),
        )
    )
    data.unpersist()
    inertia = assigned.agg(F.sum(F.col("gap") * F.col("weight"))).first()[0]
    centre_list = [[float(x) for x in c] for c in best.clusterCenters()]
    return Personas(assigned.drop("gap"), k, int(rows), float(inertia), centre_list, [r[0] for r in runs])


def fixed_point(fitted: Personas) -> DataFrame:
    """What holds for a settled fit alone, one row.

    ``nearest``: no point has a nearer centre than its own. ``central``: every centre is
    the weighted mean of its points, as far as the last move may have left it.
    ``cheapest``: the cost is that of the points, and no restart found a lower one.
    """
    centres = F.array(*(F.array(*(F.lit(x) for x in c)) for c in fitted.centres))

    def gap(scores: Column, centre: Column) -> Column:
        squares = F.zip_with(scores, centre, lambda x, c: (x - c) * (x - c))
        return F.aggregate(squares, F.lit(0.0), lambda a, b: a + b)

    own = gap(F.col("scores"), F.get(centres, F.col("cluster")))
    least = F.array_min(F.transform(centres, lambda c: gap(F.col("scores"), c)))
    points = fitted.points.select("cluster", "weight", "scores", own.alias("own"), least.alias("least"))
    total = F.sum("weight")
    mean = F.array(*(F.sum(F.get("scores", F.lit(i)) * F.col("weight")) / total for i in range(len(FEATURES))))
    per_cluster = points.groupBy("cluster").agg(
        F.every(F.col("own") <= F.col("least") + 1e-9).alias("nearest"),
        gap(mean, F.get(centres, F.col("cluster"))).alias("moved"),
        F.sum(F.col("own") * F.col("weight")).alias("cost"),
    )
    cost, cheapest = F.sum("cost"), min(fitted.costs)
    return per_cluster.agg(
        F.count(F.lit(1)).cast("int").alias("clusters_used"),
        F.every("nearest").alias("nearest"),
        (F.sum("moved") <= SETTLED).alias("central"),
        ((F.abs(cost - fitted.inertia) <= 1e-6 * cost) & (cost <= cheapest * (1 + 1e-6))).alias("cheapest"),
    )


def measures(assigned: DataFrame, weight: str | None = None) -> DataFrame:
    """What profiles add up, per assigned row; ``weight`` counts equal rows."""
    w = F.lit(1) if weight is None else F.col(weight)
    return assigned.select(
        "cluster",
        "country",
        "request_count",
        w.cast("bigint").alias("n"),
        (F.col("request_count") * w).alias("requests"),
        (F.col("bytes_total") * w).alias("bytes"),
        (F.col("threats") * w).alias("threats"),
    )


def _added(rows: DataFrame, *KEYs: str) -> DataFrame:
    return rows.groupBy(*KEYs).agg(*(F.sum(c).alias(c) for c in ("n", "requests", "bytes", "threats")))


def profiles(rows: DataFrame) -> DataFrame:
    """One row per cluster: size, means, threats and its three main countries.

    Rows combine per (cluster, country) first, so the few cluster groups hold one
    row per country and never the rows themselves.
    """
    order = Window.partitionBy("cluster").orderBy(F.desc("n"), "country")
    ranked = _added(rows, "cluster", "country").withColumn("place", F.row_number().over(order))
    top = F.when(F.col("place") <= TOP_COUNTRIES, F.struct("place", "country", "n"))
    return ranked.groupBy("cluster").agg(
        F.sum("n").alias("size"),
        (F.sum("requests") / F.sum("n")).alias("avg_requests"),
        (F.sum("bytes") / F.sum("n")).alias("avg_bytes"),
        F.sum("threats").alias("total_threats"),
        N.ratio(F.sum("threats"), F.sum("requests")).alias("threat_ratio"),
        F.transform(
            F.array_sort(F.collect_list(top)), lambda t: F.struct(t["country"], t["n"].alias("count"))
        ).alias("top_countries"),
    )


def top_countries(profiled: DataFrame) -> DataFrame:
    """Main countries of each cluster as rows."""
    return profiled.select("cluster", F.posexplode("top_countries").alias("pos", "c")).select(
        "cluster", (F.col("pos") + 1).alias("place"), "c.country", "c.count"
    )


def quantiles(rows: DataFrame) -> DataFrame:
    return exact_quantiles(rows, "request_count", NAMING_QUANTILES, "n")


def _named(p: Column, used: Column, q: Column) -> Column:
    """First rule that holds and whose name is still free."""

    def free(name: str) -> Column:
        return ~F.array_contains(used, name)

    # Names and thresholds, in order of precedence.
    rules = [
        ("Suspicious Traffic", p["threat_ratio"] > 0.1),
        ("Elevated Threat", p["threat_ratio"] > 0.05),
        ("High-Volume Visitors", p["avg_requests"] > q["q90"]),
        ("Moderate Traffic", p["avg_requests"] > q["q50"]),
        ("Low-Volume / Crawlers", p["avg_requests"] <= q["q25"]),
    ]
    return F.coalesce(
        *(F.when(holds & free(name), F.lit(name)) for name, holds in rules), F.lit("Mixed Traffic")
    )


def _from_the_busiest(profiled: DataFrame) -> Column:
    """All profiles as one array, by mean requests down, then cluster."""
    rest = [c for c in profiled.columns if c != "cluster"]
    keyed = F.struct((-F.col("avg_requests")).alias("_down"), "cluster", *rest)
    return F.array_sort(F.collect_list(keyed))


def in_order(profiled: DataFrame) -> DataFrame:
    """Profiles with their rank; there is one row per cluster, six at most."""
    listed = profiled.agg(_from_the_busiest(profiled).alias("p"))
    return listed.select(F.posexplode("p").alias("rank", "p")).select(
        "rank", *(F.col(f"p.{c}").alias(c) for c in profiled.columns)
    )


def label(profiled: DataFrame, cut: Column) -> DataFrame:
    """Name the profiles from the busiest down, each base name once.

    ``cut`` holds the naming quantiles. The fold is sequential by nature and runs
    over the array of profiles.
    """
    no_names = F.array().cast("array<string>")

    def step(state: Column, p: Column) -> Column:
        base = _named(p, state["used"], p["cut"])
        main = F.coalesce(F.get(p["top_countries"], F.lit(0))["country"], F.lit("Unknown"))
        taken = F.array_contains(state["used"], base)
        name = F.when(taken, F.concat(base, F.lit(" ("), main, F.lit(")"))).otherwise(base)
        return F.struct(
            F.array_append(state["used"], base).alias("used"),
            F.array_append(state["labels"], name).alias("labels"),
        )

    start = F.struct(no_names.alias("used"), no_names.alias("labels"))
    listed = profiled.agg(_from_the_busiest(profiled).alias("p")).withColumn("cut", cut)
    with_cut = F.transform("p", lambda p: p.withField("cut", F.col("cut")))
    named = listed.select("p", F.aggregate(with_cut, start, step, lambda s: s["labels"]).alias("label"))
    return named.select(F.posexplode(F.arrays_zip("p", "label")).alias("rank", "r")).select(
        "rank", *(F.col(f"r.p.{c}").alias(c) for c in profiled.columns), "r.label"
    )


def labelled_profiles(assigned: DataFrame, weight: str | None = None) -> DataFrame:
    """Profiles in order of mean requests with their names.

    Profiles and quantiles both work from sums per (cluster, country, requests),
    kept once, so the assigned rows are read a single time.
    """
    rows = checkpoint(_added(measures(assigned, weight), "cluster", "country", "request_count"))
    cut = quantiles(rows)
    return label(profiles(rows), cut.select(F.struct(*cut.columns)).scalar())
