"""Isolation Forest (Liu, Ting, Zhou 2008) over a frame of hourly features.

Sampling, growing and scoring are each partitioned by Spark: the sample of a tree
is chosen by hash, a tree is grown per group of at most 256 rows, and scores come
from a vectorised function that holds the node table, at most 100 x 511 rows.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from edgelens.operators.windows import MIN_ROWS
from edgelens.session import checkpoint

# The two Python functions travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Trees, rows per tree, seed.
TREES, SAMPLE, SEED = 100, 256, 42
FEATURES = ["total_requests", "total_bytes", "total_threats", "unique_countries"]
EULER_GAMMA = 0.5772156649015329
# Steps from a root to the deepest leaf.
DEPTH = 8
# Expected rows per tree that pass the hash threshold, before the exact cut.
OVERSAMPLE = 4

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, low int, high int, depth int, size bigint"
)


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of one tree over at most ``SAMPLE`` rows, reproducible by tree number."""
    tree = int(rows["tree"].iloc[0])
    x = rows.sort_values("row_key")[FEATURES].to_numpy(dtype=float)
    rng = np.random.default_rng([SEED, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, None, None)]
    while pending:
        members, depth, parent, side = pending.pop()
        node = len(nodes)
        if parent is not None:
            nodes[parent][side] = node
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        entry = [tree, node, -1, 0.0, -1, -1, depth, len(members)]
        nodes.append(entry)
        if depth >= limit or len(usable) == 0:
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        entry[2], entry[3] = feature, threshold
        left = part[:, feature] <= threshold
        pending.append((members[~left], depth + 1, node, 5))
        pending.append((members[left], depth + 1, node, 4))
    return pd.DataFrame(
        nodes, columns=["tree", "node", "feature", "threshold", "low", "high", "depth", "size"]
    )


def sample(rows: DataFrame, key: str, total: int) -> DataFrame:
    """``SAMPLE`` rows per tree, those with the smallest hash of (key, tree).

    A threshold on the hash cuts the fan-out to an expected ``OVERSAMPLE`` times
    what is needed before rows are emitted, so it stays at trees x 1,024 rows for
    any input size; up to that many rows it lets every draw pass. The exact cut then
    ranks what is left. ``fit`` checks that no tree got fewer rows than it should.
    """
    passing = min(2**64, 2**64 * OVERSAMPLE * SAMPLE // max(total, 1))
    ceiling = passing - 2**63 - 1
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(F.col(key), t, F.lit(SEED)).alias("draw")),
    )
    draws = F.filter(draws, lambda d: d["draw"] <= ceiling)
    order = Window.partitionBy("tree").orderBy("draw", "row_key")
    return (
        rows.select(F.col(key).alias("row_key"), *FEATURES, F.explode(draws).alias("d"))
        .select("row_key", *FEATURES, "d.tree", "d.draw")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE)
        .drop("draw", "place")
    )


def fit(rows: DataFrame, key: str, total: int) -> pd.DataFrame:
    """Node table of the forest. Its size is bounded by trees and sample size."""
    grown = sample(rows, key, total).groupBy("tree").applyInPandas(grow, NODE_SCHEMA)
    nodes = grown.toPandas().sort_values(["tree", "node"], ignore_index=True)
    roots = nodes.loc[nodes["depth"] == 0, "size"]
    if len(roots) != TREES or (roots != min(SAMPLE, total)).any():
        raise RuntimeError("the hash threshold left a tree fewer rows than its sample")
    return nodes


def scorer(nodes: pd.DataFrame, sample_size: int):
    """Column function: raw score in [-1, 0), lower is more anomalous."""
    start = nodes.groupby("tree")["node"].size().cumsum().shift(fill_value=0)
    base = nodes["tree"].map(start).to_numpy()
    feature = nodes["feature"].to_numpy()
    threshold = nodes["threshold"].to_numpy()
    low = np.where(feature < 0, -1, nodes["low"].to_numpy() + base)
    high = np.where(feature < 0, -1, nodes["high"].to_numpy() + base)
    depth_here = nodes["depth"].to_numpy() + mean_path(nodes["size"].to_numpy())
    roots = start.to_numpy()
    scale = float(mean_path(np.array([sample_size]))[0]) * len(roots)

    def score(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in (a, b, c, d)])
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for root in roots:
            at = np.full(len(x), root)
            inner = feature[at] >= 0
            while inner.any():
                f = feature[at[inner]]
                goes_low = x[row[inner], f] <= threshold[at[inner]]
                at[inner] = np.where(goes_low, low[at[inner]], high[at[inner]])
                inner = feature[at] >= 0
            total += depth_here[at]
        return pd.Series(-np.exp2(-total / scale) if scale else np.full(len(x), -0.5))

    return F.pandas_udf(score, "double")


def node_table(spark: SparkSession, nodes: pd.DataFrame) -> DataFrame:
    """The forest as a relation: one row per node, ``feature`` -1 for leaves."""
    return spark.createDataFrame(nodes, NODE_SCHEMA)


def walk(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """Every node that a row passes, by joins alone: the columns of ``rows``, which has
    ``tree``, and ``node``. A step down is one join with the node table."""
    value = F.coalesce(*(F.when(F.col("feature") == i, F.col(c).cast("double")) for i, c in enumerate(FEATURES)))
    goes = F.when(value <= F.col("threshold"), F.col("low")).otherwise(F.col("high"))
    inner = nodes.where(F.col("feature") >= 0).select("tree", "node", "feature", "threshold", "low", "high")
    at = rows.withColumn("node", F.lit(0))
    passed = [at]
    for _ in range(depth):
        at = at.join(F.broadcast(inner), ["tree", "node"]).select(*rows.columns, goes.alias("node"))
        passed.append(at)
    return reduce(DataFrame.unionByName, passed)


def walked_scores(hours: DataFrame, key: str, nodes: DataFrame, sample_size: int) -> DataFrame:
    """``key`` and raw score of every hour, from the node table by joins and sums."""
    rows = hours.select(key, *FEATURES, F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    n = F.col("size").cast("double")
    long = 2 * (F.log(n - 1) + EULER_GAMMA) - 2 * (n - 1) / n
    leaves = nodes.where(F.col("feature") < 0).select(
        "tree", "node", (F.col("depth") + F.when(n <= 1, 0.0).when(n == 2, 1.0).otherwise(long)).alias("path")
    )
    scale = float(mean_path(np.array([sample_size]))[0]) * TREES
    ended = walk(rows, nodes, DEPTH).join(F.broadcast(leaves), ["tree", "node"])
    return ended.groupBy(key).agg((-F.pow(F.lit(2.0), -F.sum("path") / scale)).alias("raw"))


def tree_checks(sampled: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per tree whether its nodes are what growing by their own sample gives.

    The sample is sent down the finished tree; then ``sizes`` says that every node has as
    many rows as it noted, ``splits`` that every threshold lies in the range of its
    feature and parts the rows, ``leaves`` that a node is a leaf only at the depth limit
    or where no feature varies.
    """
    spread = [F.max(c) > F.min(c) for c in FEATURES]
    lows, highs = (F.array(*(f(c).cast("double") for c in FEATURES)) for f in (F.min, F.max))
    found = (
        walk(sampled, nodes, DEPTH)
        .groupBy("tree", "node")
        .agg(
            F.count(F.lit(1)).alias("n"),
            reduce(lambda a, b: a | b, spread).alias("varies"),
            lows.alias("lows"),
            highs.alias("highs"),
        )
    )
    both = nodes.join(found, ["tree", "node"], "left")
    limit = F.ceil(F.log2(F.greatest(F.max("size").over(Window.partitionBy("tree")), F.lit(2)))).cast("int")
    both = both.withColumn("limit", limit)
    inner = F.col("feature") >= 0
    at = F.col("feature")
    return both.groupBy("tree").agg(
        F.max("size").alias("root_size"),
        F.every(F.coalesce(F.col("n"), F.lit(0)) == F.col("size")).alias("sizes"),
        F.every(~inner | ((F.get("lows", at) <= F.col("threshold")) & (F.col("threshold") < F.get("highs", at)))).alias("splits"),
        F.every(inner | (F.col("depth") == F.col("limit")) | ~F.col("varies")).alias("leaves"),
        F.every(F.col("depth") <= F.col("limit")).alias("depths"),
    )


def offset(scored: DataFrame, total: int) -> float:
    """Contamination quantile of the raw scores, linear between neighbours.

    The position is below 2 for every input size, so the three lowest scores hold
    it exactly and no sort of all scores is needed.
    """
    lowest = [r[0] for r in scored.orderBy("raw").select("raw").limit(3).collect()]
    position = (total - 1) * min(0.1, 2.0 / total)
    i = int(position)
    j = min(i + 1, len(lowest) - 1)
    return float(lowest[i] + (lowest[j] - lowest[i]) * (position - i))


def detect(hours: DataFrame, key: str = "bucket", min_rows: int = MIN_ROWS) -> DataFrame | None:
    """Score every hour and flag those below the offset; nothing below ``min_rows``.

    The scores are checkpointed: they feed the offset and the result, and an
    executor lost later must not trigger another fit.
    """
    hours = checkpoint(hours)
    total = hours.count()
    if total < min_rows:
        return None
    score = scorer(fit(hours, key, total), min(SAMPLE, total))
    scored = checkpoint(hours.withColumn("raw", score(*(F.col(c) for c in FEATURES))))
    above = F.col("raw") - F.lit(offset(scored, total))
    return scored.withColumn("anomaly_score", above).withColumn(
        "is_anomaly", F.col("anomaly_score") < 0
    )


def anomalies(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_anomaly").drop("raw", "is_anomaly").orderBy("bucket")
