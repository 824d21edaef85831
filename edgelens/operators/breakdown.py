"""Frequency tables over event dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from edgelens.session import checkpoint

# Length of each list in the event breakdown; None keeps all.
BREAKDOWN_LIMITS = {
    "action": None,
    "source": None,
    "country": 10,
    "request_path": 15,
    "user_agent": 10,
}


def value_counts(
    df: DataFrame, column: str, top: int | None = None, weight: str | None = None
) -> DataFrame:
    """Occurrences per non-NULL value, most frequent first, ties by value.

    ``weight`` is a column that says how many equal rows a row stands for.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(n.alias("count"))
        .orderBy(F.desc("count"), column)
    )
    return counts if top is None else counts.limit(top)


TOTAL = "*"


def _counts(fe: DataFrame) -> DataFrame:
    """(dimension, value, count), and the number of events as a dimension of its own."""
    pairs = F.array(
        F.struct(F.lit(TOTAL).alias("dimension"), F.lit("").alias("value")),
        *(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in BREAKDOWN_LIMITS),
    )
    return (
        fe.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def breakdown(fe: DataFrame) -> DataFrame:
    """All lists of the event breakdown: (dimension, value, count, position).

    Events are read once: each fans out to its (dimension, value) pairs, which
    combine map-side, and the counts are kept. Dimensions with a limit may hold
    any number of values, so their rank filter has a constant bound, which lets
    it run before the shuffle as well as after.
    """
    counts = checkpoint(_counts(fe))
    order = Window.partitionBy("dimension").orderBy(F.desc("count"), "value")
    limits = {c: top for c, top in BREAKDOWN_LIMITS.items() if top is not None}
    own_limit = F.coalesce(*(F.when(F.col("dimension") == c, top) for c, top in limits.items()))
    has_limit = F.col("dimension").isin(list(limits))
    limited = (
        counts.where(has_limit)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= max(limits.values()))
        .where(F.col("position") <= own_limit)
    )
    whole = counts.where(~has_limit).withColumn("position", F.row_number().over(order))
    return limited.unionByName(whole)
