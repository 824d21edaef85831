"""Shards by vector bin packing: bytes, tokens and rows balanced together.

Documents of equal text form a group. A group goes, whole, to the shard where the dot
product of its (bytes, tokens, rows) with the shard's residual capacity is highest,
largest groups first. Two rules keep that bounded for any corpus:

* Groups that hold less than 1/``BUNDLES`` of the corpus in every dimension are placed
  in bundles by hash, ``BUNDLES`` at most, so the driver places at most about
  4 x ``BUNDLES`` items, whose sums Spark has formed.
* A group that holds more than half a shard in some dimension could not be balanced.
  Its rows are dealt into pieces of at most a quarter of a shard, placed one by one.

The law is ``bytes``: the shards' sizes are near equal. A document's size is its UTF-8
bytes plus one; null text has no bytes and the checksum of none, and is a group of its
own. Rows that repeat a doc_id, or repeat altogether, are rows like others. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.llm.common import byte_count, word_count
from edgelens.session import written

SHARDS = 16
BUNDLES = 8192
# Rows numbered in one task on average.
CELL_ROWS = 2000
DIMENSIONS = ["size", "tokens", "n"]


def group_key(text: Column) -> list[Column]:
    """128 bits that equal texts share."""
    return [F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("g2")]


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: shares of the corpus in each dimension)."""
    order = np.lexsort([np.arange(len(items)), -items.max(axis=1)])
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    chosen = np.zeros(len(items), np.int64)
    for i in order:
        best = int(np.argmax(residual @ items[i]))
        chosen[i] = best
        residual[best] -= items[i]
    return chosen


def _shares(totals) -> list[Column]:
    return [F.col(d) / F.lit(float(max(totals[d] or 0, 1))) for d in DIMENSIONS]


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (g1, g2, row, size, tokens, n = 1) with their shard."""
    spark = rows.sparkSession
    totals = rows.agg(*(F.sum(d).alias(d) for d in DIMENSIONS)).first()
    sums = [F.sum(d).alias(d) for d in DIMENSIONS]
    share = F.greatest(*_shares(totals))
    # At most BUNDLES groups per dimension hold 1/BUNDLES or more of it.
    large = (
        rows.groupBy("g1", "g2")
        .agg(*sums)
        .where(share >= 1.0 / BUNDLES)
        .select(
            "g1",
            "g2",
            F.when(share > 0.5 / shards, F.ceil(share * 4 * shards)).otherwise(1).cast("bigint").alias("pieces"),
        )
    )
    bounded = F.broadcast(written(large, "large-groups"))
    alone = F.xxhash64("g1", "g2", F.pmod(F.xxhash64("row"), F.col("pieces")))
    item = F.when(F.col("pieces").isNull(), F.pmod(F.col("g1"), F.lit(BUNDLES))).otherwise(alone)
    rows = rows.join(bounded, ["g1", "g2"], "left").withColumn("item", item).drop("pieces")
    items = rows.groupBy("item").agg(*sums).select("item", *(s.alias(d) for s, d in zip(_shares(totals), DIMENSIONS)))
    placed = items.toPandas().sort_values("item", ignore_index=True)
    placed["shard"] = place(placed[DIMENSIONS].to_numpy(float), shards)
    table = spark.createDataFrame(
        list(zip(placed["item"].tolist(), placed["shard"].tolist())), "item bigint, shard int"
    )
    return rows.join(F.broadcast(table), "item")


def numbered(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """``rows`` with a gapless ``slot`` in their shard.

    Rows are numbered within cells of about ``CELL_ROWS`` rows; the cells' counts
    give the number each cell starts at.
    """
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n_cell"))
    starts = starts.select("shard", "cell", F.coalesce(F.sum("n_cell").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row"))
    ranked = rows.withColumn("within", within)
    return ranked.join(starts, ["shard", "cell"]).withColumn("slot", F.col("start") + F.col("within") - 1)


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: its size, checksum, shard and slot."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (byte_count(F.col(text)) + 1).alias("size"),
        word_count(F.col(text)).alias("tokens"),
        F.lit(1).cast("bigint").alias("n"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        *group_key(F.col(text)),
    )
    # The row number deals out pieces and slots, so it is made once and stored.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    placed = written(assign(rows, shards), "placed")
    return numbered(placed, rows.count(), shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
