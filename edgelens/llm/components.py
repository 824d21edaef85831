"""Connected components of an edge table, by repeated contraction.

In each round every node moves to the neighbour of lowest priority (a hash salted
with the round), or stays if its own is lowest, and the edges follow. Random
priorities shrink any graph by a constant share per round, long chains and stars
alike. A round is one aggregation with map-side minima and two joins on a node; the
side that a busy node fills is split by the runtime skew join. Each round is
checkpointed in the shared folder; the driver sees only whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from edgelens.session import checkpoint


def _priority(node: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(node), F.lit(turn)), F.col(node))


def components(edges: DataFrame, joined: int | None = None) -> DataFrame:
    """Columns ``node`` and ``root`` for the nodes of ``edges`` (columns ``a``, ``b``).

    Nodes of one component have one root, which is some node of it. Edges may repeat,
    run either way or lead back to their node. After the moves of ``joined`` rounds the roots
    found are checkpointed, as a plan over many rounds takes the driver long to make and hold;
    None follows all of them in one plan.
    """
    left = checkpoint(_undirected(edges.select("a", "b")))
    moves = []
    while not left.isEmpty():
        turn = len(moves)
        both = left.union(left.select("b", "a")).toDF("node", "near")
        best = both.groupBy("node").agg(F.min(_priority("near", turn)).alias("best"))
        move = checkpoint(
            best.select(
                "node",
                F.when(F.col("best.near") == F.col("node"), F.col("node"))
                .when(F.col("best") < _priority("node", turn), F.col("best.near"))
                .otherwise(F.col("node"))
                .alias("to"),
            )
        )
        left = checkpoint(
            _undirected(
                left.join(move.toDF("a", "to_a"), "a")
                .join(move.toDF("b", "to_b"), "b")
                .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            )
        )
        moves.append(move)
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    *earlier, last = moves
    found = last.select("node", F.col("to").alias("root"))
    for back, move in enumerate(reversed(earlier), 1):
        later = found.select(F.col("node").alias("to"), F.col("root"))
        found = move.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
        if joined and back % joined == 0:
            found = checkpoint(found)
    return found


def _undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, from the smaller to the larger node."""
    return (
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
