"""Near-duplicate texts by SimHash and multi-index hashing.

Words are runs of bytes outside ASCII blanks, A-Z lower-cased; shingles are three
words joined by a blank, repeats included (a text of fewer words is one shingle). A
fingerprint bit is 1 if it is set in over half of the shingles' XXH64 values (seed
42). Null texts and texts without words have fingerprint zero and are linked like
any other. Fingerprints link at ``RADIUS`` or fewer differing bits.

The index works on distinct fingerprints. Each is cut into two halves of 32 bits. Of
two fingerprints that differ in at most three bits, one half differs in at most one,
so it is found by looking up, for each half, the half itself and its 32 neighbours.
A pair at distance one in a half is looked up from the side whose bit is 0 only.

A half that many fingerprints share would give many pairs. Such fingerprints are the
variants of one text and mostly chains of single bit changes, so links of one bit are
found first, by whole fingerprints: that lookup gives at most 64 partners for any
data. The halves are then only compared across the components this leaves, and only
verified links leave the join. No bucket is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from edgelens.llm.common import fresh, with_columns
from edgelens.llm.components import components
from edgelens.session import written

WORDS = 3
SEED = 42
RADIUS = 3
# Shingles whose bits are spread out at a time.
SPREAD = 1 << 18


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - WORDS + 1]
    spans = zip(starts.tolist(), (ends[WORDS - 1 :] - 1).tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority of each bit, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SPREAD):
        part = np.ascontiguousarray(hashes[at : at + SPREAD]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    def compute(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array([fingerprint(shingle_hashes(t)) for t in texts], pa.int64())]

    return with_columns(docs, text, T.StructType([T.StructField(name, T.LongType())]), compute)


def _flips(value: str, bits: int) -> Column:
    """``value`` with one of its 0 bits set, for each of them."""
    one = F.lit(1).cast("bigint")
    flipped = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col(value).bitwiseOR(F.call_function("shiftleft", one, i))
    )
    return F.filter(flipped, lambda f: f != F.col(value))


def one_bit_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints that differ in a single bit."""
    lookups = prints.select(F.col("print").alias("a"), F.explode(_flips("print", 64)).alias("b"))
    return lookups.join(prints.select(F.col("print").alias("b")), "b").select("a", "b")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links up to ``RADIUS`` bits between different groups (columns ``print``, ``part``)."""
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.col("print").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("print", 32).alias("half")),
    )
    table = prints.select("print", "part", F.inline(halves))
    near = table.select(
        F.col("print").alias("a"),
        F.col("part").alias("part_a"),
        "side",
        F.col("half").alias("own"),
        F.explode(F.concat(F.array("half"), _flips("half", 32))).alias("half"),
    )
    found = table.select(F.col("print").alias("b"), F.col("part").alias("part_b"), "side", "half")
    same_half = F.col("own") == F.col("half")
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (
        near.join(found, ["side", "half"])
        .where((F.col("part_a") != F.col("part_b")) & (distance <= RADIUS) & (~same_half | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )


def groups(prints: DataFrame) -> DataFrame:
    """Columns ``print`` and ``group``: distinct fingerprints and their group's key."""
    close = written(components(one_bit_links(prints)).toDF("print", "part"), "one-bit")
    parted = prints.join(close, "print", "left").select("print", F.coalesce("part", "print").alias("part"))
    parted = written(parted, "parted")
    across = parted.select(F.col("print").alias("a"), F.col("part").alias("b"))
    links = ball_links(parted)
    joined = components(links.union(across)).toDF("print", "group")
    return parted.join(joined, "print", "left").select("print", F.coalesce("group", "print").alias("group"))


def labelled_prints(rows: DataFrame, name: str, doc_id: str) -> DataFrame:
    """Columns ``print``, ``group`` and ``smallest``, the smallest doc_id of the group."""
    firsts = rows.groupBy(F.col(name).alias("print")).agg(F.min(doc_id).alias("first"))
    firsts = written(firsts, "prints")
    members = firsts.join(groups(firsts.select("print")), "print")
    smallest = members.groupBy("group").agg(F.min("first").alias("smallest"))
    return members.join(smallest, "group").select("print", "group", "smallest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that is
    reachable over links, of every row.

    Rows without doc_id take part; they give no component its id unless it holds
    nothing else, then it is null. Rows that repeat a doc_id have a component each.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(with_fingerprint(rows, "text", "print").select("doc_id", "print"), "prints")
    joined = rows.join(labelled_prints(rows, "print", "doc_id"), "print")
    digits = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return joined.select("doc_id", digits.alias("fingerprint"), F.col("smallest").alias("component_id"))


def firsts_only(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that of smallest doc_id, with all its columns.

    Rows of one doc_id and text count as one document; where a doc_id carries several
    texts, each group it leads keeps one of them. A group without any doc_id keeps one
    row too.
    """
    key, same = fresh(docs, "key"), fresh(docs, "same")
    named = docs.withColumns(
        {key: F.coalesce(F.col(doc_id).cast("string"), F.lit("")), same: F.xxhash64(F.col(text))}
    )
    rows = named.select(F.col(doc_id).alias("id"), F.col(key).alias("key"), F.col(same).alias("same"), F.col(text).alias("text"))
    rows = written(with_fingerprint(rows, "text", "print").drop("text"), "prints")
    # Nulls last; combined by fingerprint first, so that no row is joined to its group.
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "print", "key", "same")).alias("first")
    firsts = written(rows.groupBy("print").agg(first), "firsts")
    members = firsts.join(groups(firsts.select("print")), "print")
    winners = members.groupBy("group").agg(F.min("first").alias("first")).select("first.key", "first.same")
    winners = written(winners.distinct().toDF(key, same), "winners")
    return named.join(winners, [key, same]).dropDuplicates([key, same]).select(*docs.columns)
