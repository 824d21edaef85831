"""Near-duplicate vectors by int8 tile products with exact rechecks.

Equal vectors, told by two independent 64-bit digests, are one class with a number of
copies. Classes are dealt into blocks by digest. The vectors are moved once, into their
blocks, which are stored; all else is done on digests and keys. Every pair of blocks is a
tile: each part of the stored blocks is read beside each other part and their tiles follow
one another in a task, so nothing but the blocks themselves is written, whatever the number
of tiles. In a tile the unit vectors u = s q + e are multiplied in
their int8 form q. As |u| = 1, the true cosine is at most

    s t (q . r) + |e| + |f| + |e| |f|

for the norms |e|, |f| of the quantisation errors. Only pairs for which that
reaches the threshold are computed again, from the given components in double precision.
Vectors of a block are multiplied in the order of their scale: neighbours then need nearly
the same product, and one comparison per row and strip rules out most pairs.

A task returns, per class, its number of links in its tiles, and a spanning forest of its
links, so the output stays in proportion to the parts however many vectors are alike. The work
is quadratic in the number of classes, as the method is.

Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do vectors of different lengths with each other. Rows that repeat a vec_id
are separate vectors. An empty table gives no rows. The table is read twice and must
give the same rows each time, as files do; a class without its vector fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from edgelens.llm.common import bound_batches
from edgelens.llm.components import components
from edgelens.session import delete, scratch_path, written

THRESHOLD = 0.9
# Vectors of a block, and their bytes, on average at most.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
# Rows and columns of a tile multiplied, and pairs rechecked, at a time.
STRIP, WIDE = 512, 1024
RECHECKED = 1 << 15
# Every part of the blocks meets every part in one task: bytes of a part, and parts while
# there are few blocks. Blocks of a file, which a reader may hold at once.
PART_BYTES, FEW_PARTS, FILE_BLOCKS = 32 << 20, 8, 8
# Vectors a task remembers to leave out their copies.
REMEMBERED = 1 << 17
# Rounds of the components that one plan follows.
JOINED = 3
# Products of int8 numbers whose sums a float holds exactly.
EXACT_DIMS = 1024
# Rounding of the double arithmetic in the bound.
SLACK = 1e-9

DIGESTS = ["dims", "one", "two"]
PACKED = "dims int, block int, n int, keys binary, copies binary, vectors binary"


class Block:
    """Vectors of a block, and their unit int8 form, scales and error norms by scale."""

    def __init__(self, n: int, dims: int, keys: bytes, copies: bytes, vectors: bytes):
        self.keys, self.copies = np.frombuffer(keys, np.int64), np.frombuffer(copies, np.int64)
        width = len(vectors) // (n * dims)
        raw = np.frombuffer(vectors, f"<f{width}").astype(np.float64).reshape(n, dims)
        self.scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.scaled, self.scaled))
        scale = np.abs(self.scaled).max(axis=1) / self.norm / 127.0
        # Places of the vectors in the order of their scale, which all below follow.
        self.order = np.argsort(scale, kind="stable")
        self.scale = scale[self.order]
        unit = self.scaled[self.order] / self.norm[self.order, None]
        codes = np.rint(unit / self.scale[:, None])
        unit -= codes * self.scale[:, None]
        self.error = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        # Whole numbers from -127 to 127; as floats they can be multiplied at once.
        self.codes = codes.astype(np.float32)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    out = None
    for at in range(0, a.shape[1], EXACT_DIMS):
        x, y = (side[:, at : at + EXACT_DIMS].astype(np.float32, copy=False) for side in (a, b))
        part = x @ y.T
        out = part if out is None else out.astype(np.float64) + part
    return out


def least_products(a: Block, rows: slice, b: Block, columns: slice, threshold: float) -> np.ndarray:
    """Per row, a number that no product with one of the columns whose bound reaches the threshold is below."""
    scale, error = b.scale[columns], b.error[columns].max()
    lacking = threshold - SLACK - a.error[rows] - (1 + a.error[rows]) * error
    return np.floor(lacking / (a.scale[rows] * np.where(lacking > 0, scale.max(), scale.min())))


def candidates(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs whose cosine may reach the threshold, strip by strip."""
    for at in range(0, len(a.keys), STRIP):
        rows = slice(at, at + STRIP)
        for left in range(0, len(b.keys), WIDE):
            columns = slice(left, left + WIDE)
            products = code_products(a.codes[rows], b.codes[columns])
            least = least_products(a, rows, b, columns, threshold)
            high = np.flatnonzero(products.max(axis=1) >= least)
            i, j = np.nonzero(products[high] >= least[high, None])
            i = high[i]
            x, y = a.error[rows][i], b.error[columns][j]
            bound = products[i, j] * a.scale[rows][i] * b.scale[columns][j] + x + (1 + x) * y + SLACK
            near = bound >= threshold
            yield a.order[rows][i[near]], b.order[columns][j[near]]


def links(a: Block, b: Block, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j in candidates(a, b, threshold):
        if a is b:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), RECHECKED):
            x, y = i[at : at + RECHECKED], j[at : at + RECHECKED]
            cosine = np.einsum("ij,ij->i", a.scaled[x], b.scaled[y]) / (a.norm[x] * b.norm[y])
            near = cosine >= threshold
            if near.any():
                yield x[near], y[near]


class Forest:
    """Spanning forest of links that arrive in batches."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def grow(self, n: int) -> None:
        """Nodes behind the others, without links."""
        self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + n)])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that are not the least of their tree, and that one."""
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            if (a == b).all():
                return
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


class Tiles:
    """Link counts and a forest of the links of all tiles of a task."""

    def __init__(self, threshold: float):
        self.threshold, self.forest = threshold, Forest(0)
        self.blocks, self.starts = {}, {}
        self.counts = np.zeros(0, np.int64)

    def block(self, dims: int, block: int, n: int, keys: bytes, copies: bytes, vectors: bytes) -> tuple[Block, int]:
        """A block, prepared once, and the place of its first vector among all."""
        if (dims, block) not in self.blocks:
            self.blocks[dims, block] = Block(n, dims, keys, copies, vectors)
            self.starts[dims, block] = len(self.counts)
            self.forest.grow(n)
            self.counts = np.concatenate([self.counts, np.zeros(n, np.int64)])
        return self.blocks[dims, block], self.starts[dims, block]

    def add(self, a: Block, at: int, b: Block, to: int) -> None:
        shift = 0 if a is b else len(a.keys)
        forest, n_a, n_b = Forest(shift + len(b.keys)), self.counts[at:], self.counts[to:]
        for i, j in links(a, b, self.threshold):
            np.add.at(n_a, i, b.copies[j])
            np.add.at(n_b, j, a.copies[i])
            forest.add(i, j + shift)
        ends = [np.where(x < shift, x + at, x - shift + to) for x in forest.edges()]
        if len(ends[0]):
            self.forest.add(*ends)

    def table(self) -> pa.RecordBatch:
        """Link counts (``b`` null) and forest edges."""
        keys = np.concatenate([np.zeros(0, np.int64), *(block.keys for block in self.blocks.values())])
        linked, (moved, root) = np.flatnonzero(self.counts), self.forest.edges()
        zeros = np.zeros(len(moved), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([keys[linked], keys[moved]])),
                pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(keys[root])]),
                pa.array(np.concatenate([self.counts[linked], zeros])),
            ],
            names=["a", "b", "n"],
        )


class Packing:
    """A block under way: its classes, and one vector of each, in the order of their digests."""

    def __init__(self, place: tuple[int, int]):
        self.place, self.last, self.classes, self.names, self.vectors = place, None, [], [], []

    def add(self, part: pa.RecordBatch) -> None:
        named = pc.is_valid(part.column("key"))
        given, named = part.filter(pc.invert(named)), part.filter(named)
        self.classes.append(np.stack([named.column(c).to_numpy() for c in (*DIGESTS[1:], "key", "copies")]))
        if len(given):
            names = np.stack([given.column(c).to_numpy() for c in DIGESTS[1:]])
            before = np.column_stack([names[:, :1] if self.last is None else self.last, names[:, :-1]])
            new = (names != before).any(axis=0)
            new[0] |= self.last is None
            self.last = names[:, -1:]
            self.names.append(names[:, new])
            flat = given.column("vector").filter(pa.array(new)).flatten()
            self.vectors.append(flat.to_numpy(zero_copy_only=False))

    def row(self) -> pa.RecordBatch:
        one, two, keys, copies = np.concatenate(self.classes, axis=1)
        names = np.concatenate([np.zeros((2, 0), np.int64), *self.names], axis=1)
        if not np.array_equal(names, [one, two]):
            raise RuntimeError("the vectors were not the same when read again")
        numbers = [pa.array([x], pa.int32()) for x in (*self.place, len(keys))]
        arrays = [keys.tobytes(), copies.tobytes(), np.concatenate(self.vectors).tobytes()]
        columns = [*numbers, *(pa.array([x], pa.binary()) for x in arrays)]
        return pa.RecordBatch.from_arrays(columns, names=["dims", "block", "n", "keys", "copies", "vectors"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block, from rows of classes and vectors in the order of block and digests."""
    held = None
    for batch in batches:
        places = np.stack([batch.column(c).to_numpy() for c in ("dims", "block")])
        cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
        for at, to in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if at == to:
                continue
            place = tuple(places[:, at].tolist())
            if held is None or held.place != place:
                if held is not None:
                    yield held.row()
                held = Packing(place)
            held.add(batch.slice(at, to - at))
    if held is not None:
        yield held.row()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without copies of what the task remembers, so a common vector moves a few times only."""
    seen = set()
    for batch in batches:
        names, kept = zip(*(batch.column(c).to_pylist() for c in DIGESTS), strict=True), []
        for at, name in enumerate(names):
            if name not in seen:
                seen.add(name)
                kept.append(at)
        yield batch.take(pa.array(kept, pa.int64()))
        if len(seen) > REMEMBERED:
            seen.clear()


def block_size(width: int) -> Column:
    """Vectors of a block, for components of so many bytes."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / (width * F.col("dims")))))


def tile_links(classes: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Stored counts and forest edges of all tiles.

    ``classes`` has dims, one, two, key and copies; ``vectors`` a vector of each class or more, by dims, one and two.
    """
    spark, kind = classes.sparkSession, vectors.schema["vector"].dataType
    width = 4 if isinstance(kind.elementType, T.FloatType) else 8
    totals = classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select("dims", "n", F.ceil(F.col("n") / block_size(width)).cast("int").alias("blocks"))
    totals = written(totals, "totals")
    named = classes.select(*DIGESTS, "key", "copies", F.lit(None).cast(kind).alias("vector"))
    no = F.lit(None).cast("bigint")
    given = vectors.mapInArrow(_once, vectors.schema).withColumns({"key": no, "copies": no})
    # One row per length of vectors.
    dealt = named.unionByName(given).join(F.broadcast(totals.select("dims", "blocks")), "dims")
    dealt = dealt.withColumn("block", F.pmod("one", "blocks").cast("int")).drop("blocks")
    laid = dealt.repartition("dims", "block").sortWithinPartitions("dims", "block", "one", "two")
    path = scratch_path(spark, "blocks")
    laid.mapInArrow(_pack, PACKED).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)

    n_blocks, n_bytes = totals.agg(
        F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("dims") * width), F.lit(0))
    ).first()
    parts = int(max(1, min(n_blocks, FEW_PARTS), -(-n_bytes // PART_BYTES)))
    packed = spark.read.schema(PACKED).parquet(path).coalesce(parts)
    a, b = (packed.select(*(F.col(c).alias(f"{c}_{side}") for c in packed.columns)) for side in "ab")
    # Each pair of blocks once, half of them from either side, so that tasks have like shares.
    x, y = F.col("block_a"), F.col("block_b")
    mine = (F.col("dims_a") == F.col("dims_b")) & ((x == y) | (((x + y) % 2 == 0) == (x < y)))
    pairs = a.join(b.hint("shuffle_replicate_nl"), mine)
    columns = packed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = Tiles(threshold)
        for batch in batches:
            for row in batch.to_pylist():
                tiles.add(*(x for side in "ab" for x in tiles.block(*(row[f"{c}_{side}"] for c in columns))))
        yield tiles.table()

    found = written(pairs.mapInArrow(run, "a bigint, b bigint, n bigint"), "links")
    delete(spark, path)
    return found


def _kept_type(rows: DataFrame, vector: str) -> T.ArrayType:
    """Floats stay floats, which halves what tiles move; all else becomes double."""
    given = rows.schema[vector].dataType.elementType
    return T.ArrayType(given if isinstance(given, T.FloatType) else T.DoubleType())


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """vec_id, n_links, component_id and kept (first of its component) of every row."""
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast(_kept_type(rows, vector)).alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    digests = [F.size("vector"), F.xxhash64(F.lit(1), "vector"), F.xxhash64(F.lit(2), "vector")]
    digests = [F.when(F.col("usable"), x).alias(c) for c, x in zip(DIGESTS, digests, strict=True)]
    rows = rows.withColumn("usable", usable).select("vec_id", "usable", *digests, "vector")
    ids = written(rows.drop("vector"), "ids")
    good = ids.where("usable")
    classes = good.groupBy(*DIGESTS).agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    vectors = rows.where("usable").select(*DIGESTS, "vector")
    found = tile_links(classes.select(*DIGESTS, "key", "copies"), vectors, threshold)
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    groups = components(found.where(F.col("b").isNotNull()).select("a", "b"), JOINED).toDF("key", "root")
    members = classes.join(groups, "key", "left").join(counts, "key", "left").select(
        *DIGESTS,
        "first",
        F.coalesce("root", "key").alias("root"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    members = written(members, "members")
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = members.join(smallest, "root").select(*DIGESTS, "n_links", "component_id")
    linked = good.join(labelled, DIGESTS).select("vec_id", "n_links", "component_id")
    alone = ids.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
