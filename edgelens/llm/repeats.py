"""Removal of repeated 400-byte strings by prefix-free parsing.

The rule: a byte goes if it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else in the corpus, in the same text or another. Strings lie within one text
and are judged on the input. Texts are UTF-8 bytes; null counts as empty.

Parsing. A trigger is a place whose next ``GRAM`` bytes hash to a multiple of 64. The
triggers cut a text into phrases, and depend on nothing else, so equal strings hold the
same triggers. A string that starts in a phrase is that phrase's suffix followed by a
prefix of the parse from the next trigger on. Strings without such a trigger are cut by
denser ones (multiples of 8), and those without these start at themselves.

Order. Prefix-free parsing sorts the phrases' suffixes and the parse's suffixes and
reads the corpus order of all strings from the two orders. Here only ties of that order
matter, over 400 bytes, so ranks are replaced by digests of the bounded suffixes, which
Spark counts instead of sorting: no order of a corpus has to meet in one place.

Counting. The strings that start up to ``SIZES[0]`` bytes before a trigger form a node.
What its strings share is its core, what they span together its span. A core that occurs
once holds no repeat. A span that occurs twice holds nothing else. Only nodes in between,
which lie at the ends of repeats, are cut into smaller nodes, down to single strings.
Where a span occurs more than once, one of its nodes goes on with the others as a partner,
so that no pair is missed. A class is known by two independent 64-bit digests.

The numbered rows are stored once, so that every pass reads the same number with the same
text however its scan is split. Rows that repeat a doc_id are texts like others. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from edgelens.llm.common import bound_batches
from edgelens.session import written

LENGTH = 400
GRAM = 8
# Strings of a node, from coarse to single.
SIZES = (128, 8, 1)
# A trigger's hash has as many leading zero bits; the denser ones have fewer.
SPARSE_BITS, DENSE_BITS = 6, 3
# Places hashed at a time.
HASHED = 1 << 19
# Entries (of about 100 bytes in memory) in the lists of a stored join side that is
# still broadcast; beyond, the join is shuffled.
SMALL_ENTRIES = 1_000_000

# Strings of a node start lo to hi bytes before place b of the text.
NODE = "core bigint, span bigint, row bigint, b bigint, lo bigint, hi bigint, parent bigint, partner boolean"
_NODE_NAMES = ["core", "span", "row", "b", "lo", "hi", "parent", "partner"]


def trigger_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse and dense trigger places; the sparse ones are dense ones too."""
    places, sparse = [], []
    for at in range(0, len(text) - GRAM + 1, HASHED):
        part = text[at : at + HASHED + GRAM - 1]
        grams = np.empty(len(part) - GRAM + 1, np.uint64)
        for k in range(min(GRAM, len(grams))):
            lane = grams[k::GRAM]
            lane[:] = np.frombuffer(part, "<u8", len(lane), k)
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        lead = (grams >> np.uint64(64 - SPARSE_BITS)).astype(np.uint8)
        found = np.flatnonzero(lead < 1 << (SPARSE_BITS - DENSE_BITS))
        places.append(found + at)
        sparse.append(lead[found] == 0)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    dense = np.concatenate(places)
    return dense[np.concatenate(sparse)], dense


def anchored(places: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Strings by the first trigger they hold, and stretches of strings without one.

    Strings start from ``first`` to ``last`` in each stretch; ``places`` are triggers in
    order, with the stretch they lie in. Returns (b, lo, hi) and (first, last) of the rest.
    """
    reach = LENGTH - GRAM
    fresh = np.ones(len(places), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    before = np.where(fresh, first[owner] - 1, np.concatenate([[0], places[:-1]])[: len(places)])
    high = np.minimum(places, last[owner])
    low = np.maximum(before + 1, places - reach)
    some = low <= high
    nodes = places[some], (places - high)[some], (places - low)[some]
    final = first - 1
    final[owner] = np.maximum.reduceat(places, np.flatnonzero(fresh))[np.cumsum(fresh) - 1] if len(places) else 0
    gap_from = np.concatenate([before + 1, final + 1])
    gap_to = np.concatenate([np.minimum(places - reach - 1, last[owner]), last])
    some = gap_from <= gap_to
    return nodes, (gap_from[some], gap_to[some])


def parse(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, lo, hi) of all strings of the texts that lie side by side in ``text``."""
    first, last = starts, ends - LENGTH
    usable = first <= last
    sparse, dense = trigger_places(text)
    owner = np.searchsorted(starts, sparse, "right") - 1
    inside = (sparse + GRAM <= ends[owner]) & usable[owner] if len(sparse) else np.zeros(0, bool)
    nodes, rest = anchored(sparse[inside], owner[inside], first.copy(), last)
    parts = [nodes]
    # The denser triggers of each stretch that the sparse ones leave.
    at = [np.searchsorted(dense, rest[0], "left"), np.searchsorted(dense, rest[1] + LENGTH - GRAM, "right")]
    count = np.maximum(at[1] - at[0], 0)
    owner = np.repeat(np.arange(len(count)), count)
    pick = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(at[0], count)
    nodes, rest = anchored(dense[pick], owner, rest[0], rest[1])
    parts.append(nodes)
    count = rest[1] - rest[0] + 1
    alone = np.repeat(rest[0], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    parts.append((alone, np.zeros_like(alone), np.zeros_like(alone)))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def cut(b: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: int):
    """Nodes cut at multiples of ``size``: (place of the whole, b, lo, hi, grid)."""
    count = hi // size - lo // size + 1
    whole = np.repeat(np.arange(len(b)), count)
    step = np.arange(len(whole)) - np.repeat(np.cumsum(count) - count, count)
    grid = (lo[whole] // size + step) * size
    return whole, b[whole], np.maximum(lo[whole], grid), np.minimum(hi[whole], grid + size - 1), grid


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _digests(texts: Iterable[bytes], start, end, seed) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    rows = zip(texts, start.tolist(), end.tolist(), seed.tolist(), strict=False)
    return _signed([digest(text[x:y], n) for text, x, y, n in rows])


def cores(texts: Iterable[bytes], b, grid, size: int) -> np.ndarray:
    """Digest of what the strings of each node share; one text per node."""
    end = b - np.minimum(grid + size - 1, LENGTH - GRAM) + LENGTH
    return _digests(texts, b - grid, end, 1000 * size + grid)


def spans(texts: Iterable[bytes], b, lo, hi) -> np.ndarray:
    """Digest of what the strings of each node span."""
    return _digests(texts, b - hi, b - lo + LENGTH, 1_000_000 + lo)


def _side_by_side(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    texts = [t or b"" for t in texts]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return b"".join(texts), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _nodes(batch: pa.RecordBatch, spanned: bool) -> pa.RecordBatch:
    rows, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
    text, starts, ends = _side_by_side(texts)
    _, b, lo, hi, grid = cut(*parse(text, starts, ends), SIZES[0])
    core = cores(repeat(text), b, grid, SIZES[0])
    if not spanned:
        return pa.RecordBatch.from_arrays([pa.array(core)], names=["core"])
    # A string lies in the text in which it starts.
    owner = np.searchsorted(starts, b - hi, "right") - 1
    arrays = [core, spans(repeat(text), b, lo, hi), rows[owner], b - starts[owner], lo, hi, np.full(len(b), -1)]
    arrays = [pa.array(a) for a in arrays] + [pa.array(np.zeros(len(b), bool))]
    return pa.RecordBatch.from_arrays(arrays, names=_NODE_NAMES)


def text_nodes(rows: DataFrame, spanned: bool) -> DataFrame:
    """Coarse nodes of all texts (``row``, ``text``), or only their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _nodes(batch, spanned)

    return rows.select("row", "text").mapInArrow(run, NODE if spanned else "core bigint")


def settle(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated nodes, nodes to be cut further) of the nodes that share a core."""
    active = ~F.col("partner")
    by_span = nodes.groupBy("core", "span").agg(
        F.count(F.lit(1)).alias("n"), F.max(active).alias("active"), F.min(F.struct("row", "b", "lo")).alias("chosen")
    )
    by_span = written(by_span, "spans")
    open_here = F.col("active") & (F.col("n") == 1)
    by_core = by_span.groupBy("core").agg(F.count(F.lit(1)).alias("spans"), F.max(open_here).alias("wanted"))
    # Stored, so that the join can split a core that many spans share.
    by_core = written(by_core.where((F.col("spans") > 1) & F.col("wanted")).select("core", "wanted"), "cores")
    classes = by_span.join(by_core, "core", "left").where((F.col("n") > 1) | F.col("wanted"))
    found = written(nodes.join(classes.drop("active"), ["core", "span"]), "found")
    repeated = found.where((F.col("n") > 1) & active).select("row", "b", "lo", "hi")
    goes_on = (F.col("n") == 1) | (F.struct("row", "b", "lo") == F.col("chosen"))
    further = found.where(F.col("wanted") & goes_on).select(
        "row", "b", "lo", "hi", "parent", (F.col("partner") | (F.col("n") > 1)).alias("partner")
    )
    return repeated, further


def _side(df: DataFrame, lists: str) -> DataFrame:
    """A stored side of a join: broadcast if its lists hold few entries, else shuffled."""
    entries = df.agg(F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()[0]
    return F.broadcast(df) if entries <= SMALL_ENTRIES else df


def with_context(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the bytes they span, as ``parent`` nodes numbered anew."""
    per_row = nodes.groupBy("row").agg(F.collect_set(F.struct("b", "lo", "hi", "partner")).alias("nodes"))
    per_row = written(per_row, "open-nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "b", "lo", "hi", "partner", "context"]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows_of = zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True)
            nodes = [(row, text, x["b"], x["lo"], x["hi"], x["partner"]) for row, text, found in rows_of for x in found]
            context = [text[b - hi : b - lo + LENGTH] for _, text, b, lo, hi, _ in nodes]
            out = [[n[k] for n in nodes] for k in (0, 2, 3, 4, 5)] + [context]
            types = [pa.int64()] * 4 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    joined = rows.select("row", "text").join(_side(per_row, "nodes"), "row").select("row", "text", "nodes")
    made = joined.mapInArrow(run, "row bigint, b bigint, lo bigint, hi bigint, partner boolean, context binary")
    return made.withColumn("parent", F.monotonically_increasing_id())


def child_nodes(parents: DataFrame, parts: DataFrame | None, size: int) -> DataFrame:
    """Nodes of ``size`` strings below ``parts`` of the parents, or below all of each."""
    if parts is None:
        whole = F.array(F.struct("lo", "hi", "partner"))
        listed = parents.withColumn("parts", whole)
    else:
        grouped = parts.groupBy("parent").agg(F.collect_set(F.struct("lo", "hi", "partner")).alias("parts"))
        listed = parents.join(_side(written(grouped, "open-parts"), "parts"), "parent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, row, b, high = (batch.column(i).to_numpy() for i in range(4))
            contexts, parts = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            lo, hi = (np.array([x[k] for p in parts for x in p], np.int64) for k in ("lo", "hi"))
            partner = np.array([x["partner"] for p in parts for x in p], bool)
            # In its context, the anchor of a parent lies ``high`` bytes from the start.
            whole, at, lo, hi, grid = cut(high[owner], lo, hi, size)
            of = owner[whole]
            texts = [contexts[i] for i in of.tolist()]
            arrays = [cores(texts, at, grid, size), spans(texts, at, lo, hi), row[of], b[of], lo, hi, parent[of]]
            columns = [*(pa.array(a, pa.int64()) for a in arrays), pa.array(partner[whole], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=_NODE_NAMES)

    return listed.select("parent", "row", "b", "hi", "context", "parts").mapInArrow(run, NODE)


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``row`` and its ``runs``: merged (from, to) byte ranges that are repeated."""
    counts = text_nodes(rows, spanned=False).groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    # Stored, so that the join can split a core with a large part of all nodes.
    twice = written(counts.where("n > 1").select("core"), "cores")
    nodes = written(text_nodes(rows, spanned=True).join(twice, "core", "left_semi"), "nodes")
    repeated, further = settle(nodes)
    found = [repeated]
    parents = written(with_context(rows, further), "parents")
    parts = None
    for size in SIZES[1:]:
        nodes = written(child_nodes(parents, parts, size), "nodes")
        repeated, parts = settle(nodes)
        found.append(repeated)
    ranges = reduce(DataFrame.unionByName, found).select(
        "row", F.struct((F.col("b") - F.col("hi")).alias("from"), (F.col("b") - F.col("lo") + LENGTH).alias("to")).alias("r")
    )
    per_row = ranges.groupBy("row").agg(F.sort_array(F.collect_set("r")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            runs = [[{"from": a, "to": b} for a, b in merged(r)] for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind)], names=["row", "runs"])

    return written(per_row.mapInArrow(run, "row bigint, runs array<struct<from:bigint,to:bigint>>"), "runs")


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Sorted ranges, those that overlap or touch joined."""
    out: list[list[int]] = []
    for r in ranges:
        if out and r["from"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["to"])
        else:
            out.append([r["from"], r["to"]])
    return [(a, b) for a, b in out]


def kept_text(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of a text without its runs."""
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: doc_id, bytes, removed bytes and runs, and the remaining text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "rows")
    runs = repeated_runs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            gone = [[(r["from"], r["to"]) for r in found or []] for found in batch.column(2).to_pylist()]
            kept = [kept_text(t, g) for t, g in zip(texts, gone, strict=True)]
            numbers = [
                [len(t) for t in texts],
                [len(t) - len(k) for t, k in zip(texts, kept, strict=True)],
                [len(g) for g in gone],
            ]
            arrays = [batch.column(0), *(pa.array(n, pa.int64()) for n in numbers), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    joined = rows.join(_side(runs, "runs"), "row", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The counts of every row with the digest of its remaining bytes, and whether it lost any."""
    return without_repeats(docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"),
    )
