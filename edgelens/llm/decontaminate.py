"""Benchmark passages in documents, found by Wu-Manber search over words.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window
is 13 consecutive words of a benchmark item; an item of fewer words is one window. A
document word inside any occurrence of a window is hit.

Patterns of one length share three tables. For every pair of neighbouring words the
shift table tells how far a pattern's end must at least be away; most positions are
skipped by it. Where the shift is zero, the bucket of patterns with that last pair
and the word found at the pattern's start is fetched, and the words are compared one
by one. Numpy does this for many stretches of a batch side by side.

Only the benchmark's windows are broadcast, in blocks of at most ``BLOCK_BYTES``
bytes; a larger benchmark takes one pass over the documents per block. Windows that
occur in the same items form a class, and documents collect classes, not windows.

Null texts have no words, as have empty ones; they are never hit. Windows of benchmark
rows without item_id hit words like all others, and add no item; rows of one item_id are
one item. Document rows that repeat a doc_id are separate. Empty tables give no rows, or
no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from edgelens.llm.common import bound_batches, broadcast_object, fresh
from edgelens.session import written

WINDOW = 13
BLOCK_BYTES = 16 << 20
# Words of a stretch that one lane scans, and comparisons made at a time.
LANE = 256
COMPARED = 1 << 17
SHARE = 20
# Bytes of words, after A-Z are lower-cased.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Patterns:
    """Wu-Manber tables for word patterns of one length."""

    def __init__(self, rows: np.ndarray, classes: np.ndarray):
        count, self.length = rows.shape
        self.block = min(2, self.length)
        bits = max(12, min(22, int(count * self.length).bit_length() + 2))
        self.mask = (1 << bits) - 1
        self.shift = np.full(1 << bits, self.length - self.block + 1, np.int32)
        for end in range(self.block - 1, self.length):
            at = self.code(rows[:, end - self.block + 1], rows[:, end])
            np.minimum.at(self.shift, at, self.length - 1 - end)
        key = self.bucket(self.code(rows[:, -self.block], rows[:, -1]), rows[:, 0])
        order = np.argsort(key, kind="stable")
        self.key, self.rows, self.classes = key[order], rows[order], classes[order]

    def code(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Table place of a block; different blocks may share one, at the smaller shift."""
        if self.block == 1:
            return last.astype(np.int64) & self.mask
        return (first.astype(np.int64) * 1_000_003 + last) & self.mask

    @staticmethod
    def bucket(code: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        return code << 32 | prefix.astype(np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last position, class) of every occurrence; id 0 matches nothing."""
        ends, found = [], []
        at = np.arange(0, len(ids), LANE)
        stop = np.minimum(at + LANE, len(ids))
        at = np.maximum(at, self.length - 1)
        while True:
            on = at < stop
            at, stop = at[on], stop[on]
            if not len(at):
                break
            code = self.code(ids[at - self.block + 1], ids[at])
            step = self.shift[code]
            hit = step == 0
            if hit.any():
                for a, c in self._confirmed(ids, at[hit], code[hit]):
                    ends.append(a)
                    found.append(c)
            at = at + np.maximum(step, 1)
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(ends), np.concatenate(found)

    def _confirmed(self, ids, at, code) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key = self.bucket(code, ids[at - self.length + 1])
        low = np.searchsorted(self.key, key, "left")
        some = np.searchsorted(self.key, key, "right") - low
        at, low, some = at[some > 0], low[some > 0], some[some > 0]
        total = np.concatenate([[0], np.cumsum(some)])
        span = np.arange(self.length) - self.length + 1
        for start in range(0, int(total[-1]), COMPARED):
            pair = np.arange(start, min(start + COMPARED, int(total[-1])))
            who = np.searchsorted(total, pair, "right") - 1
            row = low[who] + pair - total[who]
            same = (ids[at[who][:, None] + span] == self.rows[row]).all(axis=1)
            yield at[who][same], self.classes[row][same]


class Searcher:
    """All patterns of a block, by length, over a common vocabulary."""

    def __init__(self, windows: list[bytes], classes: list[str]):
        self.names = sorted(set(classes))
        place = {c: i for i, c in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, tuple[list, list]] = {}
        for window, name in zip(windows, classes, strict=True):
            words = window.split(b" ")
            rows, owners = by_length.setdefault(len(words), ([], []))
            rows.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
            owners.append(place[name])
        self.tables = [
            Patterns(np.array(rows, np.int32), np.array(owners, np.int32)) for rows, owners in by_length.values()
        ]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, merged runs of hit words, classes that occur."""
        lengths, parts, get = [], [], self.vocabulary.get
        for text in texts:
            words = words_of(text)
            lengths.append(len(words))
            parts.append(np.array([get(w, 0) for w in words] + [0], np.int32))
        if not parts:
            return []
        ids = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([n + 1 for n in lengths])])
        change = np.zeros(len(ids) + 1, np.int32)
        classes: dict[int, set[int]] = {}
        for table in self.tables:
            ends, found = table.find(ids)
            np.add.at(change, ends - table.length + 1, 1)
            np.add.at(change, ends + 1, -1)
            owner = np.searchsorted(starts, ends, "right") - 1
            for doc, c in set(zip(owner.tolist(), found.tolist(), strict=True)):
                classes.setdefault(doc, set()).add(c)
        covered = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)
        edges = np.flatnonzero(np.diff(covered)).reshape(-1, 2)
        runs: dict[int, list[tuple[int, int]]] = {}
        for doc, (a, b) in zip((np.searchsorted(starts, edges[:, 0], "right") - 1).tolist(), edges.tolist(), strict=True):
            runs.setdefault(doc, []).append((a - int(starts[doc]), b - int(starts[doc])))
        return [
            (n, runs.get(i, []), sorted(self.names[c] for c in classes.get(i, ()))) for i, n in enumerate(lengths)
        ]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs in order, those that overlap or touch joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct windows (words joined by a blank) with their items, as sorted text, null left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(t)
                last = max(0, len(words) - WINDOW) if words else -1
                found.append({b" ".join(words[i : i + WINDOW]) for i in range(last + 1)})
            lists = pa.array([sorted(f) for f in found], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item", "windows"])

    items = benchmark.select(F.col(item_id).cast("string"), F.col(text))
    each = items.mapInArrow(cut, "item string, windows array<binary>").select("item", F.explode("windows").alias("window"))
    grouped = each.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.withColumn("class", F.sha2(F.to_json("items"), 256))


def _found_type() -> T.StructType:
    runs = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    return T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", runs),
            T.StructField("classes", T.ArrayType(T.StringType())),
        ]
    )


def _pass(docs: DataFrame, text: str, name: str, searcher) -> DataFrame:
    """``docs`` with the struct ``name`` brought up to date by one block of patterns."""
    kind = _found_type()
    before = name in docs.columns
    kept = [c for c in docs.columns if c != name]
    at = kept.index(text)
    arrow = pa.struct(
        [
            ("n_words", pa.int64()),
            ("runs", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
            ("classes", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher().search
        for batch in batches:
            found = search(batch.column(at).cast(pa.binary()).to_pylist())
            if before:
                earlier = batch.column(len(kept)).to_pylist()
                found = [
                    (n, merged(runs + [(r["from"], r["to"]) for r in e["runs"]]), sorted({*classes, *e["classes"]}))
                    for (n, runs, classes), e in zip(found, earlier, strict=True)
                ]
            rows = [{"n_words": n, "runs": [{"from": a, "to": b} for a, b in r], "classes": c} for n, r, c in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, arrow)], names=[*kept, name])

    source = docs.select(*kept, *([name] if before else []))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(name, kind)])
    return source.mapInArrow(run, schema)


def scan(docs: DataFrame, patterns: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a struct of n_words, hit runs and classes of windows that occur."""
    spark = docs.sparkSession
    bound_batches(spark)
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("window") + F.octet_length("class")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("window"), F.lit(blocks))
    for i in range(blocks):
        if i:
            docs = written(docs, "scanned")
        rows = patterns.where(block == i).select("window", "class").orderBy("window").toArrow()
        searcher = Searcher(rows.column("window").to_pylist(), rows.column("class").to_pylist())
        docs = _pass(docs, text, name, broadcast_object(spark, searcher))
    return docs


def hit_words(found: Column) -> Column:
    return F.aggregate(found["runs"], F.lit(0).cast("bigint"), lambda n, r: n + r["to"] - r["from"])


def contaminated(found: Column) -> Column:
    """At least one word in ``SHARE`` is hit."""
    return (hit_words(found) > 0) & (SHARE * hit_words(found) >= found["n_words"])


def report(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """Per document row: words, hit words, items that occur, and the verdict."""
    patterns = written(windows(benchmark, item_id, text), "windows")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = F.col("found")
    scanned = scan(rows, patterns, "text", "found").select(
        "doc_id",
        found["n_words"].alias("n_words"),
        hit_words(found).alias("n_hit"),
        contaminated(found).alias("contaminated"),
        found["classes"].alias("classes"),
        F.monotonically_increasing_id().alias("row"),
    )
    scanned = written(scanned, "found")
    occurring = (
        scanned.select("row", F.explode("classes").alias("class"))
        .join(patterns.select("class", "items").dropDuplicates(["class"]), "class")
        .groupBy("row")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    items = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.join(occurring, "row", "left").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged."""
    patterns = written(windows(benchmark, item_id, "text"), "windows")
    name = fresh(docs, "found")
    scanned = scan(docs, patterns, text, name)
    return scanned.where(~contaminated(F.col(name))).select(*docs.columns)
