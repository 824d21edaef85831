"""Alignment of two tokenizers over a corpus, and how usual each pairing of tokens is.

Every text is encoded by A (byte-level BPE, with a space in front) and by B (which adds
the space itself). Where tokens of both end at the same byte, the two before it are a
link, and the tokens since the link before are a group. Where no token of either side can
lie over a place between two words, texts are encoded and aligned by the parts between
such places, and a task remembers parts; else whole.

Pairings are counted as an external merge does it. A task sorts the links of some texts
by pairing, B's side first, and radix-partitions them by B's id into runs compressed
with zstd: per pairing the texts that hold it and how often. The counts of a task's runs
are merged before they leave it. They meet in k-way heap merges of at most ``FAN_IN``
streams, as many rounds as that takes; side-major order puts all pairings of a B id next
to each other, so its highest count is known when it ends. The counts of a radix then
go past its runs, which yields each text's share, and shares are summed run by run.

Runs stay where texts were read and hold positions in them, so a pairing that stands in
every text adds a few bytes per text and is never gathered. A radix with many runs is
dealt to several tasks.

Texts that are null, empty or that one side does not give back byte by byte have no
tokens: zeros, and an empty string in place of the digest. Rows that repeat a doc_id are
texts of their own and count. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from edgelens.llm.common import bound_batches, packed, unpacked
from edgelens.llm.token_counts import special_strings
from edgelens.session import written

# Radix of a pairing: B's id modulo this.
RADIX = 64
# Links and texts of a chunk that is sorted at once; positions are 16 bit.
CHUNK_LINKS = 1 << 20
CHUNK_TEXTS = 1 << 15
# Pairings a task holds before it passes their counts on.
HELD = 1 << 21
# Streams of one heap merge, records of a radix that one task takes.
FAN_IN = 64
TASK_RECORDS = 1 << 22
# Parts of texts that a task remembers, and their characters.
KNOWN = 400_000
KNOWN_CHARACTERS = 1 << 24
_BLOCK = 4096


# A blank or line break behind a printing ASCII or Latin character: byte-level splitters
# always begin a pre-token there, so a text is encoded as its parts between such places.
PART = re.compile(r"(?<=[!-~\u00a1-\u024f])(?=[ \n])")
# Parts that may stand behind one another.
_JOINS = re.compile(r"(?s)[ \n].*[!-~\u00a1-\u024f]")
# What no piece of B may hold if texts are cut there.
_CUT = re.compile(r"[!-~\u00a1-\u024f][ \n\u2581]")
# Characters of new parts that are encoded in one go.
_TOGETHER = 1 << 16


class _Lists:
    """A list of numbers per part, on end."""

    def __init__(self):
        self.flat, self.starts, self.sizes = (np.zeros(0, np.int64) for _ in range(3))

    def enter(self, values: list[np.ndarray], sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *values])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        first = np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes)
        return self.flat[first + np.arange(len(first))]


class _Parts(dict):
    """Parts of texts by number; new ones are entered and wait to be encoded.

    Both sides end a token where a part ends, so groups and links of a text are those of its parts.
    """

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.characters = 0
        self.a, self.links = _Lists(), _Lists()
        self.a_back, self.back = np.zeros(0, bool), np.zeros(0, bool)
        self.b_sizes = np.zeros(0, np.int64)
        self.groups: list[str] = []

    def __missing__(self, part: str) -> int:
        number = self[part] = len(self)
        self.new.append(part)
        self.characters += len(part)
        return number

    def enter(self, encoded: list[_Run]) -> None:
        """The parts that waited, in their order, as encoded in runs."""
        a_sizes, b_sizes, n_links = (np.concatenate([x.sizes[k] for x in encoded]) for k in range(3))
        self.a.enter([x.a for x in encoded], a_sizes)
        self.links.enter([x.links for x in encoded], n_links)
        self.b_sizes = np.concatenate([self.b_sizes, b_sizes])
        n = [len(x.groups) for x in encoded]
        self.a_back = np.concatenate([self.a_back, np.repeat([x.a_back for x in encoded], n)])
        self.back = np.concatenate([self.back, np.repeat([x.back for x in encoded], n)])
        self.groups += [g for x in encoded for g in x.groups]
        self.new = []


class _Run:
    """Parts side by side: tokens of A, of B and links of each part (``sizes``), A's ids,
    links in side-major order of their texts, groups as text; ``a_back`` and ``back`` tell
    whether A, or both, give the parts back."""

    def __init__(self, sides: Sides, parts: list[str]):
        raw = [p.encode() for p in parts]
        text, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        a, b = sides.ids("".join(parts))
        self.a_back = b"".join(map(sides.a_bytes.__getitem__, a)) == text
        self.back = self.a_back and b"".join(map(sides.b_bytes.__getitem__, b)) == text
        self.a, self.links, self.groups = np.array(a, np.int64), np.zeros(0, np.int64), [""] * len(parts)
        if not self.back:  # stands alone, or is encoded in halves
            self.sizes = [np.array([n, *[0] * (len(parts) - 1)], np.int64) for n in (len(a), 0, 0)]
            return
        b = np.array(b, np.int64)
        # Both sides end at the last byte.
        a_ends, b_ends = np.cumsum(sides.a_sizes[self.a]), np.cumsum(sides.b_sizes[b])
        at = np.searchsorted(b_ends, a_ends)
        a_last = np.flatnonzero(b_ends[at] == a_ends)
        b_last, link_ends = at[a_last], a_ends[a_last]
        last = np.searchsorted(link_ends, ends)
        self.back = bool((link_ends[last] == ends).all())
        self.sizes = [np.diff(at + 1, prepend=0) for at in (a_last[last], b_last[last], last)]
        self.links = _side_major(self.a[a_last], b[b_last])
        self.groups = sides.groups(self.a, b, a_last, b_last, last)


class Sides:
    """Both tokenizers, and their tokens as bytes."""

    def __init__(self, a_definition: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        special_strings(a_definition)  # refuses what does not split into pre-tokens
        self.a = Tokenizer.from_str(a_definition)
        self.a.encode_special_tokens = True  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.cuts = _cuts(b_model)
        self.a_bytes = _byte_level(self.a)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.base = max(len(self.a_bytes), len(self.b_bytes))
        # Ids with what stands behind them: in a group's side, behind A's, behind a group, behind a part.
        self.written = [f"{i}{separator}" for separator in ",|;\n" for i in range(self.base)]
        self.parts = _Parts()

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; the text begins with the blank that B would add."""
        a = self.a.encode(text, add_special_tokens=False).ids
        if not self.cuts:
            return a, self.b.encode(text[1:])
        # B adds a blank to what stands in front and is taken off again, so a line break may come first.
        b = self.b.encode("x" + text)
        size = 0
        for i, token in enumerate(b):
            size += self.b_sizes[token]
            if size >= 2:
                return a, b[i + 1 :]
        return a, []

    def groups(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, last: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each part; ``last`` are the links that end parts."""
        a_at, b_at = np.arange(len(a)), np.arange(len(b))
        before = np.concatenate(([0], b_last + 1))
        order = np.empty(len(a) + len(b), np.int64)
        a_codes, b_codes = a.copy(), b.copy()
        a_codes[a_last] += self.base
        b_codes[b_last] += 2 * self.base
        b_codes[b_last[last]] += self.base
        order[a_at + before[np.searchsorted(a_last, a_at)]] = a_codes
        order[b_at + a_last[np.searchsorted(b_last, b_at)] + 1] = b_codes
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1].split("\n")

    def _runs(self, parts: list[str]) -> Iterator[_Run]:
        """Parts in their order; those that can stand side by side are encoded many at a time."""
        run, size = [], 0
        for part in parts:
            joins = self.cuts and _JOINS.fullmatch(part)
            if run and (not joins or size >= _TOGETHER):
                yield from self._checked(run)
                run, size = [], 0
            if joins:
                run.append(part)
                size += len(part)
            else:
                yield _Run(self, [part])
        if run:
            yield from self._checked(run)

    def _checked(self, run: list[str]) -> Iterator[_Run]:
        """A run; one that does not give its text back, in halves."""
        found = _Run(self, run)
        if found.back or len(run) == 1:
            yield found
        else:
            yield from self._checked(run[: len(run) // 2])
            yield from self._checked(run[len(run) // 2 :])

    def _numbers(self, texts: list[str]) -> list[list[int]]:
        """Numbers of the parts of texts, which are known then."""
        if len(self.parts) > KNOWN or self.parts.characters > KNOWN_CHARACTERS:
            self.parts = _Parts()
        split = map(PART.split, texts) if self.cuts else ([t] for t in texts)
        numbers = [list(map(self.parts.__getitem__, parts)) for parts in split]
        if self.parts.new:
            self.parts.enter(list(self._runs(self.parts.new)))
        return numbers

    def encode_a(self, texts: list[str]) -> list[np.ndarray | None]:
        """A's ids of texts that begin with a blank; None if they do not give one back."""
        every = map(np.array, self._numbers(texts))
        return [self.parts.a.of(numbers) if self.parts.a_back[numbers].all() else None for numbers in every]

    def align(self, texts: list[str | None]) -> Iterator[Alignment | None]:
        """One alignment per text; None without tokens."""
        every = iter(self._numbers([" " + t for t in texts if t]))
        for text in texts:
            yield Alignment.of(self.parts, next(every)) if text else None


def _cuts(b_model: bytes) -> bool:
    """Whether B's tokens end at every place between parts, and nothing around it matters."""
    model = sentencepiece_model_pb2.ModelProto.FromString(b_model)
    rules, trained = model.normalizer_spec, model.trainer_spec
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if not plain or rules.precompiled_charsmap or trained.treat_whitespace_as_suffix:
        return False
    return not any(_CUT.search(p.piece) for p in model.pieces)


def _byte_level(tokenizer: Tokenizer) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary."""
    # Bytes that stand for themselves; the others follow from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}
    table = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        known = all(c in byte_of for c in token)
        table[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return table


class Alignment:
    """Tokens of both sides of a text, its links (side-major numbers) and its groups as text."""

    def __init__(self, n_a: int, n_b: int, links: np.ndarray, text: str):
        self.n_a, self.n_b, self.links, self.text = n_a, n_b, links, text

    @staticmethod
    def of(parts: _Parts, numbers: list[int]) -> Alignment | None:
        at = np.array(numbers)
        if not parts.back[at].all():
            return None
        text = ";".join(map(parts.groups.__getitem__, numbers))
        return Alignment(int(parts.a.sizes[at].sum()), int(parts.b_sizes[at].sum()), parts.links.of(at), text)

    def groups(self, a_sizes: np.ndarray) -> list[tuple[int, list[int], list[int]]]:
        """Byte end, A ids and B ids of each group."""
        out, end = [], 0
        for group in self.text.split(";"):
            a, b = (list(map(int, side.split(","))) for side in group.split("|"))
            end += int(a_sizes[a].sum())
            out.append((end, a, b))
        return out


def _side_major(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairings as numbers that sort by radix, then B's id, then A's."""
    return ((b % RADIX) << 56) | ((b // RADIX) << 32) | a


def _packed_counts(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=0).astype("<i8"), *(c.astype("<i8") for c in counts))


def _unpacked_counts(blob: bytes, columns: int = 1) -> list[np.ndarray]:
    steps, *counts = unpacked(blob, *["<i8"] * (columns + 1))
    return [np.cumsum(steps), *counts]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(changed)


class _Counts:
    """Counts of pairings that a task has met."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)

    def fold(self) -> None:
        keys, counts = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = _starts(keys)
        self.parts = [(keys[starts], np.add.reduceat(counts, starts))] if len(keys) else []
        self.size = len(starts)

    def by_radix(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            self.fold()
        for keys, counts in self.parts:
            edges = np.searchsorted(keys, np.arange(RADIX + 1) << 56)
            for radix in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[radix], edges[radix + 1])
                yield radix, _packed_counts(keys[part], counts[part])
        self.parts, self.size = [], 0


_DOC = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_NAMES = ["run", "at", "doc_id", *_DOC, "radix", "records", "body", "counts"]
_DDL = (
    "run bigint, at int, doc_id {0}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "radix int, records bigint, body binary, counts binary"
)
_TYPES = [pa.int64()] * 4 + [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


class _Chunk:
    """Some aligned texts: their rows, and their links as runs."""

    def __init__(self, run: int):
        self.run, self.rows, self.links = run, [], []
        self.size = 0

    def add(self, doc_id: object, found: Alignment | None) -> None:
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            self.links.append(np.empty(0, np.int64))
            return
        n = len(found.links)
        self.rows.append((doc_id, found.n_a, found.n_b, n, n, hashlib.sha256(found.text.encode()).hexdigest()))
        self.links.append(found.links)
        self.size += n

    def full(self) -> bool:
        return self.size >= CHUNK_LINKS or len(self.rows) >= CHUNK_TEXTS

    def batches(self, id_type: pa.DataType, counts: _Counts) -> Iterator[pa.RecordBatch]:
        n = len(self.rows)
        ids, *rest = zip(*self.rows)
        columns = [pa.array([self.run] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, id_type)]
        columns += [pa.array(c, t) for c, t in zip(rest, _TYPES)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in _TYPES[5:])], names=_NAMES)
        keys = np.concatenate(self.links)
        texts = np.repeat(np.arange(n), [len(links) for links in self.links])
        order = np.argsort(keys, kind="stable")
        keys, texts = keys[order], texts[order]
        first = _starts(keys, texts) if len(keys) else order
        times = np.diff(first, append=len(keys))
        keys, texts = keys[first], texts[first]
        heads = _starts(keys) if len(keys) else first
        if len(heads):
            counts.add(keys[heads], np.add.reduceat(times, heads))
        edges = np.searchsorted(keys, np.arange(RADIX + 1) << 56)
        runs = []
        for radix in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[radix], edges[radix + 1])
            starts = _starts(keys[part])
            sizes = np.diff(starts, append=part.stop - part.start)
            steps = np.diff(keys[part][starts], prepend=0)
            body = packed(steps.astype("<i8"), sizes.astype("<i4"), texts[part].astype("<u2"), times[part].astype("<i4"))
            runs.append((radix, int(part.stop - part.start), body))
        if runs:
            yield _extra_rows(self.run, id_type, runs, 8)


def _extra_rows(run: int, id_type: pa.DataType, rows: list[tuple], first: int) -> pa.RecordBatch:
    """Rows that fill only the columns from ``first`` on, beside the run."""
    n = len(rows)
    types = [pa.int64(), pa.int32(), id_type, *_TYPES]
    columns = [pa.nulls(n, t) for t in types]
    columns[0] = pa.array([run] * n, pa.int64())
    for i, values in enumerate(zip(*rows)):
        columns[first + i] = pa.array(values, types[first + i])
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _files(spark: SparkSession, a_path: str, b_path: str):
    """The tokenizers' files for the tasks."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


def _rows_of(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def alignments(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the groups of every text: the byte where a group ends, and its ids."""
    files = _files(docs.sparkSession, a_path, b_path)
    rows, kind = _rows_of(docs, doc_id, text)
    group = pa.struct([("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = Sides(*files.value)
        for batch in batches:
            found = [[] if x is None else x.groups(sides.a_sizes) for x in sides.align(batch.column(1).to_pylist())]
            groups = pa.array([[dict(zip(("end", "a", "b"), g)) for g in gs] for gs in found], pa.list_(group))
            yield pa.RecordBatch.from_arrays([batch.column(0), groups], names=["doc_id", "groups"])

    return rows.mapInArrow(run, f"doc_id {kind}, groups array<struct<end:bigint,a:array<int>,b:array<int>>>")


def _spilled(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """The texts' rows, the runs of their links and the counts of each task, as one table."""
    files = _files(docs.sparkSession, a_path, b_path)
    rows, kind = _rows_of(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, counts = Sides(*files.value), _Counts()
        task, id_type = TaskContext.get().partitionId() << 32, None
        chunk = _Chunk(task)

        def passed_on() -> Iterator[pa.RecordBatch]:
            found = list(counts.by_radix())
            if found:
                yield _extra_rows(chunk.run, id_type, [(r, None, None, c) for r, c in found], 8)

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            for i, found in zip(ids, sides.align(batch.column(1).to_pylist())):
                chunk.add(i, found)
                if chunk.full():
                    yield from chunk.batches(id_type, counts)
                    chunk = _Chunk(chunk.run + 1)
                    if counts.size > HELD:
                        counts.fold()
                        if counts.size > HELD // 2:
                            yield from passed_on()
        if chunk.rows:
            yield from chunk.batches(id_type, counts)
        yield from passed_on()

    return written(rows.mapInArrow(run, _DDL.format(kind)), "alignments")


def _records(blob: bytes) -> Iterator[tuple[int, int]]:
    keys, counts = _unpacked_counts(blob)
    for i in range(0, len(keys), _BLOCK):
        yield from zip(keys[i : i + _BLOCK].tolist(), counts[i : i + _BLOCK].tolist())


def heap_merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of some sorted streams of counts."""
    keys, sums = array("q"), array("q")
    last = None
    for key, n in heapq.merge(*map(_records, blobs)):
        if key == last:
            sums[-1] += n
        else:
            keys.append(key)
            sums.append(n)
            last = key
    return np.frombuffer(keys, np.int64), np.frombuffer(sums, np.int64)


def _highest(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The highest sum of each pairing's B id."""
    starts = _starts(keys >> 32)
    return np.repeat(np.maximum.reduceat(sums, starts), np.diff(starts, append=len(keys)))


def _merge_round(counts: DataFrame, deals: int, last: bool) -> DataFrame:
    """One stream per radix and deal from all of them; the last round adds the highest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def row() -> pa.RecordBatch:
            keys, sums = heap_merged(held)
            blob = _packed_counts(keys, sums, _highest(keys, sums)) if last else _packed_counts(keys, sums)
            columns = [pa.array([v], t) for v, t in zip((*key[::-1], blob), (pa.int64(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["run", "radix", "counts"])

        for batch in batches:
            for radix, deal, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (radix, deal) != key:
                    yield row()
                    held = []
                key = radix, deal
                held.append(blob)
                if len(held) == FAN_IN:
                    held = [_packed_counts(*heap_merged(held))]
        if held:
            yield row()

    deal = F.pmod(F.xxhash64("run"), F.lit(deals).cast("bigint"))
    dealt = counts.select("radix", deal.alias("deal"), "counts")
    laid = dealt.repartition("radix", "deal").sortWithinPartitions("radix", "deal")
    return written(laid.mapInArrow(run, "run bigint, radix int, counts binary"), "pairings")


def pairing_counts(counts: DataFrame) -> DataFrame:
    """Per radix one stream of all pairings, their counts and the highest of their B id."""
    while True:
        most = counts.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
        if most <= FAN_IN:
            return _merge_round(counts, 1, last=True)
        counts = _merge_round(counts, math.ceil(most / FAN_IN), last=False)


def _shares(runs: DataFrame, counted: DataFrame, deals: int) -> DataFrame:
    """run, at, n_best and count_sum of every text with links."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, highest = None, None, None
        for batch in batches:
            met_runs, shares = [], []
            for run, body, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if counts is not None:  # stands before the runs of its radix
                    keys, sums, highest = _unpacked_counts(counts, 2)
                    continue
                steps, sizes, texts, times = unpacked(body, "<i8", "<i4", "<u2", "<i4")
                at = np.repeat(np.searchsorted(keys, np.cumsum(steps)), sizes)
                share = np.zeros((2, CHUNK_TEXTS), np.int64)
                np.add.at(share[0], texts, times * (sums[at] == highest[at]))
                np.add.at(share[1], texts, times * sums[at])
                there = np.flatnonzero(share[1])
                met_runs.append(run)
                shares.append(packed(there.astype("<u2"), share[0][there], share[1][there]))
            columns = [pa.array(met_runs, pa.int64()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "shares"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, total = None, None

        def rows() -> pa.RecordBatch:
            there = np.flatnonzero(total[1])
            columns = np.full(len(there), run), there.astype(np.int32), total[0][there], total[1][there]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["run", "at", "n_best", "count_sum"])

        for batch in batches:
            for r, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if r != run:
                    if run is not None:
                        yield rows()
                    run, total = r, np.zeros((2, CHUNK_TEXTS), np.int64)
                at, best, sums = unpacked(blob, "<u2", "<i8", "<i8")
                total[0][at] += best
                total[1][at] += sums
        if run is not None:
            yield rows()

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(deals - 1).cast("bigint")))
    deal = F.pmod(F.xxhash64("run"), F.lit(deals).cast("bigint"))
    none = F.lit(None).cast("binary")
    streams = counted.select("radix", every.alias("deal"), F.lit(-1).cast("bigint").alias("run"), none.alias("body"), "counts")
    dealt = runs.select("radix", deal.alias("deal"), "run", "body", none.alias("counts"))
    keys = ["radix", "deal"]
    side_by_side = streams.unionByName(dealt).repartition(*keys).sortWithinPartitions(*keys, "run")
    shares = side_by_side.select("run", "body", "counts").mapInArrow(met, "run bigint, shares binary")
    laid = shares.repartition("run").sortWithinPartitions("run")
    return laid.mapInArrow(summed, "run bigint, at int, n_best bigint, count_sum bigint")


def report(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text the tokens, groups and links, and how usual its links are in the corpus."""
    spilled = _spilled(docs, a_path, b_path, doc_id, text)
    counted = pairing_counts(spilled.where("counts is not null").select("run", "radix", "counts"))
    runs = spilled.where("body is not null")
    records = runs.groupBy("radix").agg(F.sum("records").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = _shares(runs, counted, max(1, math.ceil(records / TASK_RECORDS)))
    texts = spilled.where("at is not null").select("run", "at", "doc_id", *_DOC)
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return texts.join(shares, ["run", "at"], "left").select("doc_id", *_DOC[:4], *numbers, "groups_sha256")
