"""Phrases whose words stand together more often than their parts would.

Texts are turned into numbers of words once, in chunks with a vocabulary of their own.
Counting goes up by length. A phrase can only reach ``least`` if both phrases it
consists of, one word shorter, do; a fixed-size filter of those names the places worth
counting. There, hashes of phrases are counted first: sorted, compressed and merged by
radix, so that rare phrases, which are most, never travel as words. A second filter,
of the hashes that reach ``least``, picks the phrases that are then counted by their
words. Counts are exact, as what a filter lets through by mistake is dropped by its
count; hashes and the filters' size change the work alone.

The counted phrases of all lengths, single words included, form one stream. In prefix
order (by words from the left) every phrase follows its own beginnings and is followed
by its right extensions, so one pass with a stack of open beginnings gives each phrase
the counts of its left parts and the largest count of a right extension. In suffix order
(by words from the right) the same pass gives right parts and left extensions. Streams
are laid out by ranges and sorted; no table of phrases is held anywhere. Where a range
begins within the family of a phrase, its rows miss at most one beginning of each length;
those few, bounded by the number of ranges, are looked up afterwards.

A-Z are lower-cased, pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs.
Null texts count as empty; a null lang is ``und`` and joins rows that say so. Rows that
repeat count as often as they stand there. Ties of the score go to the higher count, then
to the phrase in byte order. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from edgelens.llm.common import bound_batches
from edgelens.session import written

NO_LANG = "und"
# Words of a chunk that is counted at once, distinct words it may hold.
CHUNK_WORDS = 1 << 20
CHUNK_VOCABULARY = 1 << 18
# Hashes that are held before they are folded or passed on, which bounds a worker's memory;
# words a radix of them stands for, by this.
HELD = 1 << 20
RADIX_HELD = 4
# Bits of a phrase's hash that are counted, and rows of a batch.
HASH_BITS = 48
BATCH_ROWS = 1 << 16
# Filter bits: per phrase, and at most.
BITS_EACH = 16
MOST_BITS = 1 << 27
# Bytes that end a piece, and the byte that marks the end (not in UTF-8).
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_GAP = b"\xff"
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _ENDS, b"abcdefghijklmnopqrstuvwxyz" + _GAP * len(_ENDS))
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text, with a gap after each piece."""
    return (text or b"").translate(_BYTES).replace(_GAP, b" \xff ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode())


def _chained(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """One hash per phrase from the hashes of its words."""
    hashes = iter(hashes)
    code = next(hashes)
    for more in hashes:
        code = (code ^ (code >> _TURN)) * _MIX + more
    return code


class Filter:
    """A set of hashes with a few strangers: two bits for each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
        return mixed & mask, (mixed >> np.uint64(32)) & mask

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        a, b = self.places(hashes, self.mask)
        both = (self.bits[a >> np.uint64(6)] >> (a & np.uint64(63))) & (self.bits[b >> np.uint64(6)] >> (b & np.uint64(63)))
        return (both & one).astype(bool)


def filter_of(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]], n: int) -> np.ndarray:
    """Bits of about ``n`` hashes, which ``hashes`` reads from the rows; bounded by ``MOST_BITS``.

    Reading and entering share one Python worker; a second map would bring a second one.
    """
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (n * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for some in hashes(batch):
                for at in Filter.places(some, np.uint64(bits - 1)):
                    np.bitwise_or.at(held, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(held)
        for part in np.array_split(at, len(at) // BATCH_ROWS + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(held[part].view(np.int64))], names=["at", "bits"])

    found = rows.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _known(phrases: DataFrame, length: int) -> np.ndarray:
    """Filter of the hashes of the phrases (lang, w1, ...)."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        seeds = [_seed(lang) for lang in batch.column(0).to_pylist()]
        words = [batch.column(i + 1).cast(pa.binary()).to_pylist() for i in range(length)]
        yield _chained(np.array([xxhash.xxh64_intdigest(w, s) for w, s in zip(column, seeds)], np.uint64) for column in words)

    columns = ["lang", *(f"w{i + 1}" for i in range(length))]
    return filter_of(phrases.select(*columns), hashes, phrases.count())


class _Ids(dict):
    """Word to number; a new word is entered in the chunk."""

    def __init__(self, chunk: _Chunk, lang: str):
        super().__init__({_GAP: 0})
        self.chunk, self.lang = chunk, len(chunk.langs)
        chunk.langs.append(lang)

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.chunk.words)
        self.chunk.words.append(word)
        self.chunk.lang_of.append(self.lang)
        return number


class _Chunk:
    """Some texts as numbers of words; 0 is a gap between pieces and texts."""

    def __init__(self):
        self.words, self.lang_of, self.langs = [b""], [0], [""]
        self.ids_of: dict[str, _Ids] = {}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes | None) -> None:
        if lang not in self.ids_of:
            self.ids_of[lang] = _Ids(self, lang)
        ids = np.fromiter(map(self.ids_of[lang].__getitem__, [*words_of(text), _GAP]), np.int64)
        self.texts.append(ids)
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= CHUNK_WORDS or len(self.words) >= CHUNK_VOCABULARY

    def row(self) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3).compress
        ids, lang_of = (np.asarray(v, np.int32) for v in (np.concatenate(self.texts), self.lang_of))
        blobs = [pack(_GAP.join(self.words)), pack(lang_of.tobytes()), pack(ids.tobytes())]
        arrays = [pa.array([b], pa.binary()) for b in blobs] + [pa.array([self.langs], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=_STORED)


_STORED = ["words", "lang_of", "ids", "langs"]


class _Stored:
    """A chunk read back."""

    def __init__(self, words: bytes, lang_of: bytes, ids: bytes, langs: list[str]):
        unpack = zstandard.ZstdDecompressor().decompress
        self.words, self.langs = unpack(words).split(_GAP), langs
        self.lang_of, self.ids = (np.frombuffer(unpack(b), np.int32) for b in (lang_of, ids))

    def hashes(self) -> np.ndarray:
        seeds = [_seed(lang) for lang in self.langs]
        words = zip(self.words, self.lang_of.tolist())
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in words), np.uint64, len(self.words))

    def places(self, length: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases stand of which both shorter ones are known, and their hashes."""
        of_words, n = self.hashes()[self.ids], length - 1
        fine = np.zeros(max(0, len(self.ids) - n + 1), bool)
        for start in range(0, len(fine), BATCH_ROWS):
            end = min(start + BATCH_ROWS, len(fine))
            some = Filter(shorter).holds(_chained(of_words[start + i : end + i] for i in range(n)))
            for i in range(n):
                some &= self.ids[start + i : end + i] > 0
            fine[start:end] = some
        at = np.flatnonzero(fine[:-1] & fine[1:])
        return at, _chained(of_words[at + i] for i in range(length)) >> np.uint64(64 - HASH_BITS)

    def counted(self, at: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The different phrases at some places, as columns of word numbers, and their counts."""
        columns = [self.ids[at + i].astype(np.int64) for i in range(length)]
        if not len(at):
            return columns, at
        base, code = len(self.words), columns[0]
        for more in columns[1:]:
            if int(code.max()) >= (1 << 62) // base:
                code = np.unique(code, return_inverse=True)[1]
            code = code * base + more
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        return [c[first] for c in columns], n

    def rows(self, columns: list[np.ndarray], n: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        langs = pa.array(self.langs, pa.string()).take(pa.array(self.lang_of))
        for start in range(0, len(n), BATCH_ROWS):
            part = slice(start, start + BATCH_ROWS)
            ids = [pa.array(c[part]) for c in columns]
            arrays = [langs.take(ids[0]), *map(words.take, ids), pa.array(n[part], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def _chunked(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for lang, text in zip(langs, texts):
                chunk.add(lang, text)
                if chunk.full():
                    yield chunk.row()
                    chunk = _Chunk()
        if chunk.size:
            yield chunk.row()

    return written(texts.mapInArrow(run, "words binary, lang_of binary, ids binary, langs array<string>"), "chunks")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Stored]:
    for batch in batches:
        for i in range(len(batch)):
            yield _Stored(*(column[i].as_py() for column in batch.columns))


def _word_counts(chunks: DataFrame) -> DataFrame:
    """lang, w1, f of every word; a lang's total where w1 is null."""
    names = ["lang", "w1", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _read(batches):
            n = np.bincount(chunk.ids, minlength=len(chunk.words))
            n[0] = 0
            there = np.flatnonzero(n)
            yield from chunk.rows([there], n[there], names)
            totals = np.bincount(chunk.lang_of, n, len(chunk.langs)).astype(np.int64)[1:]
            arrays = [pa.array(chunk.langs[1:], pa.string()), pa.nulls(len(totals), pa.string()), pa.array(totals)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return chunks.mapInArrow(run, "lang string, w1 string, n bigint").groupBy("lang", "w1").agg(F.sum("n").alias("f"))


class _HashCounts:
    """Sorted hashes with counts, folded when they get many."""

    def __init__(self):
        self.parts, self.size, self.limit = [], 0, HELD

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> bool:
        """Takes some more; true if they are too many even when folded."""
        self.parts.append((hashes, counts))
        self.size += len(hashes)
        if self.size <= self.limit:
            return False
        self.fold()
        self.limit = max(HELD, 2 * self.size)
        return self.size > HELD // 2

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        # Nothing stays longer than it is needed: two workers share an executor with its JVM.
        hashes, counts = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        counts = counts[order]
        del order
        changed = np.ones(len(hashes), bool)
        changed[1:] = hashes[1:] != hashes[:-1]
        starts = np.flatnonzero(changed)
        sums = np.add.reduceat(counts, starts) if len(starts) else counts
        self.parts, self.size = [(hashes[starts], sums)], len(starts)
        return self.parts[0]


def _often(chunks: DataFrame, length: int, shorter: object, least: int, words: int) -> np.ndarray:
    """Filter of the hashes of phrases that may stand in the texts ``least`` times."""
    radix_bits = min(16, max(6, (words // (RADIX_HELD * HELD)).bit_length()))

    def spilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pack = _HashCounts(), zstandard.ZstdCompressor(level=3).compress

        def passed_on() -> Iterator[pa.RecordBatch]:
            hashes, counts = held.fold()
            edges = np.searchsorted(hashes, np.arange((1 << radix_bits) + 1, dtype=np.uint64) << np.uint64(HASH_BITS - radix_bits))
            rows = []
            for radix in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[radix], edges[radix + 1])
                steps = np.diff(hashes[part], prepend=np.uint64(0))
                rows.append((radix, pack(steps.tobytes()), pack(counts[part].astype(np.int64).tobytes())))
            held.__init__()
            if rows:
                types = pa.int32(), pa.binary(), pa.binary()
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=["radix", "hashes", "counts"])

        for chunk in _read(batches):
            if held.add(*np.unique(chunk.places(length, shorter.value)[1], return_counts=True)):
                yield from passed_on()
        yield from passed_on()

    def merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held, at = _HashCounts(), None

        def frequent() -> pa.RecordBatch:
            hashes, counts = held.fold()
            reached = hashes[counts >= least]
            arrays = [pa.array([reached.tobytes()], pa.binary()), pa.array([len(reached)], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["hashes", "n"])

        for batch in batches:
            for radix, steps, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if radix != at:
                    if at is not None:
                        yield frequent()
                    held, at = _HashCounts(), radix
                held.add(np.cumsum(np.frombuffer(unpack(steps), np.uint64)), np.frombuffer(unpack(counts), np.int64))
        if at is not None:
            yield frequent()

    runs = chunks.mapInArrow(spilled, "radix int, hashes binary, counts binary")
    laid = runs.repartition("radix").sortWithinPartitions("radix")
    reached = written(laid.mapInArrow(merged_runs, "hashes binary, n bigint"), "hashes")
    n = reached.agg(F.sum("n")).first()[0] or 1
    return filter_of(reached.select("hashes"), lambda batch: (np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()), n)


def _phrase_counts(chunks: DataFrame, length: int, shorter: object, often: object) -> DataFrame:
    """lang, w1, ..., f of the phrases that both filters let through."""
    names = ["lang", *(f"w{i + 1}" for i in range(length)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _read(batches):
            at, codes = chunk.places(length, shorter.value)
            columns, n = chunk.counted(at[Filter(often.value).holds(codes)], length)
            yield from chunk.rows(columns, n, names)

    ddl = ", ".join([*(f"{c} string" for c in names[:-1]), "n bigint"])
    return chunks.mapInArrow(run, ddl).groupBy(*names[:-1]).agg(F.sum("n").alias("f"))


def count_streams(
    docs: DataFrame, longest: int, least: int, text: str = "text", lang: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that stand in the texts ``least`` times (lang,
    words, f), and the number of words of each lang (lang, n)."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    chunks = _chunked(texts)
    singles = written(_word_counts(chunks).where((F.col("f") >= least) | F.col("w1").isNull()), "words")
    totals = singles.where("w1 is null").select("lang", F.col("f").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    table, stream = singles.where("w1 is not null"), []
    for length in range(1, longest + 1):
        if length > 1:
            shorter = spark.sparkContext.broadcast(_known(table, length - 1))
            often = spark.sparkContext.broadcast(_often(chunks, length, shorter, least, words))
            counted = _phrase_counts(chunks, length, shorter, often)
            table = written(counted.where(F.col("f") >= least), f"phrases-{length}")
        stream.append(table.select("lang", F.array(*(f"w{i + 1}" for i in range(length))).alias("words"), "f"))
    together = stream[0]
    for more in stream[1:]:
        together = together.unionByName(more)
    return together, totals


def merged(stream: DataFrame, longest: int, side: str, ranges: int | None = None) -> DataFrame:
    """``stream`` with the counts of each phrase's beginnings and of its largest extension.

    ``side`` ``left`` takes words in prefix order, ``right`` in suffix order. Added are
    ``<side>_1``, ``<side>_2``, ... (count of the first, or last, so many words) and
    ``<side>_more`` (largest count of a phrase with one word more at the other end).
    """
    carried = [c for c in stream.columns if c not in ("lang", "words", "f")]
    parts = [f"{side}_{k}" for k in range(1, longest)]
    more = f"{side}_more"
    flat = stream.withColumn("key", F.col("words") if side == "left" else F.reverse("words"))
    order = ["lang", "key"]
    laid = flat.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    laid = laid.select("lang", "key", "f", *carried)
    ddl = "lang string, key array<string>, " + ", ".join(f"{c} bigint" for c in ["f", *carried, *parts, more])
    types = [pa.string(), pa.list_(pa.string()), *[pa.int64()] * (len(carried) + longest + 1)]
    names = ["lang", "key", "f", *carried, *parts, more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Open beginnings of the row at hand: [lang, key, f, carried, counts of beginnings, largest extension].
        open_, done = [], []

        def batch_of() -> pa.RecordBatch:
            rows = [(lang, key, f, *rest, *below, most) for lang, key, f, rest, below, most in done]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for lang, key, f, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                while open_ and (open_[-1][0] != lang or open_[-1][1] != key[: len(open_[-1][1])]):
                    done.append(open_.pop())
                below = [None] * (longest - 1)
                for beginning in open_:
                    below[len(beginning[1]) - 1] = beginning[2]
                if open_ and len(open_[-1][1]) == len(key) - 1:
                    open_[-1][5] = max(open_[-1][5], f)
                elif len(key) > 1:  # the phrase it extends is in an earlier range
                    done.append([lang, key[:-1], None, [None] * len(rest), [None] * (longest - 1), f])
                open_.append([lang, key, f, rest, below, 0])
            if len(done) > 10_000:
                yield batch_of()
                done.clear()
        done += open_
        if done:
            yield batch_of()

    passed = written(laid.mapInArrow(run, ddl), f"{side}-pass")
    rows = passed.where("f is not null")
    over = passed.where("f is null").groupBy("lang", "key").agg(F.max(more).alias("over"))
    for k in range(1, longest):
        # Beginnings that lie in an earlier range: at most one a range.
        head = F.slice("key", 1, k)
        wanted = rows.where((F.size("key") > k) & F.col(f"{side}_{k}").isNull()).select("lang", head.alias("head")).distinct()
        lost = written(
            flat.where(F.size("key") == k)
            .select("lang", F.col("key").alias("head"), F.col("f").alias("found"))
            .join(wanted, ["lang", "head"], "left_semi"),
            "beginnings",
        )
        rows = (
            rows.withColumn("head", head)
            .join(lost, ["lang", "head"], "left")
            .withColumn(f"{side}_{k}", F.when(F.size("key") > k, F.coalesce(f"{side}_{k}", "found")))
            .drop("head", "found")
        )
    rows = rows.join(written(over, "extensions"), ["lang", "key"], "left").withColumn(more, F.greatest(more, "over"))
    words = F.col("key") if side == "left" else F.reverse("key")
    return rows.select("lang", words.alias("words"), "f", *carried, *parts, more)


def _scored(candidates: DataFrame, longest: int) -> DataFrame:
    """Candidates with the parts and score of their weakest cut; whole numbers of any size."""
    names = ["lang", "phrase", "a", "l", "r", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases, sizes, counts, *sides = (c.to_pylist() for c in batch.columns)
            cuts = []
            for i, (n, a) in enumerate(zip(sizes, counts)):
                pairs = [(sides[k - 1][i], sides[longest - 1 + n - k - 1][i]) for k in range(1, n)]
                score, k = min((1_000_000 * a * a // (l * r), k) for k, (l, r) in enumerate(pairs))
                cuts.append((*pairs[k], score))
            columns = zip(*cuts) if cuts else ([], [], [])
            arrays = [batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    sides = [f"{side}_{k}" for side in ("left", "right") for k in range(1, longest)]
    rows = candidates.select("lang", F.array_join("words", " ").alias("phrase"), F.size("words").alias("size"), "f", *sides)
    return rows.mapInArrow(run, "lang string, phrase string, a bigint, l bigint, r bigint, score bigint")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    top: int = 2000,
    text: str = "text",
    lang: str = "lang",
    ranges: int | None = None,
) -> DataFrame:
    """Each lang's first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase of which ``share`` percent or more stand in one longer phrase gives way to it.
    (It is enough to look one word further: what stands in longer ones stands in those.)
    """
    stream, totals = count_streams(docs, longest, least, text, lang)
    both = merged(merged(stream, longest, "left", ranges), longest, "right", ranges)
    longer = F.greatest("left_more", "right_more")
    candidates = both.where((F.size("words") > 1) & (100 * longer < share * F.col("f")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _scored(candidates, longest).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
