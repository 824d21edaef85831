"""Token counts without token ids.

A byte-level BPE never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have together. Pieces are counted once per distinct pre-token of the
corpus, and the counts are joined to the pre-token frequencies of each document.

The frequent pre-tokens (at most ``HEAD`` of at most ``HEAD_BYTES`` bytes, which
bounds their size) are joined by broadcast while the document is read. The others
leave the task as (row, pre-token, frequency) and meet their counts in a shuffled
join. Both ways are exact; nothing is capped.

Null text counts as empty: no bytes, no tokens. Rows that repeat a doc_id are
separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from edgelens.llm.common import bound_batches, byte_count
from edgelens.session import written

HEAD = 1 << 18
HEAD_BYTES = 64
# Distinct pre-tokens a task holds before it passes their counts on.
HELD = 100_000
# Fixed value: the split rule of byte-level BPE files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def special_strings(definition: str) -> list[str]:
    """Strings that the library takes out of a text before it splits it."""
    spec = json.loads(definition)
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if spec["normalizer"] is not None or not plain:
        raise ValueError("only byte-level tokenizers without normalizer and prefix space")
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError("added tokens that take in their surroundings are not handled")
    return [token["content"] for token in spec["added_tokens"]]


def pre_tokens(definition: str):
    """A function from a text to its pre-tokens and the number of special tokens.

    Texts of Latin, Greek and Cyrillic letters and common punctuation are split by
    the pattern here, which is several times faster. For other characters the
    tables of the two pattern libraries differ, so the tokenizer's own splitter does it.
    """
    specials, splitter = special_strings(definition), ByteLevel(add_prefix_space=False, use_regex=True)
    split, other = regex.compile(SPLIT), regex.compile(r"[^\x00-\u052F\u2000-\u206F]")
    longest_first = sorted(specials, key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")

    def plain(text: str) -> list[str]:
        if text.isascii() or other.search(text) is None:
            return split.findall(text)
        return [text[start:end] for _, (start, end) in splitter.pre_tokenize_str(text)]

    def parts(text: str) -> tuple[list[str], int]:
        between = cut.split(text)
        if len(between) == 1:
            return plain(text), 0
        return [p for part in between for p in plain(part)], len(between) - 1

    return parts


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in batch.column(at).cast(pa.binary()).to_pylist()]


def corpus_pieces(docs: DataFrame, definition: Broadcast, text: str) -> DataFrame:
    """Distinct pre-tokens of the corpus: how often they occur and how many tokens they give."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen = pre_tokens(definition.value), Counter()

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                names=["piece", "times"],
            )

        for batch in batches:
            for t in _texts(batch, 0):
                seen.update(parts(t)[0])
            if len(seen) > HELD:
                yield passed_on()
                seen.clear()
        yield passed_on()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
        tokenizer = Tokenizer.from_str(definition.value)
        for batch in batches:
            sizes = [len(tokenizer.encode(p, add_special_tokens=False)) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["piece", "times", "n"])

    distinct = (
        docs.select(text).mapInArrow(found, "piece string, times bigint").groupBy("piece").agg(F.sum("times").alias("times"))
    )
    return distinct.mapInArrow(counted, "piece string, times bigint, n bigint")


def head(pieces: DataFrame) -> dict[str, int]:
    """The most frequent pre-tokens with their token counts, at most ``HEAD``."""
    rank = F.floor(F.log2("times") * 8).cast("int")
    short = pieces.where(F.octet_length("piece") <= HEAD_BYTES).withColumn("rank", rank)
    sizes = {r["rank"]: r["count"] for r in short.groupBy("rank").count().collect()}
    total, least = 0, None
    for r in sorted(sizes, reverse=True):
        total += sizes[r]
        if total > HEAD:
            break
        least = r
    if least is None:
        return {}
    rows = short.where(F.col("rank") >= least).select("piece", "n").toArrow()
    return dict(zip(rows.column("piece").to_pylist(), rows.column("n").to_pylist(), strict=True))


def token_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    special_strings(definition.value)  # refuses what is not handled
    pieces = written(corpus_pieces(docs, definition, text), "pieces")
    known = spark.sparkContext.broadcast(head(pieces))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes = pre_tokens(definition.value), known.value
        for batch in batches:
            totals, tails = [], []
            for t in _texts(batch, 2):
                found, total = parts(t)
                rare = []
                for piece, times in Counter(found).items():
                    n = sizes.get(piece)
                    if n is None:
                        rare.append({"piece": piece, "times": times})
                    else:
                        total += n * times
                totals.append(total)
                tails.append(rare)
            tail = pa.array(tails, pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())])))
            arrays = [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), tail]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "known", "tail"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), byte_count(F.col(text)).alias("n_bytes"), F.col(text))
    read = rows.mapInArrow(
        frequencies,
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes bigint, known bigint, "
        "tail array<struct<piece:string,times:bigint>>",
    )
    # The row number is only made once: it is stored with the row.
    read = written(read.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rest = (
        read.select("row", F.explode("tail").alias("t"))
        .select("row", "t.piece", "t.times")
        .join(pieces.select("piece", "n"), "piece")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("times")).alias("more"))
    )
    n_tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return read.join(rest, "row", "left").select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
