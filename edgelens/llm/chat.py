"""Chat formatting with a loss mask that follows token offsets.

A turn is rendered as ``[INST]role[/INST]text</s>``. The three marks are tokens of their
own, added to the tokenizer in memory. What looks like a mark, or like a special string
of the tokenizer, inside a role or text gets a backslash after its first character
(one more if it has some), and loses it when read back, so every text survives.

Rows are laid out in ranges of (conversation, turn) and sorted, so a conversation of any
length spreads over tasks. Each task renders its conversations, encodes every rendering
once with offsets, and finds by binary search in the sorted spans of the assistant's
texts which tokens carry loss. As marks are never merged with what stands beside them,
spans and tokens end together and the mask is exact.

A conversation is one part, unless it passes ``PART_CHARS`` or the border of a range;
parts are cut between turns only and numbered in order.

Null roles and texts count as empty. Turns that tie are ordered by role, then by a
digest of the text; turns without number come last. Rows without conv_id are one
conversation, of null. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import AddedToken, Tokenizer

from edgelens.llm.common import bound_batches
from edgelens.session import written

# The marks of a turn.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
# Who speaks the texts that carry loss.
LEARNED = "assistant"
# Characters after which the next turn starts a new part.
PART_CHARS = 1 << 20


class Template:
    """The marks, and the way to write other text so that it never looks like one."""

    def __init__(self, specials: list[str]):
        controls = [OPEN, CLOSE, END, *specials]
        firsts = {c[0] for c in controls}
        for c in controls:
            if len(c) < 2 or "\\" in c or firsts & set(c[1:]) or sum(o.startswith(c) for o in controls) > 1:
                raise ValueError(f"special string {c!r} cannot be told from its surroundings")
        either = "|".join(rf"(?<=({regex.escape(c[0])}))(\\*)(?={regex.escape(c[1:])})" for c in controls)
        self._gap = regex.compile(either)
        self._turn = regex.compile(
            "(?s)" + regex.escape(OPEN) + "(.*?)" + regex.escape(CLOSE) + "(.*?)" + regex.escape(END)
        )

    def escape(self, text: str) -> str:
        return self._gap.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._gap.sub(lambda m: m[0][1:], text)

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The formatted text and the spans of the learned texts in it."""
        pieces, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{OPEN}{self.escape(role)}{CLOSE}", self.escape(text)
            start = at + len(head)
            at = start + len(body)
            if role == LEARNED and body:
                spans.append((start, at))
            pieces += [head, body, END]
            at += len(END)
        return "".join(pieces), spans

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts read back from a formatted text."""
        turns, at = [], 0
        while at < len(formatted):
            found = self._turn.match(formatted, at)
            if found is None:
                raise ValueError("not a formatted conversation")
            turns.append((self.unescape(found[1]), self.unescape(found[2])))
            at = found.end()
        return turns

    def learned(self, formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
        """The texts under a loss mask, one for each run of masked tokens."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], loss.astype(np.int8), [0]))))
        return [self.unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2])]


def template_of(definition: str) -> Template:
    return Template([t["content"] for t in json.loads(definition)["added_tokens"]])


def tokenizer_of(definition: str) -> Tokenizer:
    """The tokenizer with the marks as tokens; offsets are untrimmed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (OPEN, CLOSE, END)])
    return tokenizer


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens meet a span: the first span that ends behind a token's start decides."""
    if not spans:
        return np.zeros(len(starts), bool)
    opens, closes = np.array(spans).T
    at = np.searchsorted(closes, starts, side="right")
    return (at < len(closes)) & (opens[np.minimum(at, len(opens) - 1)] < ends)


def _definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def formatted(
    conversations: DataFrame,
    tokenizer_path: str,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    ranges: int | None = None,
) -> DataFrame:
    """Rendered conversations with token ids, offsets and loss mask.

    ``task`` and ``number`` order the parts of a conversation; ``whole`` tells parts
    that are known to be a whole conversation.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    definition = spark.sparkContext.broadcast(_definition(tokenizer_path))
    template_of(definition.value)  # refuses what cannot be escaped
    names = ["conv_id", "task", "number", "whole", "formatted", "ids", "starts", "ends", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        template, tokenizer = template_of(definition.value), tokenizer_of(definition.value)
        key, turns, chars = None, [], 0
        inner = False  # the conversation at hand began in this task, and is uncut so far
        id_type = None

        def part(whole: bool) -> pa.RecordBatch:
            shown, spans = template.render(turns)
            found = tokenizer.encode(shown, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0], offsets[:, 1]
            values = [key], [task], [number], [whole], [shown], [found.ids]
            types = id_type, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32())
            arrays = [pa.array(v, t) for v, t in zip(values, types)]
            ints = [pa.array([a], pa.list_(pa.int32())) for a in (starts, ends)]
            loss = pa.array([masked(starts, ends, spans)], pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([*arrays, *ints, loss], names=names)

        any_before = False
        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, r, t in zip(*(column.to_pylist() for column in batch.columns[:3])):
                if turns and (c != key or chars >= PART_CHARS):
                    yield part(whole=inner and c != key)
                    inner, number, turns, chars = c != key, number + 1, [], 0
                elif not any_before:
                    inner = False
                any_before, key = True, c
                turns.append((r or "", t or ""))
                chars += len(r or "") + len(t or "")
        if turns:
            yield part(whole=False)

    key = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text")]
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn")
    )
    # The last key parts rows that are alike; among those any order is the same.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    laid = rows.repartitionByRange(*([ranges] if ranges else []), *key, "row").sortWithinPartitions(*key, "row")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return laid.select("conv_id", "role", "text").mapInArrow(
        run,
        f"conv_id {kind}, task int, number bigint, whole boolean, formatted string, ids array<int>, "
        "starts array<int>, ends array<int>, loss array<boolean>",
    )


class _Digest:
    """What is told of a conversation, part after part."""

    def __init__(self):
        self.turns, self.chars, self.shown = 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: int, said: bytes, chars: int, learned: bytes, shown: int) -> None:
        self.turns += turns
        self.chars += chars
        self.shown += shown
        self.said.update(said)
        self.learned.update(learned)

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.chars, self.learned.hexdigest(), self.shown


_TOLD = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_TOLD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
_TOLD_DDL = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def report(conversations: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Per conversation, what the formatted text and its loss mask read back as.

    A part that is a whole conversation is digested where it was made. The others hand
    on their bytes and are strung together in order, part by part, in one stream a
    conversation, as a digest must read a conversation from its start.
    """
    spark = conversations.sparkSession
    parts = formatted(conversations, tokenizer_path, **options)
    kind = parts.schema["conv_id"].dataType.simpleString()
    specials = spark.sparkContext.broadcast(_definition(tokenizer_path))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_of(specials.value)
        for batch in batches:
            told, said_parts, learned_parts = [], [], []
            for i, (shown, whole) in enumerate(zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())):
                turns = template.turns(shown)
                starts, ends, loss = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (6, 7, 8)
                )
                learned = "".join(template.learned(shown, starts, ends, loss))
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                digest = _Digest()
                digest.add(len(turns), said, len(learned), learned.encode(), len(shown))
                told.append(digest.row())
                said_parts.append(None if whole else said)
                learned_parts.append(None if whole else learned.encode())
            columns = [pa.array(v, t) for v, t in zip(zip(*told), _TOLD_TYPES)]
            columns += [pa.array(v, pa.binary()) for v in (said_parts, learned_parts)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *columns], names=["conv_id", "task", "number", "whole", *_TOLD, "said", "learned"]
            )

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, id_type = None, None, None

        def row() -> pa.RecordBatch:
            arrays = [pa.array([v], t) for v, t in zip((key, *digest.row()), (id_type, *_TOLD_TYPES))]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *_TOLD])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for c, *values in zip(*(column.to_pylist() for column in batch.columns)):
                if digest is None or c != key:
                    if digest is not None:
                        yield row()
                    key, digest = c, _Digest()
                digest.add(*values)
        if digest is not None:
            yield row()

    told = written(
        parts.mapInArrow(
            read,
            f"conv_id {kind}, task int, number bigint, whole boolean, {_TOLD_DDL}, said binary, learned binary",
        ),
        "conversations",
    )
    split = (
        told.where("not whole")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "task", "number")
        .select("conv_id", "n_turns", "said", "loss_chars", "learned", "formatted_chars")
    )
    return (
        told.where("whole").select("conv_id", *_TOLD).unionByName(split.mapInArrow(strung, f"conv_id {kind}, {_TOLD_DDL}"))
    )
