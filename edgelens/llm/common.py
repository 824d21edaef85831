"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Bytes of one batch handed to a Python worker; bounds its memory for long texts.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

# Words as the contracts define them: runs of bytes outside ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep the batches that go to Python workers small whatever the texts' lengths."""
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def byte_count(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def broadcast_object(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function that gives ``value`` in a task; its classes travel along.

    (A plain broadcast names classes by their module, which workers may not have.)
    """
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get() -> object:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return get


def with_columns(
    df: DataFrame, text: str, added: T.StructType, compute: Callable[[list[bytes]], list[pa.Array]]
) -> DataFrame:
    """``df`` with columns that ``compute`` derives from batches of a text column.

    ``compute`` gets the texts as UTF-8 bytes (null: None) and returns one array per
    added field. All columns of ``df`` pass through; the names must be free.
    """
    bound_batches(df.sparkSession)
    at = df.columns.index(text)
    names = [*df.columns, *added.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(texts)], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays side by side, compressed with zstd."""
    head = np.array([len(a) for a in arrays], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes, *types: str) -> list[np.ndarray]:
    """The arrays of ``packed``, which were of these types."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 8 * len(types)
    for size, kind in zip(np.frombuffer(raw, "<i8", len(types)), types, strict=True):
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += out[-1].nbytes
    return out
