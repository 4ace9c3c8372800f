"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the white space that separates words, as `[^\x20\x09-\x0D]+` has it
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle; the setting grows with the cluster's data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_digest(docs: DataFrame, name: str = "text_key") -> DataFrame:
    """Tells apart rows that share a doc_id; equal rows get equal keys."""
    return docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))


def text_key(text: bytes) -> int:
    """Like ``with_digest``, within Python: a signed 64-bit hash of the whole text."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def slices(batches: Iterable[pa.RecordBatch], most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the ``text`` column of each holds about ``most`` bytes.

    A longer text makes a slice of its own, so memory follows the longest single text.
    """
    for batch in batches:
        at = batch.schema.get_field_index("text")
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Task) -> Task:
    """A task that gives freed memory back to the machine at its end, as its worker lives on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """The texts in UTF-8; null counts as empty."""
    column = batch.column(batch.schema.get_field_index("text"))
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def spans_of(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal true runs."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def cover(length: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``length`` places lie in one of the half-open intervals."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
