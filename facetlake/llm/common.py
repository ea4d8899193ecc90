"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and U+0009..U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of texts that a task unpacks at a time where each takes many numbers or strings until its row is made.
TEXT_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], records: int = 1000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most ``records`` rows and about ``most_bytes``, so that a worker unpacks few long texts at a time."""
    for batch in batches:
        step = max(1, min(records, batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def released() -> None:
    """Memory that a stage no longer needs goes back to the system: an idle worker keeps what it has."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, what a task does with its batches, after which the memory that it took goes back to the system.

    Workers outlive tasks: what they keep stands beside all that the JVM does later, for as long as they wait.
    """

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return ended


_HELD: dict[tuple, object] = {}


def held_by_worker(owner: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks of one operator; what it kept for another one is let go first."""
    if owner not in _HELD:
        _HELD.clear()
        released()
        _HELD[owner] = make()
    return _HELD[owner]


class Cache(dict):
    """A cache bounded by bytes: ``trim`` empties it once what was put in is more than ``most``."""

    #: Bytes of an entry besides its key and value, about.
    ENTRY = 200

    def __init__(self, most: int = 32 << 20):
        super().__init__()
        self.most, self.bytes = most, 0

    def put(self, key, value, size: int):
        self[key] = value
        self.bytes += size + self.ENTRY
        return value

    def trim(self) -> None:
        if self.bytes > self.most:
            self.clear()
            self.bytes = 0


def text_of(column: str) -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
