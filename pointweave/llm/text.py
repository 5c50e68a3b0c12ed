"""What the operators share: reading inputs, null texts, row keys and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def doc_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` (BIGINT) and ``text`` (null: empty), whatever further columns there are."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


def words(text: Column) -> Column:
    """The words of a text in order; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into short ones, so that what a step holds beside the batch stays small.

    At the end what is free goes back to the system: a worker process stays for further tasks.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Memo:
    """What a worker remembers, in about ``most`` bytes: a young and an old half.

    When the young half is full it becomes the old one; what is asked for again moves to the young half, so frequent keys
    stay.  ``young`` is a plain dictionary for fast reading; between two calls of ``turn`` nothing in it goes away.
    """

    def __init__(self, most: int, each: int = 200):
        """``each``: bytes counted for an entry's objects and places, beside its key's and its value's lengths."""
        self.most, self.each, self.held = most, each, 0
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if 2 * self.held > self.most:
            self.old, self.young, self.held = self.young, {}, 0

    def put(self, key: str, value) -> None:
        self.young[key] = value
        self.held += len(key) + len(value) + self.each

    def again(self, key: str):
        """The value of a key that is not in the young half, or None."""
        value = self.old.pop(key, None)
        if value is not None:
            self.put(key, value)
        return value
