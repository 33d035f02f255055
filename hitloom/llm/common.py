"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.session import work_dir

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"

#: Text bytes that a Python worker handles at once.
SLICE_BYTES = 4 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch where rows are texts; the executor and its worker hold several batches each.
BATCH_ROWS, BATCH_SETTING = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of such a batch, where rows of numbers and words are to come in larger batches all the same.
BATCH_BYTES, BYTES_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(*names: str) -> list[str]:
    """Column names that clash with none of the caller's."""
    mark = uuid.uuid4().hex[:8]
    return [f"__{n}_{mark}" for n in names]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared work folder and read back: later stages survive the loss of executors.

    What the write shuffled is needed no more and goes at once, not when the driver happens to collect garbage.
    """
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have BATCH_ROWS rows at most."""
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def light_batches(spark: SparkSession) -> None:
    """From now on an Arrow batch of this session ends with the row that brings it to BATCH_BYTES."""
    spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))


def kept_by_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by a Python worker until another key is asked for.

    Workers serve one stage after another; with a place for each operator they would hold the tables of all of them.
    """
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


_kept: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory to the system: a worker that later stages use again would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, length: Callable = pc.binary_length) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts hold ``limit`` bytes at most (or what ``length`` counts); one longer text comes alone."""
    for batch in batches:
        size = pc.fill_null(length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
        give_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


class Words:
    """The words of a run of texts: ``distinct`` ones, and for every text the places of its words among them.

    ``offsets`` has one entry more than texts; text i has ``codes[offsets[i]:offsets[i + 1]]``. Null texts have none.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = parts.flatten()
        coded = pc.dictionary_encode(flat)
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        if "" in self.distinct:  # white space at either end of a text
            full = codes != self.distinct.index("")
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            codes = codes[full]
        self.codes, self.offsets = codes, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
