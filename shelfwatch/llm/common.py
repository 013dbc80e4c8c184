"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.session import staged

__all__ = ["BATCH_ROWS", "STEP_BYTES", "WORD", "blank_null", "documents", "give_back", "sliced", "staged", "staged_few", "tag", "tidy", "words_of"]

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


#: Rows an Arrow batch may hold, so that a batch of very long texts still fits a worker.
BATCH_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; lowers the session's Arrow batch size for the operators that read it in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


#: Bytes of text that numpy works on at a time; arrays over them take some tens of times as much.
STEP_BYTES = 2_000_000


def give_back() -> None:
    """Memory that this process no longer uses back to the system; idle workers wait with what they have."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work):
    """A function of batches that gives its memory back when it ends."""
    @functools.wraps(work)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return tidied


def sliced(batches: Iterator[pa.RecordBatch], *columns: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named columns of a slice have at most ``most`` bytes together, or one row."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


#: Rows of small records worth a task and a file of their own.
FILE_ROWS = 5000


def staged_few(df: DataFrame, label: str, rows: int) -> DataFrame:
    """:func:`staged` for about ``rows`` rows of small records: many shuffle partitions of a few rows each share tasks and files."""
    return staged(df.coalesce(max(1, -(-rows // FILE_ROWS))), label)


def blank_null(text: str | Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null or a text of white space only."""
    bare = F.trim(text, F.lit(_SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))


def tag(label: str) -> str:
    """A column name that no input column has."""
    return f"_{label}_{uuid.uuid4().hex[:8]}"
