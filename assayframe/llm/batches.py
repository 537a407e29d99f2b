"""Helpers for operators that work on Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of text handled at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20
# Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# The characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each stay within ``most`` bytes, without a copy and without losing a row."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def hand_back() -> None:
    """Return freed memory to the system, which the allocators of Python and Arrow otherwise hold for a worker's next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def tidy(run: Callable) -> Callable:
    """``run`` over a task's batches; what it held goes back to the system when the task ends, so idle workers stay small."""

    def whole(batches):
        yield from run(batches)
        hand_back()

    return whole


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return column.cast(pa.binary()).to_pylist()


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return; A-Z lower-cased if asked."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def crc_fold(key: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the key as text; a missing key counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def crc_remainder(key, folds: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % folds


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` unchanged; its session hands texts to Python in batches of at most ``BATCH_ROWS`` rows from now on.

    A batch is held whole by the JVM and by Python, so its rows bound the memory
    of a task that maps texts.  A smaller setting of the session stays.
    """
    settings = df.sparkSession.conf
    rows = int(settings.get(BATCH_SETTING, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        settings.set(BATCH_SETTING, str(BATCH_ROWS))
    return df
