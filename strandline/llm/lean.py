"""Memory of Python workers, which Spark keeps for later tasks and other operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of rows in a batch of ``small_batches``; a longer row stands alone.
BATCH_BYTES = 1 << 20

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Return to the system what the allocators hold and nothing uses any more."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the bytes, not only the rows, of the Arrow batches that this session gives to Python workers from now on.

    By default a batch has up to 10,000 rows and 64 MB: all texts of a task at once, in the executor's buffers and
    in the worker's. The setting stays with the session, as a DataFrame is planned only when it is read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def lean(run):
    """``run``, a function for ``mapInArrow``, that returns freed memory after each batch that it was given, and at its end.

    Allocators keep what is freed for the worker's next request. An executor's idle workers then hold the most that any
    task has needed, beside the tasks of other operators and the executor's own heap.
    """

    def handed(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def wrapped(batches):
        try:
            yield from run(handed(batches))
        finally:
            give_back()

    return wrapped
