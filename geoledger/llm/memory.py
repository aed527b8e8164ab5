"""Memory of Python workers between tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_ROWS = 2000


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives unused memory back to the system: it lives on and serves other tasks, and
    what its largest task once took would otherwise stay with it."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidied


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends at most ``BATCH_ROWS`` rows to a worker at a time from now on. By default it is 10,000: of whole
    texts that is tens of MB, which an executor holds several times for each core, outside the heap and in the worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df
