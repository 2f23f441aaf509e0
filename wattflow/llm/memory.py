"""Memory of Python workers: batches bounded by bytes, and free memory given back between them, as workers live through many stages."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

#: A batch that goes to a Python worker ends after so many rows, and by default after any bytes: ten thousand long texts.
SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def bound_batches(spark: SparkSession) -> None:
    """Bound batches by BATCH_BYTES unless the session has a bound of its own. No result depends on it."""
    if not spark.conf.get(SETTING, None):
        spark.conf.set(SETTING, BATCH_BYTES)


def give_back() -> None:
    """Return what is free in the pools of Arrow and the C library to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(work):
    """A function of a table that gives memory back when it is done."""

    def done(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            give_back()

    return done
