"""Slices of Arrow batches: long texts make a batch of the default row count too much for a worker.

Spark bounds the bytes of a batch that it sends (``spark.sql.execution.arrow.maxBytesPerBatch``);
what a task makes of it at once is bounded here. Where an operator runs a job of its own,
``small`` bounds the rows that are sent, too, and then gives the session its setting back.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS, BYTES = 1000, 4 << 20
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in turn, at most ``rows`` and on average at most ``size`` bytes at once; a longer row is alone."""
    for b in batches:
        per = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, per):
            yield b.slice(at, per)


@contextlib.contextmanager
def small(spark: SparkSession, rows: int = ROWS) -> Iterator[None]:
    """Jobs that run meanwhile send at most ``rows`` rows in a batch; a smaller setting of the session stays."""
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)
