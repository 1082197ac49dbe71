"""Python work over Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes that a step works on at a time, and bytes of Spark's Arrow batches where the session says nothing of them.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``BATCH_BYTES``, ``BATCH_ROWS`` at most."""
    rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined while they are of ``most`` bytes together; a larger one stays alone."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def map_runs(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType, most: int) -> DataFrame:
    """Applies ``step`` to Arrow batches joined up to ``most`` bytes. The size of Spark's batches is as in ``map_slices``."""
    _small_batches(df)
    return df.mapInArrow(lambda batches: (made for run in runs(batches, most) for made in step(run)), schema)


def _small_batches(df: DataFrame) -> None:
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def map_slices(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Applies ``step`` to parts of every Arrow batch. A session without a size of its own for batches gets a small one, as Spark's is several times that in a task's memory."""
    _small_batches(df)
    return df.mapInArrow(lambda batches: (step(part) for batch in batches for part in slices(batch)), schema)
