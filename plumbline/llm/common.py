"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Bytes of a batch of rows that goes to a task, long texts or short.
BATCH_BYTES, BATCH_CONF, SPARKS_OWN = f"{2 << 20}b", "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def bound_batches(spark: SparkSession) -> None:
    """Rows come to tasks in batches of about ``BATCH_BYTES``, unless the session was given another bound than Spark's own."""
    if spark.conf.get(BATCH_CONF) == SPARKS_OWN:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes; one longer row is a run of its own.

    Arrow batches are bounded by rows, and by bytes loosely. Working slice by slice bounds a task's memory by ``limit`` and its longest text.
    """
    lengths = batch.column(batch.schema.names.index(column))
    lengths = lengths.cast(pa.large_binary()) if not pa.types.is_large_binary(lengths.type) else lengths
    sizes = pa.compute.binary_length(lengths).fill_null(0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """True where crc32 of the key's decimal text leaves ``remainder``; false for a NULL key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(rows: DataFrame, label: str, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows of each label at most, chosen by a hash of ``keys``; all rows of a label that has no more.

    Every label is counted over all rows; only one number per label comes to the driver.
    """
    counts = rows.groupBy(label).count().collect()
    draw = F.xxhash64(F.lit("sample"), *keys)
    last = F.lit(None).cast("long")
    for row in counts:
        kept = min(2 ** 64 - 1, most * 2 ** 64 // row["count"])
        last = F.when(F.col(label) == row[label], F.lit(kept - 2 ** 63)).otherwise(last)
    return rows.where(draw <= last)
