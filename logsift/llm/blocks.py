"""Rows packed into compressed blocks.

Some operators must look at whole texts, ask other tasks about what they saw
and return to the same rows. A block is a run of rows of one task as a
zstd-compressed Arrow stream with all their columns, about a third of the
size that the rows take in a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_root
from ..sources.tables import write_table
from .words import slices

BLOCK_BYTES = 3 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(blob)) as stream:
        return stream.read_next_batch()


def release() -> None:
    """Give memory that Arrow keeps for later back to the system: a worker lives through many
    tasks and stages, and its next one may need it elsewhere."""
    pa.default_memory_pool().release_unused()


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts and blocks to Python in batches of some megabytes (a session setting):
    the default of 10,000 rows holds tens of megabytes of them on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    checkpoint_root(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def blocks(df: DataFrame, text: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """``(block string, blob binary)``, dealt by block. A plan may use it twice: Spark shuffles
    it once and reads the shuffle again. The names of equal blocks differ by task and place,
    and follow from the content, so a recomputed block can't be taken for another."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        for k, part in enumerate(slices(batches, text, limit)):
            blob = pack(part)
            name = hashlib.blake2b(f"{task} {k} ".encode() + blob, digest_size=16).hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob], pa.binary())], ["block", "blob"])

    return df.mapInArrow(run, "block string, blob binary").repartition("block")


def buckets(spark: SparkSession) -> int:
    """Parts that a space of hashes is cut into: a power of two, twice the session's shuffle
    partitions at least, which are set to fit the data as for any other job."""
    return 1 << math.ceil(math.log2(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
