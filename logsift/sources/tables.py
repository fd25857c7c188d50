"""Written tables in the shared checkpoint folder.

Parsed lines form the ``raw_logs`` table: written once by ingest,
read by every evaluation. Reading a written Parquet table (instead of
re-deriving it) pushes ``severity`` / ``ts`` predicates into the scan,
prunes columns per branch and cuts the lineage, so an executor loss
recomputes from the table, not from the raw text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import scratch_path


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as Parquet under the shared folder; returns the path."""
    path = scratch_path(df.sparkSession, "tables", f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _delete_at_end(df.sparkSession, path)
    return path


def _delete_at_end(spark, path: str) -> None:
    """Written tables serve one session: they go when its JVM ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write then read back: the rest of the plan starts from a table scan."""
    return df.sparkSession.read.parquet(write_table(df, name, partition_by))
