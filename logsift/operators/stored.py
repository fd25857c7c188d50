"""Cheap answers from stored tables: newest rows by a walk over days, counts from file footers.

Tables are Parquet folders with one folder per day (``period_date`` or ``log_date``, the day of
``ts``), so rows of a later day are newer than all rows of an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import findings as FS


def day_folders(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(day, folder)`` of a stored table, newest first; a folder of rows without a day comes last."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and "=" in s.getPath().getName()]
    days = [(n.split("=", 1)[1], f"{path}/{n}") for n in names]
    return sorted(days, key=lambda d: (not d[0].startswith("__"), d[0]), reverse=True)


def _days(spark: SparkSession, path: str, folders: list[tuple[str, str]]) -> DataFrame:
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(*[f for _, f in folders])


def history_stored(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """The newest ``limit`` rows, as :func:`findings.history` of the whole table gives them. Days are read
    from the newest back, twice as many each time, until they hold enough rows (counted from
    footers); a negative limit reads all."""
    folders = day_folders(spark, path)
    n = len(folders) if limit is None or limit < 0 else 1
    while n < len(folders) and _days(spark, path, folders[:n]).count() < limit:
        n *= 2
    if not folders:
        raise FileNotFoundError(f"no stored days in {path}")
    return FS.history(_days(spark, path, folders[:n]), limit)


def latest_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest row."""
    return history_stored(spark, path, 1)


def from_footers(spark: SparkSession, path: str) -> DataFrame:
    """The table through Spark's V2 Parquet reader, which answers counts from footers
    (``PushedAggregation`` in the plan) without reading a column."""
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    spark.conf.set(key, ",".join(x for x in before.split(",") if x.strip() != "parquet"))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def monitor_stored(spark: SparkSession, lines: str, findings: str) -> DataFrame:
    """One row as :func:`findings.monitor_snapshot` gives it, from two stored tables: counts from
    footers, the last evaluation from the newest day. A table that is not there counts 0."""
    long0, ts0 = F.lit(None).cast("long"), F.lit(None).cast("timestamp")
    rows = spark.range(1).select(F.lit(0).cast("long").alias("buffered_logs"), F.lit(0).cast("long").alias("findings_stored"), ts0.alias("last_evaluation_ts"))
    if day_folders(spark, lines):
        rows = rows.unionByName(from_footers(spark, lines).agg(F.count(F.lit(1)).alias("buffered_logs"))
                                .select("buffered_logs", long0.alias("findings_stored"), ts0.alias("last_evaluation_ts")))
    if day_folders(spark, findings):
        rows = rows.unionByName(from_footers(spark, findings).agg(F.count(F.lit(1)).alias("findings_stored"))
                                .select(long0.alias("buffered_logs"), "findings_stored", ts0.alias("last_evaluation_ts")))
        rows = rows.unionByName(latest_stored(spark, findings).select(long0.alias("buffered_logs"), long0.alias("findings_stored"), F.col("ts").alias("last_evaluation_ts")))
    return rows.agg(*[F.max(c).alias(c) for c in ("buffered_logs", "findings_stored", "last_evaluation_ts")])
