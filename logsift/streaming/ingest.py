"""Structured Streaming: live ingest, consume-once evaluation, continuous digests.

* :func:`lines_stream` reads text files (or takes any streaming DataFrame
  with a payload column), decodes, frames and parses lines, stamping the
  receive time when the source has none.
* :func:`consume_once` is the evaluate-then-consume batch: an
  ``availableNow`` trigger with ``foreachBatch``; the batch is digested,
  assessed and its findings appended idempotently (keyed by query and batch id). The
  source offsets are committed only after the batch function returns, so a
  failing assessment leaves the lines for the next run.
* :func:`run_continuous_counts` appends each micro-batch's template counts per
  period; :func:`continuous_counts` adds them up, late lines and the open period
  included.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import decode_utf8, frame_lines, parse_lines
from ..operators import assess as A
from ..operators import digest as D
from ..operators import findings as FS
from ..session import scratch_path
from ..sources.tables import materialize
from .compact import compact, counts


def lines_stream(spark: SparkSession, path: str, fmt: str = "text",
                 payload_col: str = "value") -> DataFrame:
    """raw_logs rows from a directory of text files (one line per row).

    ``read.text`` already splits on ``\\n``, ``\\r\\n`` and ``\\r``; lines get
    ``ts`` = receive time. They have no ``id`` yet: :func:`consume_once` numbers them.
    """
    src = spark.readStream.format(fmt).load(path)
    return parse_payloads(src.select(F.col(payload_col).alias("raw")))


def received(src: DataFrame) -> Column:
    """Receive time: one instant for a batch table (a literal, equal in all actions on it), the
    micro-batch's for a stream."""
    if src.isStreaming:
        return F.current_timestamp()
    return F.lit(datetime.datetime.now(datetime.timezone.utc))


def parse_payloads(src: DataFrame, raw_col: str = "raw", binary: bool = False) -> DataFrame:
    """Decode (if binary), frame and parse payload rows; adds receive-time ``ts``.

    Other columns (``id``, ``ts``, keys) pass through; lines of one row share them. No id is
    made up: a number that a recomputed task could change is no identity.
    """
    raw = decode_utf8(raw_col) if binary else F.col(raw_col)
    keep = [c for c in src.columns if c != raw_col]
    framed = frame_lines(src.withColumn(raw_col, raw), raw_col, keep=keep, line_col="raw", pos_col=None)
    parsed = parse_lines(framed, "raw", keep=keep)
    return parsed if "ts" in parsed.columns else parsed.withColumn("ts", received(src))


def payload_lines(src: DataFrame, value_col: str = "value", binary: bool = True,
                  ts_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Payload records (e.g. Kafka ``key, value, partition, offset, timestamp``) -> raw_logs rows.

    Lossy UTF-8 decode, framing (``\\r`` as ``\\n``, blank pieces dropped),
    parsing. A line is named by (``partition``, ``offset``, ``pos``), its place in its record,
    which replays repeat; :func:`numbered` turns that into ``id``. ``ts`` is the receive
    time unless ``ts_col`` names a record time. Works on batch and streaming DataFrames.
    """
    named = [c for c in ("topic", "partition", "offset") if c in src.columns]
    keep = list(dict.fromkeys([*(keep or []), *named]))
    raw = decode_utf8(value_col) if binary else F.col(value_col)
    cols = [*keep, raw.alias("_payload")]
    if ts_col:
        cols.append(F.col(ts_col).cast("timestamp").alias("ts"))
    base = src.select(*cols)
    carry = [c for c in base.columns if c != "_payload"]
    framed = frame_lines(base, "_payload", keep=carry, line_col="raw", pos_col="pos")
    parsed = parse_lines(framed, "raw", keep=[c for c in framed.columns if c != "raw"])
    return parsed if "ts" in parsed.columns else parsed.withColumn("ts", received(src))


def numbered(lines: DataFrame, start: int = 0) -> DataFrame:
    """Lines with ``id`` = ``start`` and on, in the order of (topic, partition, offset, pos) where
    the lines have them. The order is a range shuffle and the numbers are offsets of its
    partitions, so no task sees all lines; write the result before using it twice."""
    order = [c for c in ("topic", "partition", "offset", "pos") if c in lines.columns]
    spark = lines.sparkSession
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order) if order else lines
    rows = materialize(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    # rows of a partition before it: one row per partition
    counts = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, start
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    # the written number holds the place in its partition in its lower 33 bits
    base = spark.createDataFrame(list(before.items()), "_p int, _base long")
    place = F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(base, "_p").withColumn("id", (F.col("_base") + place).cast("long")).drop("_p", "_i", "_base")


def kafka_lines_stream(spark: SparkSession, ts_col: str | None = None, **options: str) -> DataFrame:
    """raw_logs rows from a Kafka topic (``kafka.bootstrap.servers``, ``subscribe``, ...).

    Needs the spark-sql-kafka connector on the classpath; without it the
    source fails to load with Spark's own "Failed to find data source" error.
    """
    src = spark.readStream.format("kafka").options(**options).load()
    return payload_lines(src, "value", binary=True, ts_col=ts_col)


def evaluate_all(lines: DataFrame, keys: Sequence[str] = (), k_templates: int = D.K_TEMPLATES,
                 k_samples: int = D.K_SAMPLES, k_hosts: int = D.K_HOSTS) -> DataFrame:
    """One finding per key for all given lines as one period, bounded by the key's first and last
    ``ts`` ("evaluate now", e.g. after :func:`findings.logs_until`). No lines: no finding."""
    keys = list(keys)
    if keys:
        # written first: few sources are broadcast then, and lines aren't shuffled to a task a source
        bounds = materialize(lines.groupBy(*keys).agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end")), "bounds")
        same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
        lines = lines.join(bounds.select(*[F.col(k).alias("_" + k) for k in keys], "period_start", "period_end"), on=same).drop(*["_" + k for k in keys])
    else:
        lo, hi = lines.agg(F.min("ts"), F.max("ts")).first()
        lines = lines.withColumn("period_start", F.lit(lo).cast("timestamp")).withColumn("period_end", F.lit(hi).cast("timestamp"))
    parts = D.digest_parts(lines, keys, k_templates=k_templates, k_hosts=k_hosts, k_samples=k_samples)
    return A.assess_rules(parts, keys)


def _query_id(batch: DataFrame) -> str:
    """Id of the running streaming query: kept in its checkpoint, new with a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def _landed(batch: DataFrame, query: str, batch_id: int, number: bool) -> DataFrame:
    """The micro-batch as a table in the shared folder, written once: a replay after a failure
    reads the same lines with the same times and ids. The batch before it is committed by
    now, so its table goes."""
    spark = batch.sparkSession
    root = scratch_path(spark, "landed", query)
    path, old = f"{root}/{batch_id}", f"{root}/{batch_id - 1}"
    if not FS.path_exists(spark, f"{path}/_SUCCESS"):
        (numbered(batch) if number else batch).write.mode("overwrite").parquet(path)
    if FS.path_exists(spark, old):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(_with_id(batch, number)).parquet(path)


def _with_id(batch: DataFrame, number: bool) -> T.StructType:
    fields = [f for f in batch.schema.fields if not (number and f.name == "id")]
    return T.StructType([*fields, T.StructField("id", T.LongType())] if number else fields)


def consume_once(stream: DataFrame, findings_path: str, checkpoint: str | None = None,
                 keys: Sequence[str] = (), k_templates: int = D.K_TEMPLATES,
                 k_samples: int = D.K_SAMPLES, k_hosts: int = D.K_HOSTS,
                 assess: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Evaluate everything buffered now, store findings, then commit (= consume).

    ``assess(batch, batch_id)`` may replace the rules assessor; if it raises,
    the query fails before the commit and the same lines are evaluated again
    on the next run. Lines without an ``id`` are numbered when their batch is
    landed. Findings are stored once per (keys, period, query, batch): another source, or
    the same one under a new checkpoint, never counts as stored already.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "consume_once", "checkpoint")

    def run(batch: DataFrame, batch_id: int) -> None:
        query = _query_id(batch)
        lines = _landed(batch, query, batch_id, "id" not in batch.columns)
        if lines.isEmpty():
            return
        out = assess(lines, batch_id) if assess else evaluate_all(lines, keys, k_templates, k_samples, k_hosts)
        out = out.withColumn("source_id", F.lit(query)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        FS.append_new(out, findings_path, list(keys), source=["source_id", "batch_id"])

    q = (stream.writeStream.foreachBatch(run).trigger(availableNow=True)
         .option("checkpointLocation", checkpoint).start())
    q.awaitTermination()


def run_continuous_counts(stream: DataFrame, out_path: str, checkpoint: str | None = None,
                          keys: Sequence[str] = (), period: str = "60 minutes",
                          available_now: bool = True, compact_every: int | None = None) -> None:
    """Append each micro-batch's template counts per (keys, period) to ``out_path``.

    Counts of a period add up (:func:`continuous_counts`), so there is no watermark: a late line
    corrects its period whenever it comes, and the period that is still open is there as
    far as it came. A replayed batch replaces its own rows (partition by query and batch). With
    ``compact_every``, committed batches are merged by day after so many (:mod:`.compact`).
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "continuous", "checkpoint")

    def run(batch: DataFrame, batch_id: int) -> None:
        query = _query_id(batch)
        lines = _landed(batch, query, batch_id, "id" not in batch.columns)
        rows = D.template_counts(lines, keys, period).withColumn("source_id", F.lit(query)).withColumn("batch_id", F.lit(batch_id).cast("long"))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("source_id", "batch_id").parquet(out_path))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(spark, out_path, keys)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    q = writer.start()
    if available_now:
        q.awaitTermination()


def continuous_counts(spark: SparkSession, out_path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Template counts per (keys, period) over all micro-batches so far."""
    return counts(spark, out_path, keys)
