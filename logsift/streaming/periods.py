"""Event-time closing of periods: each period once when it closes, and corrections for late lines.

Template counts per (keys, period) are a windowed aggregation in update mode. Its
watermark is ``horizon`` behind the newest line: as long, a period's counts stay in the
state store and take late lines; then Spark drops the state, and lines that are later
still are dropped by it and told in the progress (``numRowsDroppedByWatermark``).

A period closes when a line comes whose time is ``close_after`` past the period's end.
Per micro-batch b, ``out`` gets, below ``batch_id=b``:

* ``emitted``: the rows (keys, period, template, counts) of every period that closes with
  this batch (``correction`` false), and the new totals of templates of periods closed before
  that got late lines (``correction`` true);
* ``open``: the totals of the periods still open, read by the next batch only;
* ``mark``: the newest time seen so far.

Everything follows from the batch's rows and the tables of the batch before it, so a
replayed batch writes the same again. :func:`closed_counts` takes the newest totals of each
template. Periods have one length in UTC (``F.window``), as state can only be dropped by window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import seen_key
from ..functions.severity import is_elevated
from ..functions.template import templatize
from ..operators import findings as FS
from ..operators.digest import PERIOD, pkeys
from ..session import scratch_path

#: What is counted for each template of a period.
TOTALS = ["count", "first_key", "elevated", "worst_severity", "first_elevated_key"]


def period_totals(lines: DataFrame, keys: Sequence[str] = (), period: str = "60 minutes", horizon: str = "7 days", start_time: str | None = None) -> DataFrame:
    """Totals per (keys, period, template) of a stream of lines (``id``, ``ts``, ``severity``,
    ``message``, keys), with the period's newest time. On a batch table the watermark has no effect."""
    window = F.window("ts", period, startTime=start_time) if start_time else F.window("ts", period)
    totals = (lines.withColumn("template", templatize("message")).withWatermark("ts", horizon)
              .groupBy(*keys, window.alias("window"), "template")
              .agg(F.count(F.lit(1)).alias("count"), F.min(seen_key()).alias("first_key"), F.count_if(is_elevated("severity")).alias("elevated"),
                   F.min("severity").alias("worst_severity"), F.min(F.when(is_elevated("severity"), seen_key())).alias("first_elevated_key"),
                   F.max("ts").alias("last_ts")))
    return totals.select(*keys, F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "template", *TOTALS, "last_ts")


def _closed(close_after: str, mark) -> Column:
    """Has the period ended ``close_after`` before the newest time ``mark``?"""
    if mark is None:
        return F.lit(False)
    return F.col("period_end") + F.expr(f"INTERVAL {close_after}") <= F.lit(mark)


def close_periods(stream: DataFrame, out: str, checkpoint: str | None = None, keys: Sequence[str] = (), period: str = "60 minutes",
                  close_after: str = "1 hour", horizon: str = "7 days", start_time: str | None = None, available_now: bool = True):
    """Run :func:`period_totals` over ``stream`` and emit periods as they close (see above). Returns the
    query, which has ended if ``available_now``."""
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "periods", "checkpoint")
    rows = [*pkeys(keys), "template", *TOTALS]

    def run(batch: DataFrame, batch_id: int) -> None:
        here, before = f"{out}/batch_id={batch_id}", f"{out}/batch_id={batch_id - 1}"
        s = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{here}/totals")  # the state's rows are read once
        new = s.read.schema(batch.schema).parquet(f"{here}/totals")
        was = s.read.parquet(f"{before}/mark").first()["mark"] if batch_id else None
        mark = new.agg(F.max("last_ts")).first()[0]
        mark = was if mark is None else mark if was is None else max(mark, was)
        late = new.filter(_closed(close_after, was)).select(*rows, F.lit(True).alias("correction"))
        current = new.filter(~_closed(close_after, was)).select(*rows)
        if batch_id:  # open periods: this batch's totals replace those of the same template
            old = s.read.schema(current.schema).parquet(f"{before}/open")
            same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in [*pkeys(keys), "template"]]
            changed = current.select(*[F.col(k).alias("_" + k) for k in [*pkeys(keys), "template"]])
            current = current.unionByName(old.join(changed, on=same, how="left_anti"))
        closes = current.filter(_closed(close_after, mark)).withColumn("correction", F.lit(False))
        closes.unionByName(late).write.mode("overwrite").parquet(f"{here}/emitted")
        current.filter(~_closed(close_after, mark)).write.mode("overwrite").parquet(f"{here}/open")
        _delete(spark, f"{here}/totals")
        s.createDataFrame([(mark,)], "mark timestamp").coalesce(1).write.mode("overwrite").parquet(f"{here}/mark")
        if batch_id > 1:  # the batch before the last is committed: nothing reads its open periods again
            _delete(spark, f"{out}/batch_id={batch_id - 2}/open")

    totals = period_totals(stream, keys, period, horizon, start_time)
    writer = totals.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    q = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        q.awaitTermination()
    return q


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def emitted(spark: SparkSession, out: str) -> DataFrame:
    """All rows emitted so far with their ``batch_id``; batches that are not complete don't count."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ids = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("batch_id="))
    paths = [f"{out}/batch_id={i}/emitted" for i in ids if FS.path_exists(spark, f"{out}/batch_id={i}/mark/_SUCCESS")]
    rows = spark.read.parquet(*paths)
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"batch_id=(\d+)/emitted", 1).cast("long")
    return rows.withColumn("batch_id", batch)


def closed_counts(spark: SparkSession, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Template counts of closed periods, late lines included: the newest totals of each template, with
    the count at closing (null for a template that only late lines have) and the number of corrections."""
    rows = emitted(spark, out)
    at = F.max_by(F.struct(*TOTALS), "batch_id")
    return (rows.groupBy(*keys, *PERIOD, "template")
            .agg(at.alias("_t"), F.max(F.when(~F.col("correction"), F.col("count"))).alias("count_at_close"), F.count_if("correction").alias("corrections"))
            .select(*keys, *PERIOD, "template", "_t.*", "count_at_close", "corrections"))
