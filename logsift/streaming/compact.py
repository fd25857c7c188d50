"""Compaction of continuous template counts.

:func:`ingest.run_continuous_counts` leaves a folder per micro-batch. Compaction adds committed
folders up into one folder per day of ``period_start``, so that the number of files follows the
days and not the micro-batches. Below ``<counts>-merged``:

* ``m=<n>/day=<day>``: the day's counts as of merge n; only days that new folders touch are written;
* ``manifest=<n>``: the folder that holds each day, and for each source the last batch that is
  merged. A merge counts once its manifest is complete.

Folders are deleted after the manifest. The last batch of a source is never merged, as it may
still be replayed; and a folder of a merged batch, should one come again, is not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings as FS
from ..operators.digest import pkeys


def _list(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _value(name: str, key: str) -> str | None:
    return name[len(key) + 1:] if name.startswith(key + "=") else None


def _manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, int], dict[str, int]]:
    """Number of the last merge, the merge that holds each day, the last merged batch of each source."""
    have = sorted(int(v) for n in _list(spark, root) if (v := _value(n, "manifest")) is not None)
    for n in reversed(have):
        if FS.path_exists(spark, f"{root}/manifest={n}/_SUCCESS"):
            rows = spark.read.schema("kind string, name string, value long").parquet(f"{root}/manifest={n}").collect()
            return n, {r.name: r.value for r in rows if r.kind == "day"}, {r.name: r.value for r in rows if r.kind == "source"}
    return -1, {}, {}


def _batches(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Batches of each source that have a folder."""
    return {s: sorted(int(b) for x in _list(spark, f"{path}/source_id={s}") if (b := _value(x, "batch_id")) is not None)
            for n in _list(spark, path) if (s := _value(n, "source_id")) is not None}


def _summed(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "template").agg(
        F.sum("count").cast("long").alias("count"), F.min("first_key").alias("first_key"), F.sum("elevated").cast("long").alias("elevated"),
        F.min("worst_severity").alias("worst_severity"), F.min("first_elevated_key").alias("first_elevated_key"))


def _read(spark: SparkSession, paths: list[str], keys: Sequence[str]) -> DataFrame | None:
    if not paths:
        return None
    cols = [*pkeys(keys), "template", "count", "first_key", "elevated", "worst_severity", "first_elevated_key"]
    return spark.read.parquet(*paths).select(*cols)


def _paths(spark: SparkSession, path: str, days: dict[str, int], marks: dict[str, int]) -> list[str]:
    """Folders that hold all counts: merged days and batches that aren't merged."""
    return ([f"{path}-merged/m={m}/day={d}" for d, m in sorted(days.items())]
            + [f"{path}/source_id={s}/batch_id={b}" for s, batches in _batches(spark, path).items() for b in batches if b > marks.get(s, -1)])


def counts(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """Template counts per (keys, period) over all micro-batches so far, merged or not."""
    _, days, marks = _manifest(spark, f"{path}-merged")
    rows = _read(spark, _paths(spark, path, days, marks), keys)
    if rows is None:
        raise FileNotFoundError(f"no counts in {path}")
    return _summed(rows, pkeys(keys))


def compact(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> int:
    """Merge the committed batches (all but the last of each source); returns how many were merged."""
    root = f"{path}-merged"
    n, days, marks = _manifest(spark, root)
    every = _batches(spark, path)
    new = {s: [b for b in batches[:-1] if b > marks.get(s, -1)] for s, batches in every.items()}
    folders = [f"{path}/source_id={s}/batch_id={b}" for s, batches in new.items() for b in batches]
    if not folders:
        return 0
    rows = _read(spark, folders, keys).withColumn("day", F.to_date("period_start").cast("string"))
    touched = [r[0] for r in rows.select("day").distinct().collect()]
    old = _read(spark, [f"{root}/m={days[d]}/day={d}" for d in touched if d in days], keys)
    if old is not None:
        rows = rows.unionByName(old.withColumn("day", F.to_date("period_start").cast("string")))
    here = n + 1
    merged = _summed(rows, [*pkeys(keys), "day"])
    merged.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/m={here}")
    gone = [f"{root}/m={days[d]}/day={d}" for d in touched if d in days]
    days = days | {d: here for d in touched}
    marks = marks | {s: batches[-1] for s, batches in new.items() if batches}
    manifest = [("day", d, m) for d, m in days.items()] + [("source", s, b) for s, b in marks.items()]
    spark.createDataFrame(manifest, "kind string, name string, value long").coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest={here}")
    for f in [*folders, *gone, *([f"{root}/manifest={n - 1}"] if n > 0 else [])]:
        _delete(spark, f)
    return len(folders)
