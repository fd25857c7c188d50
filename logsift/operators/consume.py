"""Batch consume-once on a stored ``raw_logs`` table, with a consumed-until mark per source.

A run evaluates the lines ``mark < ts <= cutoff`` of each source (a combination of
``keys``; without keys there is one source), stores the findings and then moves the
marks to the cutoff. A source whose assessment failed keeps its mark, so that its lines
are read again. Days that lie wholly behind the marks are dropped from the buffer; the
day of the mark stays readable.

A run is a numbered folder below ``state``, written in this order:

1. ``advance``: the marks this run will set, ``staged``: its findings, each a complete
   table (``_SUCCESS``) or nothing;
2. the findings table gets the staged rows, once per (keys, period, state, run);
3. ``marks``: all marks after the run. The run is committed once this table is complete.

A run that stopped before ``staged`` was complete has changed nothing and counts for
nothing. One that stopped later is finished by the next call from what it staged: the
append repeats itself harmlessly, and its lines aren't evaluated again. So a crash at any
point neither loses nor repeats a line. One consumer uses a state at a time.

``ts`` is the time a line was received, so a line behind its source's mark doesn't
arrive; lines with record times of their own, which can be late, belong to
:mod:`logsift.streaming.periods`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import findings as FS
from .digest import K_HOSTS, K_SAMPLES, K_TEMPLATES, digest_parts

#: ``evaluate(lines, keys) -> (findings, sources that failed or None)``
Evaluate = Callable[[DataFrame, list[str]], tuple[DataFrame, DataFrame | None]]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, state: str) -> list[int]:
    p, fs = _fs(spark, f"{state}/runs")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def _days(spark: SparkSession, buffer: str) -> list[tuple[str, object]]:
    """Days of a buffer with their folders; none once all lines are consumed."""
    p, fs = _fs(spark, buffer)
    folders = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [(f.getName().split("=", 1)[1], f) for f in folders if f.getName().startswith("log_date=")]


def _whole(spark: SparkSession, path: str) -> bool:
    return FS.path_exists(spark, f"{path}/_SUCCESS")


def _run(state: str, n: int) -> str:
    return f"{state}/runs/{n:08d}"


def marks(spark: SparkSession, state: str) -> DataFrame | None:
    """``(keys, until)`` of the last committed run; None before the first."""
    for n in reversed(_runs(spark, state)):
        if _whole(spark, f"{_run(state, n)}/marks"):
            return spark.read.parquet(f"{_run(state, n)}/marks")
    return None


def unconsumed(lines: DataFrame, known: DataFrame | None, keys: Sequence[str] = (), cutoff=None) -> DataFrame:
    """Rows of ``lines`` behind no mark, up to ``cutoff``. Without keys the bounds are literals,
    which prune days and reach the scan; with keys the marks are joined."""
    if cutoff is not None:
        lines = FS.logs_until(lines, cutoff)
    if known is None:
        return lines
    if not keys:
        until = known.agg(F.max("until")).first()[0]
        return lines if until is None else FS._day_bounds(lines, lo=until).filter(F.col("ts") > F.lit(until))
    m = known.select(*[F.col(k).alias("_" + k) for k in keys], F.col("until").alias("_until"))
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    out = lines.join(m, on=same, how="left").filter(F.col("_until").isNull() | (F.col("ts") > F.col("_until")))
    return out.drop("_until", *["_" + k for k in keys])


def with_bounds(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """All lines of a source as one period, from its first to its last ``ts``. The bounds are written first: their
    size is known then, and few sources are broadcast instead of shuffling all lines to a task a source."""
    bounds = lines.groupBy(*keys).agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end"))
    if not keys:
        lo, hi = bounds.first()
        return lines.withColumn("period_start", F.lit(lo).cast("timestamp")).withColumn("period_end", F.lit(hi).cast("timestamp"))
    bounds = materialize(bounds, "bounds")
    same = [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]
    return (lines.join(bounds.select(*[F.col(k).alias("_" + k) for k in keys], "period_start", "period_end"), on=same)
            .drop(*["_" + k for k in keys]))


def by_rules(lines: DataFrame, keys: list[str], rules: DataFrame | None = None) -> tuple[DataFrame, None]:
    """The rules assessor over one period per source; it never fails."""
    from .assess import assess_rules
    return assess_rules(digest_parts(lines, keys), keys, rules=rules), None


def by_plugin(assessor_factory, k_templates: int = K_TEMPLATES, k_hosts: int = K_HOSTS, k_samples: int = K_SAMPLES) -> Evaluate:
    """A plug-in assessor (:func:`assess.assess_with`) over one period per source; sources whose
    call failed, or whose payload breaks the contract, are returned as failed."""
    from .assess import assess_with
    from .digest import build_digests

    def evaluate(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        digests = build_digests(lines, keys, k_templates=k_templates, k_hosts=k_hosts, k_samples=k_samples)
        answers = assess_with(digests, assessor_factory, keys).checkpoint(eager=True)  # one call a digest
        good, back = FS.findings_from_payloads(answers, keys)
        return good, back
    return evaluate


def _commit(spark: SparkSession, state: str, n: int, buffer: str, findings: str, keys: list[str], step: Callable[[str], None]) -> None:
    """Finish a run whose ``staged`` table is complete."""
    run = _run(state, n)
    staged = spark.read.parquet(f"{run}/staged")
    FS.append_new(staged, findings, keys, source=["source_id", "run"])
    step("appended")
    old, advance = marks(spark, state), spark.read.parquet(f"{run}/advance")
    both = advance if old is None else old.unionByName(advance)
    both.groupBy(*keys).agg(F.max("until").alias("until")).write.mode("overwrite").parquet(f"{run}/marks")
    step("committed")
    drop_consumed(spark, buffer, state, keys)
    step("dropped")


def consume(spark: SparkSession, buffer: str, findings: str, state: str, cutoff, keys: Sequence[str] = (),
            evaluate: Evaluate = by_rules, step: Callable[[str], None] = lambda name: None) -> dict:
    """Evaluate and consume the lines up to ``cutoff``.

    ``buffer``: a table partitioned by ``log_date``; ``findings``: a table for
    :func:`findings.append_new`; ``state``: a folder of this consumer alone. ``step`` is told
    ``advanced``, ``staged``, ``appended``, ``committed`` and ``dropped`` as the run gets there.
    Returns the number of findings stored by this run and whether an earlier run was finished first.
    """
    keys, finished = list(keys), False
    runs = _runs(spark, state)
    if runs and not _whole(spark, f"{_run(state, runs[-1])}/marks") and _whole(spark, f"{_run(state, runs[-1])}/staged"):
        _commit(spark, state, runs[-1], buffer, findings, keys, lambda name: None)
        finished = True
    lines = unconsumed(spark.read.parquet(buffer), marks(spark, state), keys, cutoff) if _days(spark, buffer) else None
    if lines is None or lines.isEmpty():
        return {"findings": 0, "finished_earlier": finished}
    n = runs[-1] + 1 if runs else 0
    run = _run(state, n)
    found, failed = evaluate(with_bounds(lines, keys), keys)
    sources = lines.select(*keys).distinct() if keys else spark.range(1).select()
    if failed is not None:
        if keys:
            f = failed.select(*[F.col(k).alias("_" + k) for k in keys]).distinct()
            sources = sources.join(f, on=[F.col(k).eqNullSafe(F.col("_" + k)) for k in keys], how="left_anti")
        elif not failed.isEmpty():
            sources = sources.limit(0)
    sources.withColumn("until", F.lit(cutoff).cast("timestamp")).write.mode("overwrite").parquet(f"{run}/advance")
    step("advanced")
    (found.withColumn("source_id", F.lit(state.rstrip("/").rsplit("/", 1)[-1])).withColumn("run", F.lit(n).cast("long"))
     .write.mode("overwrite").parquet(f"{run}/staged"))
    step("staged")
    stored = spark.read.parquet(f"{run}/staged").count()
    _commit(spark, state, n, buffer, findings, keys, step)
    return {"findings": stored, "finished_earlier": finished}


def drop_consumed(spark: SparkSession, buffer: str, state: str, keys: Sequence[str] = ()) -> list[str]:
    """Delete the days of ``buffer`` whose lines are all behind their sources' marks. Without keys these
    are the days before the mark's; with keys, a day is kept while a line of it is unconsumed
    (one scan of the days up to the last mark, ``ts`` and keys only). Returns the days deleted."""
    known = marks(spark, state)
    last = None if known is None else known.agg(F.max("until")).first()[0]
    if last is None:
        return []
    _, fs = _fs(spark, buffer)
    day = spark.range(1).select(F.to_date(F.lit(last)).cast("string")).first()[0]
    old = [(d, p) for d, p in _days(spark, buffer) if d < day]
    if keys and old:
        lines = spark.read.parquet(buffer).filter(F.col("log_date") < F.lit(day).cast("date"))
        needed = {str(r[0]) for r in unconsumed(lines, known, keys).select("log_date").distinct().collect()}
        old = [(d, p) for d, p in old if d not in needed]
    for _, p in old:
        fs.delete(p, True)
    return [d for d, _ in old]


def buffer_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Store parsed lines as a buffer: ranges of ``ts``, a folder per day."""
    FS.with_log_date(lines).repartitionByRange("ts").write.mode(mode).partitionBy("log_date").parquet(path)


def new_state(root: str) -> str:
    return f"{root}/{uuid.uuid4().hex}"
