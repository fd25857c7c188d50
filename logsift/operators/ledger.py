"""A ledger of evaluated periods: what failed is tried again, what is done is left alone.

The ledger has a row per (keys, period) with ``state`` (``done``, ``pending`` or ``given_up``),
``attempts`` and ``last_error``. A run is due for the pending periods and for those that ended by its
cutoff and aren't in the ledger yet; only their lines are read on. Findings are appended first
and the ledger's next version is written after them, complete or not at all. A run that is lost in
between leaves its periods due; the append then finds their findings stored and keeps
them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import findings as FS
from .assess import assess_with
from .digest import build_digests, pkeys, with_period


def _versions(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and FS.path_exists(spark, f"{path}/{n}/_SUCCESS"))


def ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's last version; None before the first run."""
    have = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{have[-1]}") if have else None


def _same(columns: Sequence[str], prefix: str = "_"):
    return [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns]


def due(periods: DataFrame, known: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """Of ``periods`` (P), those that are new or pending, with their ``attempts`` so far."""
    P = pkeys(keys)
    if known is None:
        return periods.withColumn("attempts", F.lit(0))
    k = known.select(*[F.col(c).alias("_" + c) for c in P], "state", "attempts")
    return (periods.join(k, on=_same(P), how="left").filter(F.col("state").isNull() | (F.col("state") == "pending"))
            .select(*P, F.coalesce("attempts", F.lit(0)).alias("attempts")))


def run(lines: DataFrame, findings: str, path: str, assessor_factory: Callable, cutoff, keys: Sequence[str] = (), period: str = "60 minutes",
        max_attempts: int | None = None) -> DataFrame:
    """Evaluate the due periods of ``lines`` that ended by ``cutoff`` with a plug-in assessor, store their
    findings in ``findings`` and the ledger's next version in ``path``; returns that version. After
    ``max_attempts`` failures a period is given up (default: never)."""
    spark, keys = lines.sparkSession, list(keys)
    P, have = pkeys(keys), _versions(spark, path)
    known = ledger(spark, path)
    base = with_period(FS.logs_until(lines, cutoff), period).filter(F.col("period_end") <= F.lit(cutoff).cast("timestamp"))
    tried = due(base.select(*P).distinct(), known, keys).checkpoint(eager=True)
    mine = base.join(tried.select(*[F.col(c).alias("_" + c) for c in P]), on=_same(P), how="left_semi")
    answers = assess_with(build_digests(mine, keys), assessor_factory, keys).checkpoint(eager=True)  # one call a digest
    good, back = FS.findings_from_payloads(answers, keys)
    FS.append_new(good, findings, keys)
    failed = back.select(*[F.col(c).alias("_" + c) for c in P], F.col("error").alias("last_error"))
    n = F.col("attempts") + 1
    late = F.lit(False) if max_attempts is None else n >= max_attempts
    now = tried.join(failed, on=_same(P), how="left").select(
        *P, F.when(F.col("last_error").isNull(), "done").when(late, "given_up").otherwise("pending").alias("state"), n.alias("attempts"), "last_error")
    if known is not None:
        old = known.join(tried.select(*[F.col(c).alias("_" + c) for c in P]), on=_same(P), how="left_anti")
        now = now.unionByName(old.select(now.columns))
    now.write.mode("overwrite").parquet(f"{path}/v{have[-1] + 1 if have else 0}")
    return ledger(spark, path)
