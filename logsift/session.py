"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library depends on for correct results (UTC labels) and for
# scale (AQE re-plans joins and coalesces / splits skewed shuffle partitions).
_REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Post-shuffle stages here are CPU-heavy per byte (rule regexes, top-k,
    # text rendering over a few MB): coalesce to 64 KB partitions, not 1 MB,
    # so they keep their parallelism. Large shuffles are unaffected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def get_spark(master: str | None = None, app: str = "logsift",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's required settings.

    ``master`` is only for local runs and tests; on a cluster leave it unset
    and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_REQUIRED_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    # Checkpoints cut lineage once; drop their files when the DataFrame is gone.
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable required settings to an existing session."""
    for k, v in _REQUIRED_CONF.items():
        if spark.conf.isModifiable(k):  # a shared session's static settings stay
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and written tables.

    Taken from ``spark.checkpoint.dir`` (the cluster names a shared folder
    there). Where it is unset, a temporary folder is made for a local master,
    as in unit tests; on a cluster that would be a folder that other machines
    don't see, so it is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="logsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint root."""
    root = checkpoint_root(spark)
    return "/".join([root.rstrip("/"), "logsift", *parts])

