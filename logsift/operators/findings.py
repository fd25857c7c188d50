"""Findings / weekly tables: JSON codec, validation, writes, reads, retention.

Tables are Parquet partitioned by ``period_date`` (the day of ``ts``), so
``ts`` predicates prune whole partitions and retention drops whole days.
Writes are idempotent per (keys, period_start, source): rows already stored
are removed with a left-anti join before an append, so a replayed batch never
stores a finding twice, another source's finding of the same period is kept, and
the day's other periods stay untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.severity import is_elevated
from ..sources.tables import materialize

# ── JSON codec ───────────────────────────────────────────────────────────────


def payload_to_json(payload: Column | str) -> Column:
    return F.to_json(F.col(payload) if isinstance(payload, str) else payload)


def _loose(dt: T.DataType) -> T.DataType:
    """Read every integer leaf as string, so "7" and 1.9 survive parsing."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_loose(dt.elementType))
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return T.StringType()
    return dt


def coerce_int(s: Column) -> Column:
    """Integer coercion of a JSON leaf read as text: ``"7"`` -> 7, ``1.9`` -> 1
    (truncation toward zero), booleans -> 0/1, null / empty / other -> 0."""
    t = F.trim(s)
    as_num = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                    t.try_cast("double"))
    as_int = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long"))
    truncated = F.when(F.abs(as_num) < 9.2e18, F.when(as_num >= 0, F.floor(as_num))
                       .otherwise(F.ceil(as_num))).cast("long")
    return F.coalesce(as_int, truncated, F.when(t == "true", 1).when(t == "false", 0), F.lit(0)).cast("long")


def payload_from_json(js: Column | str, schema: T.StructType = schemas.FINDING_PAYLOAD) -> Column:
    """Parse a payload JSON text into the typed struct (integers coerced)."""
    js = F.col(js) if isinstance(js, str) else js
    parsed = F.from_json(js, _loose(schema))
    return _cast_back(parsed, schema)


def _cast_back(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_cast_back(c[f.name], f.dataType).alias(f.name)
                                                for f in dt.fields]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: _cast_back(e, dt.elementType))
    if isinstance(dt, (T.LongType, T.IntegerType)):
        return F.when(c.isNotNull(), coerce_int(c)).cast(dt)
    return c


# ── validation ──────────────────────────────────────────────────────────────

# Contracts of the two payloads: a field holds one of a list of texts (a list), any
# text (str), an integer or its digits as text (int), a list of texts ([str]) or a list of
# objects ([{...}]). All fields are required, others are not allowed.
FINDING_CONTRACT = {
    "overall_status": schemas.FINDING_STATUSES, "summary": str,
    "findings": [{"severity": schemas.ISSUE_SEVERITIES, "category": str, "title": str, "detail": str, "evidence": str,
                  "occurrences": int, "recommendation": str}]}
WEEKLY_CONTRACT = {
    "period_status": schemas.PERIOD_STATUSES, "overall_assessment": str,
    "recurring_issues": [{"title": str, "category": str, "severity": schemas.ISSUE_SEVERITIES, "days_seen": int,
                          "frequency": str, "detail": str, "recommendation": str}],
    "trends": [{"title": str, "direction": schemas.TREND_DIRECTIONS, "detail": str}],
    "watchlist": [str]}


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _fits(v: Column, rule) -> Column:
    """Does a JSON value (variant, null if absent) fit a scalar rule?"""
    kind, text = F.schema_of_variant(v), _get(v, "string")
    if isinstance(rule, list):
        ok = (kind == "STRING") & text.isin(*rule)
    elif rule is int:
        ok = (kind == "BIGINT") | ((kind == "STRING") & text.rlike(r"^-?[0-9]+$"))
    else:
        ok = kind == "STRING"
    return F.coalesce(ok, F.lit(False))


def _keys(m: Column, names: list[str]) -> tuple[Column, Column]:
    """(a required key is missing, there is another key)."""
    want = F.array(*[F.lit(n) for n in names])
    return F.size(F.array_except(want, F.map_keys(m))) > 0, F.size(F.array_except(F.map_keys(m), want)) > 0


def validate_json(js: Column | str, contract: dict) -> Column:
    """Violations of a payload contract, as an array of messages; the text is parsed once."""
    js = F.col(js) if isinstance(js, str) else js
    objects = "map<string,variant>"

    def items(values: Column, name: str, rule) -> list[Column]:
        if not isinstance(rule, dict):
            return [F.when(F.exists(values, lambda v: ~_fits(v, rule)), F.lit(f"{name} item bad"))]
        maps = F.transform(values, lambda v: _get(v, objects))
        return [
            F.when(F.exists(maps, lambda m: m.isNull()), F.lit(f"{name} item not an object")),
            F.when(F.exists(maps, lambda m: _keys(m, list(rule))[0]), F.lit(f"{name} item missing key")),
            F.when(F.exists(maps, lambda m: _keys(m, list(rule))[1]), F.lit(f"{name} item unexpected key")),
            *[F.when(F.exists(maps, _item_breaks(f, r)), F.lit(f"{name} item bad {f}")) for f, r in rule.items()]]

    def check(m: Column) -> Column:
        out = [F.when(m.isNull(), F.lit("not a JSON object")),
               *[F.when(m.isNotNull() & ~F.map_contains_key(m, F.lit(k)), F.lit(f"missing {k}")) for k in contract],
               F.when(_keys(m, list(contract))[1], F.lit("unexpected key"))]
        for k, rule in contract.items():
            value = F.try_element_at(m, F.lit(k))
            if isinstance(rule, list) and not isinstance(rule[0], str):
                values = _get(value, "array<variant>")
                out += [F.when(F.map_contains_key(m, F.lit(k)) & values.isNull(), F.lit(f"{k} not an array")), *items(values, k, rule[0])]
            else:
                out.append(F.when(m.isNotNull() & ~_fits(value, rule), F.lit(f"bad {k}")))
        return F.array_compact(F.array(*out))

    # a one-element array: the lambda names the parsed object without parsing again
    return F.transform(F.array(_get(F.try_parse_json(js), objects)), lambda m: check(m))[0]


def _item_breaks(field: str, rule):
    return lambda m: m.isNotNull() & ~_fits(F.try_element_at(m, F.lit(field)), rule)


def validate_finding_json(js: Column | str) -> Column:
    """Violations of the finding payload contract."""
    return validate_json(js, FINDING_CONTRACT)


def validate_weekly_json(js: Column | str) -> Column:
    """Violations of the review payload contract."""
    return validate_json(js, WEEKLY_CONTRACT)


def split_valid(df: DataFrame, json_col: str = "payload_json"):
    """(valid rows with typed ``payload``, rejected rows with ``violations``)."""
    v = df.withColumn("violations", validate_finding_json(json_col))
    good = v.filter(F.size("violations") == 0).withColumn("payload", payload_from_json(json_col))
    bad = v.filter(F.size("violations") > 0)
    return good.drop("violations"), bad


def findings_from_payloads(assessed: DataFrame, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Plug-in results (:func:`assess.assess_with`) to ``(findings, kept back)``.

    A finding takes ``overall_status`` and ``summary`` from its payload (missing:
    ``ok`` and an empty text) and ``log_count`` from the digest's lines. Rows whose
    assessment failed, or whose payload is no JSON object or breaks the contract in
    anything but those two fields, are kept back with their ``error``, so that the caller
    leaves their input for the next run.
    """
    violations = validate_finding_json("payload_json")
    defaulted = ["missing overall_status", "missing summary"]
    bad_default = [F.when(F.array_contains("_v", m), F.lit("bad " + m.split()[1])) for m in defaulted]
    broken = F.array_except("_v", F.array_compact(F.array(*[F.lit(m) for m in defaulted], *bad_default)))
    v = assessed.withColumn("_v", violations).withColumn("_broken", broken)
    ok = F.col("error").isNull() & (F.size("_broken") == 0)
    good = v.filter(ok).withColumn("payload", payload_from_json("payload_json"))
    status = F.coalesce("payload.overall_status", F.lit("ok"))
    summary = F.coalesce("payload.summary", F.lit(""))
    stored = good.select(*keys, "period_start", F.col("period_end").alias("ts"), status.alias("overall_status"), summary.alias("summary"),
                         F.col("total_lines").cast("long").alias("log_count"),
                         F.struct(status.alias("overall_status"), summary.alias("summary"), F.col("payload.findings").alias("findings")).alias("payload"))
    back = v.filter(~ok).withColumn("error", F.coalesce("error", F.concat(F.lit("payload: "), F.array_join("_broken", "; "))))
    return stored, back.drop("_v", "_broken")


# ── writes ──────────────────────────────────────────────────────────────────

def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: Sequence[str] = (),
               period_col: str = "period_start", source: Sequence[str] = ()) -> DataFrame:
    """Append rows whose (keys, period, source) is not stored yet; returns the rows written.

    ``source`` names columns that tell sources of one period apart (e.g. a stream's
    query id and batch id). A stored table without them counts as null there. The rows are
    computed once, into a staging table; only the stored days they fall on are read
    (``period_date`` is the partition column).
    """
    spark = df.sparkSession
    key_cols = [*keys, period_col, *source, "period_date"]
    staged = materialize(df.withColumn("period_date", F.to_date("ts")), "staged")
    if staged.isEmpty():  # a partitioned write of no rows leaves a folder without a schema
        return staged
    out = staged
    if path_exists(spark, path):
        days = [r[0] for r in staged.select("period_date").distinct().collect()]
        stored = spark.read.parquet(path).filter(F.col("period_date").isin(days) if days else F.lit(False))
        stored = stored.select(*[(F.col(c) if c in stored.columns else F.lit(None)).alias("_" + c) for c in key_cols]).distinct()
        same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in key_cols]
        out = staged.join(stored, on=same, how="left_anti")
    out.write.mode("append").option("mergeSchema", "true").partitionBy("period_date").parquet(path)
    return out


# ── reads (K4, K5, K8, F3, F5) ───────────────────────────────────────────────

def with_log_date(lines: DataFrame) -> DataFrame:
    """Add the ``log_date`` partition column (UTC day of ``ts``) for writing raw_logs."""
    return lines.withColumn("log_date", F.to_date("ts"))


def _day_bounds(lines: DataFrame, lo=None, hi=None) -> DataFrame:
    """Partition predicates on ``log_date`` matching a ``ts`` range, when partitioned."""
    if "log_date" not in lines.columns:
        return lines
    if lo is not None:
        lines = lines.filter(F.col("log_date") >= F.to_date(F.lit(lo).cast("timestamp")))
    if hi is not None:
        lines = lines.filter(F.col("log_date") <= F.to_date(F.lit(hi).cast("timestamp")))
    return lines


def logs_until(lines: DataFrame, cutoff, ordered: bool = False) -> DataFrame:
    """raw_logs rows with ``ts <= cutoff`` (the batch to evaluate), on demand in (ts, id) order.

    No evaluation needs the order: first sightings compare (ts, id) themselves.

    On a ``log_date``-partitioned table the day bound prunes partitions; the
    ``ts`` bound is pushed into the Parquet scan.
    """
    c = F.lit(cutoff).cast("timestamp")
    out = _day_bounds(lines, hi=cutoff).filter(F.col("ts") <= c)
    return out.orderBy("ts", "id") if ordered else out


def lines_between(lines: DataFrame, start, end) -> DataFrame:
    """raw_logs rows with ``start <= ts < end`` (one evaluation period), partition-pruned."""
    s, e = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return _day_bounds(lines, lo=start, hi=end).filter((F.col("ts") >= s) & (F.col("ts") < e))


def elevated(lines: DataFrame) -> DataFrame:
    return lines.filter(is_elevated("severity"))


def _ties(df: DataFrame) -> list[Column]:
    """Order among rows of one ``ts``: ids and periods, then a hash of the other columns."""
    known = [c for c in ("id", "period_start", "batch_id") if c in df.columns]
    rest = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith("map")]
    return [*[F.col(c) for c in known], F.xxhash64(*rest)]


def since(df: DataFrame, since_ts) -> DataFrame:
    """Rows with ``ts >= since`` oldest first. On a stored table the day bound prunes partitions."""
    if "period_date" in df.columns:
        df = df.filter(F.col("period_date") >= F.to_date(F.lit(since_ts).cast("timestamp")))
    return df.filter(F.col("ts") >= F.lit(since_ts).cast("timestamp")).orderBy("ts", *_ties(df))


def latest(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Newest row overall (``keys=[]``) or per key; empty input -> no row."""
    if not keys:
        return history(df, 1)
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct("ts", *_ties(df)))
                                  .alias("_r")).select(*keys, "_r.*"))


def history(df: DataFrame, limit: int = 200) -> DataFrame:
    """Newest first (ties: larger id, later period); a negative limit means no limit."""
    out = df.orderBy(F.desc("ts"), *[c.desc() for c in _ties(df)])
    return out if limit is None or limit < 0 else out.limit(limit)


# ── retention (F6) ──────────────────────────────────────────────────────────

def retention_cutoff(now, days: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(-days * 86400), F.lit(now).cast("timestamp"))


def retention_keep(df: DataFrame, now, days: int = 30) -> DataFrame:
    """Rows kept by a purge at ``now``: ``ts >= now - days*86400 s`` (boundary kept)."""
    return df.filter(F.col("ts") >= retention_cutoff(now, days))


def retention_counts(df: DataFrame, now, days: int = 30) -> DataFrame:
    """One row: kept and removed counts of a purge at ``now``."""
    keep = F.col("ts") >= retention_cutoff(now, days)
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("removed"))


def purge(spark: SparkSession, path: str, now, days: int = 30) -> dict:
    """Retention purge of a table partitioned by ``period_date``.

    Partitions of days before the cutoff day are deleted whole; only the
    cutoff day itself is rewritten with the keep-filter (dynamic partition
    overwrite touches that one partition). Returns kept / removed counts.
    """
    df = spark.read.parquet(path)
    counts = retention_counts(df, now, days).first().asDict()
    if not counts["removed"]:
        return counts
    cutoff = spark.range(1).select(retention_cutoff(now, days).alias("c")).first()["c"]
    cutoff_day = cutoff.date()
    boundary = (df.filter((F.col("period_date") == F.lit(cutoff_day)) & (F.col("ts") >= F.lit(cutoff)))
                .checkpoint(eager=True))  # cut the read of the partition being replaced
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("period_date="):
            day = name.split("=", 1)[1]
            if day < cutoff_day.isoformat() or (day == cutoff_day.isoformat() and boundary.isEmpty()):
                fs.delete(st.getPath(), True)
    if not boundary.isEmpty():
        (boundary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("period_date").parquet(path))
    return counts


# ── monitoring (A10, A11) ───────────────────────────────────────────────────

def monitor_snapshot(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: buffered_logs, findings_stored, last_evaluation_ts (null if none)."""
    a = lines.select(F.lit(1).alias("_log"), F.lit(0).alias("_finding"),
                     F.lit(None).cast("timestamp").alias("_ts"))
    b = findings.select(F.lit(0).alias("_log"), F.lit(1).alias("_finding"), F.col("ts").alias("_ts"))
    return a.unionByName(b).agg(F.sum("_log").cast("long").alias("buffered_logs"),
                                F.sum("_finding").cast("long").alias("findings_stored"),
                                F.max("_ts").alias("last_evaluation_ts"))
