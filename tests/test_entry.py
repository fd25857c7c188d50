"""Driver contract: entry() runs on sf0.001 with a stable schema; keys line up."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.schema.simpleString() == (
        "struct<period_start:timestamp_ntz,period_end:timestamp_ntz,total_lines:bigint,"
        "distinct_patterns:bigint,elevated_count:bigint,digest_text:string>")
    rows = df.collect()
    assert len(rows) > 0
    assert all(r["digest_text"].startswith("Total syslog lines this period: ") for r in rows)
    assert sum(r["total_lines"] for r in rows) == spark.read.parquet(f"{E.SF_SMOKE}/events.parquet").count()


def test_contract_keys():
    """Every query but those of the optional training-data operators has its SQL."""
    qs, sql = E.queries(), E.oracle_sql()
    own = {q for q in qs if q != "pipeline" and not (q.startswith("op") and q[2].isdigit())}
    assert len(own) == 75 and all(callable(f) for f in qs.values())
    assert set(sql) <= set(qs) and own <= set(sql)
