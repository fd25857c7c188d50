"""First-sighting order ``(ts, id)`` as one comparable value.

``min(struct(ts, id))`` would be exact too, but a struct aggregation buffer
forces Spark onto sort-based aggregation. Packing ``(ts, id)`` into one
``decimal(38,0)`` (micros * 10^20 + id + 10^19; every long id fits in the
low 20 digits) keeps ``min`` a fixed-width hash-aggregation buffer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _shift() -> Column:
    return F.expr("CAST(100000000000000000000 AS DECIMAL(38,0))")   # 10^20


def _bias() -> Column:
    return F.expr("CAST(10000000000000000000 AS DECIMAL(38,0))")     # 10^19


def seen_key(ts: Column | str = "ts", id_: Column | str = "id") -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    id_ = F.col(id_) if isinstance(id_, str) else id_
    return F.unix_micros(ts).cast("decimal(38,0)") * _shift() + (id_.cast("decimal(38,0)") + _bias())


def key_ts(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.timestamp_micros(F.floor(key / _shift()).cast("long"))


def key_id(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return (F.pmod(key, _shift()) - _bias()).cast("long")
