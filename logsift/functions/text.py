"""Text helpers with Python ``str`` semantics, as native Column expressions.

Java regex with ``(?U)`` gives Unicode ``\\d``, ``\\w`` and ``\\b`` like
Python's ``re``; Python's whitespace additionally contains the four
separators U+001C..U+001F, so whitespace is spelled out as ``WS``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"        # Python str.isspace() under (?U)
NON_WS = r"[^\s\x1c-\x1f]"   # Python \S

# The characters ``str.isspace()`` accepts (the same set as ``WS``), built
# by that rule: U+0009..000D, U+001C..001F, space, U+0085, U+00A0, U+1680,
# U+2000..200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def py_strip(c: Column | str) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace.

    ``btrim`` with the whitespace set compares characters, no regex.
    """
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def truncate_with_marker(c: Column | str, max_chars: int, marker: str) -> Column:
    """Cut to ``max_chars`` code points and append ``marker`` after the cut.

    The result may be longer than ``max_chars`` (the marker is added after).
    """
    c = _col(c)
    return F.when(F.length(c) > max_chars,
                  F.concat(F.substring(c, 1, max_chars), F.lit(marker))).otherwise(c)


def local_ts(ts: Column | str, tz: str = "UTC") -> Column:
    """Wall clock of a UTC instant in ``tz`` (identity for UTC)."""
    ts = _col(ts)
    return ts if tz.upper() == "UTC" else F.from_utc_timestamp(ts, tz)


def local_label(ts: Column | str, fmt: str, tz: str = "UTC") -> Column:
    """Local day / minute labels: ``yyyy-MM-dd``, ``yyyy-MM-dd HH:mm``, ``MM-dd HH:mm``."""
    return F.date_format(local_ts(ts, tz), fmt)


def local_day(ts: Column | str, tz: str = "UTC") -> Column:
    return local_label(ts, "yyyy-MM-dd", tz)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
