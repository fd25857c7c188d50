"""Syslog / CEF line framing and parsing as native Column expressions.

A line is parsed into ``(host, facility, severity, message)``:

* an optional ``<PRI>`` prefix (1-3 digits) gives facility = PRI div 8 and
  severity = PRI mod 8;
* then an RFC 5424 header ``1 TIMESTAMP HOST rest`` (tried first) or an
  RFC 3164 header ``Mmm d HH:MM:SS HOST rest`` is removed and its host kept;
  the timestamps in the headers are matched but not kept (``ts`` is the
  receive time);
* a CEF payload anywhere in the body overrides the severity with its own
  Severity field (7th ``|`` field): >=9 -> 2, >=7 -> 3, >=4 -> 4, else 6;
* host ``-`` or empty becomes null; lines whose message is empty are dropped.

Everything is a ``regexp_*`` / ``split`` / ``when`` expression, so the
parse stays inside whole-stage codegen and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NON_WS, WS, py_strip

# The header grammars. The RFC 5424 and RFC 3164 prefixes
# start with different characters ("1" / an upper-case letter), so one
# alternation tried in that order equals "5424 first, else 3164"; host is
# group 1 and the rest group 2 either way.
_PRI_RE = r"(?s)^<([0-9]{1,3})>"
_HEADER_RE = (
    r"(?sU)^(?:1" + WS + r"+" + NON_WS + r"+"
    r"|[A-Z][a-z]{2}" + WS + r"+\d{1,2}" + WS + r"+\d{2}:\d{2}:\d{2})"
    + WS + r"+(" + NON_WS + r"+)" + WS + r"+(.*)$"
)
_CEF_RE = r"(?U)CEF:\d+\|"
# A plain decimal / exponent number, the forms a CEF severity takes.
_NUMBER_RE = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# A line whose message would be empty: blank, or a bare <PRI>.
_EMPTY_MESSAGE_RE = r"(?sU)^" + WS + r"*(?:<[0-9]{1,3}>" + WS + r"*)?$"


def decode_utf8(payload: Column | str) -> Column:
    """Lossy UTF-8 decode of a binary payload (bad bytes -> U+FFFD)."""
    c = F.col(payload) if isinstance(payload, str) else payload
    return F.make_valid_utf8(c.cast("string"))


def frame_lines(df: DataFrame, text_col: str, keep: list[str] | None = None,
                line_col: str = "line", pos_col: str | None = "pos") -> DataFrame:
    """Split a text payload into lines: ``\\r`` counts as ``\\n``; blank pieces go.

    Pieces are kept unstripped (parsing strips them); ``pos`` is the index of
    the piece in its payload, a stable tie order for lines of one payload.
    """
    keep = list(keep or [])
    pieces = F.split(F.translate(F.col(text_col), "\r", "\n"), "\n", -1)
    if pos_col:
        out = df.select(*keep, F.posexplode(pieces).alias(pos_col, line_col))
    else:
        out = df.select(*keep, F.explode(pieces).alias(line_col))
    return out.filter(F.length(py_strip(F.col(line_col))) > 0)


def _cef_field(msg: Column) -> Column:
    """Stripped 7th ``|`` field after the first ``CEF:``; null unless the message is CEF.

    ``instr`` is a cheap gate in front of the regex; the split only runs for
    CEF lines (a CASE branch is evaluated lazily).
    """
    is_cef = (F.instr(msg, "CEF:") > 0) & msg.rlike(_CEF_RE)
    cef = msg.substr(F.instr(msg, "CEF:"), F.lit(2 ** 31 - 1))
    return F.when(is_cef, py_strip(F.get(F.split(cef, r"\|", -1), 6)))


def _cef_value(field: Column) -> Column:
    """The field as a finite double when it is a plain number, else null."""
    return F.when(field.rlike(_NUMBER_RE), field.try_cast("double"))


def _cef_ladder(value: Column) -> Column:
    # inf / 1e999 cannot be truncated to an int: treated as "no severity".
    return (F.when(F.abs(value) < F.lit(float("inf")),
                   F.when(value >= 9, 2).when(value >= 7, 3).when(value >= 4, 4).otherwise(6))
            .cast("int"))


def cef_severity(message: Column | str) -> Column:
    """Syslog severity from a CEF Severity field, or null when there is none."""
    msg = F.col(message) if isinstance(message, str) else message
    return _cef_ladder(_cef_value(_cef_field(msg)))


def _pri_stage(line: Column):
    """(pri digits or "", body after the PRI, stripped)."""
    digits = F.regexp_extract(line, _PRI_RE, 1)
    body0 = F.when(digits != "", py_strip(F.substring(line, F.length(digits) + 3, 2 ** 31 - 1))) \
             .otherwise(line)
    return digits, body0


def _header_stage(body0: Column):
    """(host or "", message) after removing an RFC 5424 / 3164 header."""
    host = F.regexp_extract(body0, _HEADER_RE, 1)
    message = F.when(host != "", py_strip(F.regexp_extract(body0, _HEADER_RE, 2))).otherwise(body0)
    return host, message


def _finish(digits: Column, host: Column, message: Column, cef_sev: Column | None = None) -> list[Column]:
    pri = F.when(digits != "", digits.cast("int"))
    cef_sev = cef_severity(message) if cef_sev is None else cef_sev
    return [
        F.when(~host.isin("-", ""), host).alias("host"),
        F.shiftright(pri, 3).alias("facility"),
        F.coalesce(cef_sev, F.pmod(pri, F.lit(8))).cast("int").alias("severity"),
        message.alias("message"),
    ]


def parse_line(raw: Column | str) -> Column:
    """One struct ``(host, facility, severity, message)`` per raw line.

    Single-expression form; :func:`parse_lines` evaluates the same stages as
    separate projections so no regex is evaluated twice.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    digits, body0 = _pri_stage(py_strip(raw))
    host, message = _header_stage(body0)
    return F.struct(*_finish(digits, host, message))


def header_kind(body: Column | str) -> Column:
    """``rfc5424``, ``rfc3164`` or null for a body after the PRI prefix."""
    body = F.col(body) if isinstance(body, str) else body
    host = F.regexp_extract(body, _HEADER_RE, 1)
    return F.when(host != "", F.when(body.startswith("1"), F.lit("rfc5424")).otherwise(F.lit("rfc3164")))


def pri_parts(raw: Column | str) -> Column:
    """``(pri, facility, severity, body)`` of the optional ``<PRI>`` prefix."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    digits, body0 = _pri_stage(py_strip(raw))
    pri = F.when(digits != "", digits.cast("int"))
    return F.struct(pri.alias("pri"), F.shiftright(pri, 3).alias("facility"),
                    F.pmod(pri, F.lit(8)).alias("severity"), body0.alias("body"))


def has_message(raw: Column | str) -> Column:
    """True when ``parse_line(raw).message`` is non-empty.

    Decided on the raw line with one anchored regex, so that filtering does
    not evaluate (and, after predicate pushdown, duplicate) the parse itself.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    return raw.isNotNull() & ~raw.rlike(_EMPTY_MESSAGE_RE)


def parse_lines(df: DataFrame, raw_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """raw lines -> raw_logs rows ``(*keep, host, facility, severity, message)``.

    Staged projections (strip + PRI, header, CEF field, CEF number, finish):
    each stage's outputs are referenced several times by the next, so
    Catalyst keeps the stages apart instead of inlining (and re-evaluating)
    the regexes, and the CEF work runs only for lines that contain ``CEF:``.
    """
    keep = list(keep if keep is not None else [c for c in df.columns if c != raw_col])
    s1 = df.filter(has_message(raw_col)).select(*keep, py_strip(raw_col).alias("_line"))
    digits, body0 = _pri_stage(F.col("_line"))
    s2 = s1.select(*keep, digits.alias("_digits"), body0.alias("_body0"))
    host, message = _header_stage(F.col("_body0"))
    s3 = s2.select(*keep, "_digits", host.alias("_host"), message.alias("_message"))
    s4 = s3.select(*keep, "_digits", "_host", "_message", _cef_field(F.col("_message")).alias("_cef"))
    s5 = s4.select(*keep, "_digits", "_host", "_message", _cef_value(F.col("_cef")).alias("_cef_v"))
    return s5.select(*keep, *_finish(F.col("_digits"), F.col("_host"), F.col("_message"),
                                     _cef_ladder(F.col("_cef_v"))))
