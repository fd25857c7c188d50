"""Template mining: mask volatile tokens so identical structures collapse.

The masks run in order (order matters: MAC and IPv6 before IPv4, timestamps
before bare numbers), then whitespace runs collapse to one space and the
ends are stripped. Each mask runs only on texts that hold a byte it needs, all JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WS, WS

# Volatile-token patterns (Python ``re`` syntax) and their
# replacements, in the order they are applied.
MASKS = [
    (r"\b[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}\b", "<MAC>"),
    (r"\b(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}\b", "<IPV6>"),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<IP>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*", "<TS>"),
    (r"\b\d{2}:\d{2}:\d{2}\b", "<TIME>"),
    (r"\b0x[0-9A-Fa-f]+\b", "<HEX>"),
    (r"\b[0-9A-Fa-f]{12,}\b", "<HEX>"),
    (r"\b\d+\b", "<N>"),
]


# Python's ``\w`` for str patterns is exactly: Unicode letters, numbers, "_"
# (Java's ``(?U)\w`` differs: it adds combining marks and drops No, e.g. "²").
# U+10000 is a letter, so it adds nothing; written out, it makes Java step back
# over whole characters in a lookbehind, also over those above U+FFFF.
PY_WORD = "[\\p{L}\\p{N}_\U00010000]"


def java_mask(pattern: str) -> str:
    r"""Python-``re`` semantics of a mask on Java regex.

    ``\b`` occurs only at the start of a mask (before a word character) and at
    its end (after one), where it is exactly "no word character before" and "no
    word character after". The first character is tested before the boundary,
    which most places fail sooner. ``(?U)`` makes ``\d`` Unicode decimal digits;
    ``\S`` excludes Python's whitespace.
    """
    p = pattern
    if p.startswith(r"\b"):
        p = p[2:]
        first = r"\d" if p.startswith(r"\d") else "[0-9A-Fa-f]"
        p = f"(?={first})(?<!{PY_WORD})" + p
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?!{PY_WORD})"
    assert r"\b" not in p, pattern
    return "(?U)" + p.replace(r"\S", NON_WS)


def _may_match(pattern: str, text: Column) -> Column | None:
    """A cheap test that every text with a match passes; null: any text."""
    if "0x" in pattern:
        return text.contains("0x")
    if "{12,}" in pattern:
        return F.length(text) >= 12
    if ":" in pattern.replace("(?:", ""):
        return text.contains(":")
    if r"\." in pattern:
        return text.contains(".")
    return None


_WS_RUN = "(?U)" + WS + "+"


def templatize(message: Column | str) -> Column:
    """Masked, whitespace-normalised template of a message."""
    # a one-element array: the lambdas name each step's text without repeating its expression
    out = F.array(F.col(message) if isinstance(message, str) else message)
    for pattern, repl in MASKS:
        def mask(x: Column, pattern: str = pattern, repl: str = repl) -> Column:
            masked, gate = F.regexp_replace(x, java_mask(pattern), repl), _may_match(pattern, x)
            return masked if gate is None else F.when(gate, masked).otherwise(x)
        out = F.transform(out, _unary(mask))
    # After the collapse every whitespace run is one ASCII space, so trim()
    # (spaces only) strips exactly what str.strip() would.
    return F.trim(F.regexp_replace(out[0], _WS_RUN, " "))


def _unary(f):
    """A lambda of one argument (a second one would be the position)."""
    return lambda x: f(x)
