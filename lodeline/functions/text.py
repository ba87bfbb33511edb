"""Text expressions: comparisons that fold ASCII letters only, display formats, keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z; other characters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def fold(value: str) -> str:
    """``ascii_lower`` of a Python string."""
    return value.translate(str.maketrans(UPPER, LOWER))


def equals_ci(c: Column, value: str) -> Column:
    return ascii_lower(c) == F.lit(fold(value))


def starts_ci(c: Column, value: str) -> Column:
    return F.startswith(ascii_lower(c), F.lit(fold(value)))


def contains_ci(c: Column, value: str) -> Column:
    return F.contains(ascii_lower(c), F.lit(fold(value))) if value else F.lit(True)


def is_numeric_text(c: Column) -> Column:
    """At least one digit, and nothing but digits, point, comma and minus."""
    return F.rlike(c, F.lit(r"\A[0-9.,\-]*[0-9][0-9.,\-]*\z"))


def format_number(x: Column) -> Column:
    """A dash for no value, no decimals for whole numbers under 1e15, else two."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).when(whole, F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.2f", x))


def bar_fraction(count: Column, top: Column) -> Column:
    """Length of a bar on a logarithmic scale: 0 for none, 1 for the top count."""
    return F.when(count == 0, F.lit(0.0)).when(count >= top, F.lit(1.0)).otherwise(F.log10(1 + count) / F.log10(1 + top))


def pack_key(src: Column, line: Column) -> Column:
    """Source and line in one number: 32 bits each."""
    return F.shiftleft(src.cast("long"), 32).bitwiseOR(line.cast("long"))


def unpack_src(key: Column) -> Column:
    return F.shiftrightunsigned(key, 32).cast("int")


def unpack_line(key: Column) -> Column:
    return key.bitwiseAND(F.lit(0xFFFFFFFF))


def trim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+\z", "")


def label_value(label: Column, value: Column) -> Column:
    return F.concat(label, F.lit(" = "), value)


CONNECTORS = "-_.:/@"


def char_class(ch: str) -> str:
    """space, word, cjk, connector or mark."""
    if ch.isspace():
        return "space"
    if any(lo <= ord(ch) <= hi for lo, hi in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xAC00, 0xD7AF))):
        return "cjk"
    if ch.isalnum():
        return "word"
    return "connector" if ch in CONNECTORS else "mark"


def word_at(text: str, at: int) -> tuple[int, int] | None:
    """The token around a place: CJK characters stand alone, connectors join words on both their sides."""
    if not 0 <= at < len(text):
        return None
    kind = char_class(text[at])
    if kind in ("cjk", "mark"):
        return at, at + 1
    if kind == "space":
        same = lambda i: char_class(text[i]) == "space"
    else:

        def same(i: int) -> bool:
            k = char_class(text[i])
            if k == "word":
                return True
            return k == "connector" and 0 < i < len(text) - 1 and char_class(text[i - 1]) == "word" == char_class(text[i + 1])

        if kind == "connector" and not same(at):
            return at, at + 1
    lo, hi = at, at + 1
    while lo > 0 and same(lo - 1):
        lo -= 1
    while hi < len(text) and same(hi):
        hi += 1
    return lo, hi


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def snap_json_string(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """The bounds of the JSON string literal's content that holds [lo, hi); escapes stay as they stand."""
    if not 0 <= lo < hi <= len(text):
        return None
    return next((m.span(1) for m in _LITERAL.finditer(text) if m.start(1) <= lo and hi <= m.end(1)), None)
