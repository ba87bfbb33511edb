"""The filter language: ``field op value`` tokens and bare words, all of which must hold.

A query is parsed to clauses on the driver and compiled to one Column, so that Catalyst sees an ordinary predicate.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.text import contains_ci, equals_ci, starts_ci

EQ, PREFIX, GT, GE, LT, LE = "=", "=*", ">", ">=", "<", "<="
_OPERATOR = re.compile(r">=|<=|>|<|=")
#: A JSON number, which is stricter than what a cast takes.
MAX_DOUBLE = sys.float_info.max
_NUMBER = r"^\s*-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


_PARSED = "_parsed_fields"


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    op: str
    value: str


@dataclass(frozen=True)
class Bare:
    value: str


Clause = Field | Bare


def parse_token(token: str) -> Clause:
    m = _OPERATOR.search(token)
    if m is None or m.start() == 0:
        return Bare(token)
    op, value = m[0], token[m.end() :]
    if op == EQ and value.endswith("*"):
        op, value = PREFIX, value[:-1]
    return Field(tuple(token[: m.start()].split(".")), op, value)


def parse_query(text: str) -> list[Clause]:
    return [parse_token(t) for t in text.split()]


def normalise(clauses: Iterable[Clause], columns: Iterable[str]) -> list[Clause]:
    """Gives top-level fields the case of the first column that they name; others stay."""
    names = list(columns)

    def one(c: Clause) -> Clause:
        if isinstance(c, Bare) or len(c.path) != 1:
            return c
        found = next((n for n in names if n.lower() == c.path[0].lower()), c.path[0])
        return Field((found,), c.op, c.value)

    return [one(c) for c in clauses]


def refusal(field: str, op: str, value: str) -> str | None:
    """Why a clause can't be written so that it reads back as itself; None if it can."""
    if not field or re.search(r"[\s=<>.]", field):
        return "the field is empty or has a space or one of . = < >"
    if op == EQ and value.endswith("*"):
        return "an exact value can't end with *; use a prefix"
    if op == PREFIX and "*" in value:
        return "a prefix can't hold *"
    if not value or re.search(r"[\s<>]", value) or value.startswith("="):
        return "the value is empty, has a space, < or >, or begins with ="
    return None


def build_clause(field: str, op: str, value: str) -> str | None:
    if refusal(field, op, value) is not None:
        return None
    return f"{field}={value}*" if op == PREFIX else f"{field}{op}{value}"


def append_clause(query: str, clause: str) -> str:
    return f"{query.strip()} {clause}".strip()


def toggle(query: str, clause: str, columns: Iterable[str] = ()) -> str:
    """The clause alone, or no query if it is what the query says already."""
    columns = list(columns)
    return "" if same_query(query, clause, columns) else clause


def same_query(a: str, b: str, columns: Iterable[str] = ()) -> bool:
    columns = list(columns)
    return set(normalise(parse_query(a), columns)) == set(normalise(parse_query(b), columns))


def compare(text: Column, op: str, value: str) -> Column:
    """A clause's comparison with a value's text; null compares as false."""
    if op == EQ:
        out = equals_ci(text, value)
    elif op == PREFIX:
        out = starts_ci(text, value)
    else:
        if not re.match(_NUMBER, value):
            return F.lit(False)
        x = F.when(F.rlike(text, F.lit(_NUMBER)), F.trim(text)).try_cast("double")
        y = F.lit(float(value))
        out = {GT: x > y, GE: x >= y, LT: x < y, LE: x <= y}[op]
    return F.coalesce(out, F.lit(False))


def compare_typed(c: Column, kind: str, op: str, value: str) -> Column | None:
    """``compare`` for a column of numbers in its own type, so that it reaches the scan; None where the text has to be looked at."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    if op == EQ:
        if not whole:
            return None
        same = re.match(r"(?:0|-?[1-9]\d{0,17})\Z", value)  # the text of a whole number has one form
        return c.isNotNull() & (c == F.lit(int(value))) if same else F.lit(False)
    if op == PREFIX or not (whole or kind in ("float", "double")):
        return None
    if not re.match(_NUMBER, value):
        return F.lit(False)
    y = float(value)
    if whole:
        if not abs(y) < 1 << 53:
            return None
        low, high = F.lit(math.floor(y)), F.lit(math.ceil(y))
        return c.isNotNull() & {GT: c > low, GE: c >= high, LT: c < high, LE: c <= low}[op]
    if kind == "float" or math.isinf(y):
        return None
    finite = (c >= F.lit(-MAX_DOUBLE)) & (c <= F.lit(MAX_DOUBLE))  # what isn't a number has no such text
    return c.isNotNull() & {GT: c > y, GE: c >= y, LT: c < y, LE: c <= y}[op] & finite


def json_fields(line: Column, exact: bool = True) -> Callable[[tuple[str, ...]], Column]:
    """How a path is read from a JSON line: by the strict parser or by Spark's own."""

    def read(path: tuple[str, ...]) -> Column:
        return jsonx.exact_field(line, list(path))["text"] if exact else jsonx.native_field(line, list(path))

    return read


def table_fields(df: DataFrame) -> Callable[[tuple[str, ...]], Column]:
    """Paths are columns of ``df``; an unknown one is null. ``read.typed`` compares columns of numbers as such."""
    kinds = dict(df.dtypes)

    def typed(path: tuple[str, ...], op: str, value: str) -> Column | None:
        return compare_typed(F.col(f"`{path[0]}`"), kinds[path[0]], op, value) if len(path) == 1 and path[0] in kinds else None

    def read(path: tuple[str, ...]) -> Column:
        known = {c: F.col(f"`{c}`") for c in df.columns}
        if path[0] not in known:
            return F.lit(None).cast("string")
        c = known[path[0]]
        return (jsonx.native_field(c, list(path[1:])) if len(path) > 1 else c).cast("string")

    read.typed = typed
    return read


def compile_clause(clause: Clause, line: Column, read: Callable[[tuple[str, ...]], Column]) -> Column:
    if isinstance(clause, Bare):
        return F.coalesce(contains_ci(line, clause.value), F.lit(False))
    typed = getattr(read, "typed", lambda *_: None)(clause.path, clause.op, clause.value)
    return compare(read(clause.path), clause.op, clause.value) if typed is None else typed


def compile_query(clauses: Iterable[Clause], line: Column, read: Callable[[tuple[str, ...]], Column]) -> Column:
    return reduce(lambda a, b: a & b, [compile_clause(c, line, read) for c in clauses], F.lit(True))


def run_filter(lines: DataFrame, text: str, columns: Iterable[str] = (), *, line: str = "value", exact: bool = True, from_line: int = 0) -> DataFrame:
    """The rows of ``lines`` that a query holds for, from a line on.

    Lines without the innermost key of a clause can't match it, so a literal test drops them before
    any parsing; bare words, which need none, are tested first as well.
    """
    clauses = normalise(parse_query(text), columns)
    out = lines.filter(F.col("line_no") >= from_line) if from_line else lines
    cheap = [c for c in clauses if isinstance(c, Bare)]
    dear = [c for c in clauses if isinstance(c, Field)]
    value = F.col(line)
    out = out.filter(compile_query(cheap, value, json_fields(value))) if cheap else out
    for c in dear:
        # A key may be written with escapes, so only lines without any are dropped by it.
        out = out.filter(F.contains(value, F.lit(f'"{c.path[-1]}"')) | F.contains(value, F.lit("\\")))
    if not dear:
        return out
    if not exact:
        return out.filter(compile_query(dear, value, json_fields(value, False)))
    # All clauses read one parse of the line.
    paths = list(dict.fromkeys(c.path for c in dear))
    parsed = out.withColumn(_PARSED, jsonx.exact_texts(value, [list(p) for p in paths]))
    return parsed.filter(compile_query(dear, value, lambda path: F.get(F.col(_PARSED), F.lit(paths.index(path))))).drop(_PARSED)


def retract_hits(hits: DataFrame, from_line: int) -> DataFrame:
    """Hits before a line: those from it on are found anew when lines there have changed."""
    return hits.filter(F.col("line_no") < from_line)


def renew_hits(hits: DataFrame, lines: DataFrame, text: str, from_line: int, columns: Iterable[str] = (), *, line: str = "value", exact: bool = True) -> DataFrame:
    """Hits of a filter after lines from ``from_line`` on were appended or rewritten; only those lines are looked at."""
    return retract_hits(hits, from_line).unionByName(run_filter(lines, text, columns, line=line, exact=exact, from_line=from_line).select(hits.columns))
