"""Severity levels: classes of lines and fields, counts, and the clauses that a count stands for."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import LEVEL_HEAD_BYTES, LEVEL_NAMES, LEVELS
from ..functions.text import LOWER, UPPER, bar_fraction
from .query import build_clause, same_query

#: What names a level, in order of precedence; a class may have several names.
WORDS = (("FATAL", ("FATAL",)), ("ERROR", ("ERROR",)), ("WARN", ("WARN",)), ("INFO", ("INFO",)), ("DEBUG", ("DEBUG", "TRACE")))


def _first(holds) -> Column:
    out = None
    for level, names in WORDS:
        here = reduce(lambda a, b: a | b, [holds(n) for n in names])
        out = F.when(here, level) if out is None else out.when(here, level)
    return out.otherwise("OTHER")


def line_level(line: Column) -> Column:
    """Level of a line by the words in its first bytes, capitals only.

    The head is cut in bytes and stays binary, since the cut may split a character.
    """
    head = F.substring(F.encode(line, "UTF-8"), 1, LEVEL_HEAD_BYTES)
    return _first(lambda n: F.coalesce(F.contains(head, F.lit(n).cast("binary")), F.lit(False)))


def field_level(token: Column) -> Column:
    """Level of a field by what its value begins with, in any case; a missing value is OTHER."""
    upper = F.translate(token, LOWER, UPPER)
    return _first(lambda n: F.coalesce(F.startswith(upper, F.lit(n)), F.lit(False)))


def find_level_column(columns: Iterable[str]) -> str | None:
    return next((c for c in columns if c.lower() in LEVEL_NAMES), None)


def level_clauses(column: str | None) -> dict[str, str | None]:
    """For each level the clause that selects the rows counted under it; none for classes of several names."""
    return {level: build_clause(column, "=*", level) if column and level in ("FATAL", "ERROR", "WARN", "INFO") else None for level in LEVELS}


def count_levels(df: DataFrame, level: Column, column: str | None = None) -> DataFrame:
    """All six levels: ord, level, n, bar_fraction, clause. Counts add up to the rows of ``df``."""
    flags = [F.count(F.when(F.col("_l") == name, 1)).alias(name) for name in LEVELS]
    clauses = level_clauses(column)
    one = df.select(level.alias("_l")).agg(*flags)
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("level"), F.col(n).alias("n"), F.lit(clauses[n]).cast("string").alias("clause")) for i, n in enumerate(LEVELS)])
    rows = one.select(F.inline(each), F.greatest(*LEVELS).alias("_top"))
    return rows.select("ord", "level", "n", bar_fraction(F.col("n"), F.col("_top")).alias("bar_fraction"), "clause")


def count_from(df: DataFrame, level: Column, from_line: int, column: str | None = None) -> DataFrame:
    return count_levels(df.filter(F.col("line_no") >= from_line), level, column)


def append_counts(old: dict[str, int], old_last: str | None, new: dict[str, int]) -> dict[str, int]:
    """Counts after lines were added: the old last line, which may have been completed, is counted anew in ``new``."""
    return {k: max(0, old.get(k, 0) - (k == old_last)) + new.get(k, 0) for k in LEVELS}


def active_level(query: str, column: str | None, columns: Iterable[str] = ()) -> str | None:
    """The level whose clause the query is."""
    columns = list(columns)
    return next((k for k, c in level_clauses(column).items() if c and same_query(query, c, columns)), None)


def line_colour(line: Column) -> Column:
    """Colour class of a whole line; INFO keeps the default."""
    level = line_level(line)
    return F.when(level.isin("FATAL", "ERROR"), "error").when(level == "WARN", "warn").when(level == "DEBUG", "trace").otherwise("default")


def status_class(value: Column) -> Column:
    digit = F.substring(value, 1, 1)
    return F.when(digit == "2", "ok").when(digit == "3", "info").when(digit == "4", "warn").when(digit == "5", "error").otherwise("default")


def cell_colour(name: str, value: Column) -> Column:
    """Colour class of a table cell."""
    if name in ("level", "severity"):
        has = lambda w: F.contains(value, F.lit(w))
        return F.when(has("FATAL") | has("ERROR"), "error").when(has("WARN"), "warn").when(has("INFO"), "info").when(has("DEBUG") | has("TRACE"), "trace").otherwise("default")
    if "status" in name or name == "code":
        return F.when(F.rlike(value, F.lit("^[0-9]")), status_class(value)).otherwise("default")
    return F.lit("default")
