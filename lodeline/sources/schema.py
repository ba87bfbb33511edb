"""What a log is, from its first lines: JSON or plain, its columns, and how it tells time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..constants import DETECT_BYTES, DETECT_LINES, JSON_SHARE, LEAST_JSON_LINES, LEAST_SAMPLE_LINES, MAX_COLUMNS, SCHEMA_BYTES, SCHEMA_LINES, TS_NAMES, TS_SHARE
from ..functions import jsonx
from ..functions.timestamps import FORMATS, prefix_ms, value_ms
from ..operators.timeline import Rejected, Route


@dataclass(frozen=True)
class Column:
    name: str
    width_chars: int
    ordinal: int


def sample(lines: DataFrame | list[str], n: int, most_bytes: int) -> list[str]:
    """The first n lines, fewer where they are long, of numbered lines or of those that a file begins with."""
    first = lines[:n] if isinstance(lines, list) else [r.value for r in lines.filter(lines["line_no"] < n).orderBy("line_no").select("value").collect()]
    out, held = [], 0
    for x in first:
        held += len(x.encode("utf-8", "surrogatepass"))
        if held > most_bytes and len(out) >= LEAST_SAMPLE_LINES:
            break
        out.append(x)
    return out


def _object(line: str):
    try:
        value = jsonx.loads(line)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_json_lines(lines: DataFrame | list[str]) -> bool:
    """Nine in ten of the first lines that aren't blank are JSON objects; under three lines tell nothing."""
    seen = [x for x in sample(lines, DETECT_LINES, DETECT_BYTES) if x.strip()]
    return len(seen) >= LEAST_JSON_LINES and sum(_object(x) is not None for x in seen) >= JSON_SHARE * len(seen)


def discover_columns(lines: DataFrame | list[str]) -> list[Column]:
    """Top-level keys of the first lines as they first appear, with the widest value of each."""
    widths: dict[str, int] = {}
    for record in map(_object, sample(lines, SCHEMA_LINES, SCHEMA_BYTES)):
        for k, v in (record or {}).items():
            if k in widths or len(widths) < MAX_COLUMNS:
                widths[k] = max(widths.get(k, len(k)), len(jsonx.display(v)))
    return [Column(k, w, i) for i, (k, w) in enumerate(widths.items())]


def probe_route(path: str, lines: DataFrame | list[str], columns: list[str], spark: SparkSession | None = None) -> Route | Rejected:
    """How a source tells time: the first usual field that half of the first lines can be read by, or a format of their beginnings.

    Lines that begin with white space continue others and have no vote.
    """
    spark = spark or lines.sparkSession
    seen = [x for x in sample(lines, SCHEMA_LINES, SCHEMA_BYTES) if x.strip()]
    if len(seen) < LEAST_JSON_LINES:
        return Rejected(path, "too few lines")
    if columns:
        rows = spark.createDataFrame([(x,) for x in seen], "value string")
        named = [c for n in TS_NAMES for c in columns if c.lower() == n]
        for c in named:
            ok = rows.filter(value_ms(jsonx.native_field(rows["value"], [c])).isNotNull()).count()
            if ok >= TS_SHARE * len(seen):
                return Route(field=c)
        return Rejected(path, "no field holds a time" if named else "no field is named like a time")
    voting = [x for x in seen if not x[0].isspace()]
    rows = spark.createDataFrame([(x,) for x in voting], "value string") if voting else None
    for form in FORMATS:
        if voting and rows.filter(prefix_ms(rows["value"], form).isNotNull()).count() >= TS_SHARE * len(voting):
            return Route(form=form)
    return Rejected(path, "lines begin with no known time")
