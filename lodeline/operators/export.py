"""Exports: raw bytes, spreadsheet-safe CSV, pretty JSON; written whole or not at all.

Rows are rendered by executors as one column and streamed in order to one file by the driver, a partition at a
time, since the formats are single files.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx

UTF8_BOM = b"\xef\xbb\xbf"
EOL_SAMPLE = 8


class ExportRefused(RuntimeError):
    """The set to export isn't known in full."""


def detect_eol(data: bytes) -> bytes:
    """The more frequent ending of the first lines; line feeds in a tie."""
    ended = data.split(b"\n", EOL_SAMPLE)[:-1]
    windows = [x.endswith(b"\r") for x in ended]
    return b"\r\n" if 2 * sum(windows) > len(windows) else b"\n"


def neutralised(cell: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; signed numbers stay."""
    number = F.rlike(cell, F.lit(r"\A[+-](?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity|nan))\z"))
    return F.when(F.rlike(cell, F.lit("\\A[=@\t\r]")) | (F.rlike(cell, F.lit(r"\A[+-]")) & ~number), F.concat(F.lit("'"), cell)).otherwise(cell)


def csv_cell(cell: Column) -> Column:
    """Quoted only where needed."""
    return F.when(F.rlike(cell, F.lit('[,"\n\r]')), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(neutralised(F.coalesce(c, F.lit("")))) for c in cells])


def csv_rows(lines: DataFrame, columns: list[str], *, line: str = "value") -> DataFrame:
    """Lines with csv_line and ok; what is no JSON stands whole in the first cell."""
    keys = [c for c in ("src", "line_no") if c in lines.columns]
    parsed = lines.select(*keys, F.col(line).alias("_l"), jsonx.parse_line(F.col(line)).alias("_p"))
    cells = csv_line([jsonx.field_of(F.col("_p"), c) for c in columns])
    bad = F.concat(csv_cell(F.col("_l")), F.lit("," * max(0, len(columns) - 1)))
    return parsed.select(*keys, F.when(F.col("_p.ok"), cells).otherwise(bad).alias("csv_line"), F.col("_p.ok").alias("ok"))


def pretty_rows(lines: DataFrame, *, line: str = "value") -> DataFrame:
    keys = [c for c in ("src", "line_no") if c in lines.columns]
    return lines.select(*keys, jsonx.pretty_line(F.col(line)).alias("_x")).select(*keys, F.col("_x.text").alias("text"), F.col("_x.ok").alias("ok"))


def atomic_write(path: str | Path, chunks: Iterator[bytes], cancelled: Callable[[], bool] = lambda: False) -> int | None:
    """Writes <name>.partial and renames it; removes it on failure or cancel (None). Gives the number of chunks."""
    path = Path(path)
    part = path.with_name(path.name + ".partial")
    n = 0
    try:
        with part.open("wb") as f:
            for chunk in chunks:
                if cancelled():
                    break
                f.write(chunk)
                n += 1
            else:
                f.flush()
                os.fsync(f.fileno())
        if cancelled():
            part.unlink()
            return None
        os.replace(part, path)
    except BaseException:
        part.unlink(missing_ok=True)
        raise
    return n


def _ordered(rows: DataFrame) -> Iterator:
    return rows.orderBy(*[c for c in ("src", "line_no") if c in rows.columns]).toLocalIterator(prefetchPartitions=True)


def export_full(source: str | Path, path: str | Path) -> None:
    """A byte-for-byte copy."""
    part = Path(str(path) + ".partial")
    try:
        shutil.copyfile(source, part)
        os.replace(part, path)
    except BaseException:
        part.unlink(missing_ok=True)
        raise


def export_raw(raw: DataFrame, source: str | Path, path: str | Path, cancelled: Callable[[], bool] = lambda: False) -> int | None:
    """Chosen lines (line_no, raw) with the file's line end and mark; a last line without an end gets none."""
    with open(source, "rb") as f:
        head = f.read(1 << 20)
        f.seek(0, os.SEEK_END)
        ended = True
        if f.tell():
            f.seek(-1, os.SEEK_END)
            ended = f.read(1) == b"\n"
    eol, mark = detect_eol(head), head.startswith(UTF8_BOM)

    def chunks():
        first, total = True, _line_count(source) - 1
        for r in _ordered(raw):
            body = bytes(r.raw)
            if first and mark and not body.startswith(UTF8_BOM):
                body = UTF8_BOM + body
            first = False
            yield body + (b"" if r.line_no == total and not ended else eol)

    return atomic_write(path, chunks(), cancelled)


def _line_count(source: str | Path) -> int:
    n, last = 0, b"\n"
    with open(source, "rb") as f:
        while chunk := f.read(1 << 20):
            n, last = n + chunk.count(b"\n"), chunk[-1:]
    return n + (last != b"\n")


def export_csv(lines: DataFrame, columns: list[str], path: str | Path, cancelled: Callable[[], bool] = lambda: False) -> tuple[int | None, int]:
    """(lines written, lines that were no JSON)."""
    bad = 0
    spark = lines.sparkSession
    header = spark.range(1).select(F.concat_ws(",", *[csv_cell(F.lit(c)) for c in columns]).alias("h")).first().h

    def chunks():
        nonlocal bad
        yield UTF8_BOM + header.encode() + b"\r\n"
        for r in _ordered(csv_rows(lines, columns)):
            bad += not r.ok
            yield r.csv_line.encode() + b"\r\n"

    n = atomic_write(path, chunks(), cancelled)
    return (None if n is None else n - 1), bad


def export_pretty(lines: DataFrame, path: str | Path, cancelled: Callable[[], bool] = lambda: False) -> tuple[int | None, int]:
    """(records written, lines that were no JSON); a blank line stands between records."""
    bad = 0

    def chunks():
        nonlocal bad
        lead = b""
        for r in _ordered(pretty_rows(lines)):
            bad += not r.ok
            yield lead + r.text.encode() + b"\n"
            lead = b"\n"

    n = atomic_write(path, chunks(), cancelled)
    return n, bad


def choose_set(is_json: bool, filtered: DataFrame | None, searched: DataFrame | None, every: DataFrame) -> DataFrame:
    """What an export holds: a JSON log's filter, a plain log's search, else everything."""
    chosen = filtered if is_json else searched
    return every if chosen is None else chosen


def frozen(numbers: list[int], line_count: int) -> list[int]:
    """A line set as of now: sorted, each once, within the lines there are."""
    return sorted({n for n in numbers if 0 <= n < line_count})


def refuse_unless_known(*, filtering: bool = False, capped: bool = False) -> None:
    if filtering:
        raise ExportRefused("the filter is still running")
    if capped:
        raise ExportRefused("there are more hits than are listed")


def default_name(stem: str, kind: str, *, is_json: bool, filtered: bool, searched: bool, source_ext: str | None = None, now: datetime | None = None) -> str:
    part = "-filtered" if is_json and filtered else "-searched" if not is_json and searched else ""
    ext = {"raw": source_ext or "log", "pretty": "json", "csv": "csv"}[kind]
    return f"{stem}{part}-{(now or datetime.now(UTC)).strftime('%Y%m%d-%H%M%S')}.{ext}"
