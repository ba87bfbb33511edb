"""The front door: open a log, filter, search, count, profile, expand, export; merge several; follow growing ones."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import DETECT_BYTES, SCHEMA_BYTES
from .functions import jsonx
from .operators import export, levels, profile, query, rows, search
from .operators import timeline as tl
from .sources import schema
from .sources.lines import head_lines, read_lines, read_raw
from .streaming.tail import tail  # noqa: F401  part of this surface


@dataclass
class LogFrame:
    """One log, or a part of one; every method leaves it as it is."""

    spark: SparkSession
    path: str
    lines: DataFrame
    is_json: bool
    columns: list[schema.Column] = field(default_factory=list)
    query: str = ""
    searched: search.SearchResult | None = None
    first: list[str] | None = None

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def level_column(self) -> str | None:
        return levels.find_level_column(self.names)

    def _with(self, **changes) -> LogFrame:
        return LogFrame(**(vars(self) | changes))

    def filter(self, text: str) -> LogFrame:
        return self._with(lines=query.run_filter(self.lines, text, self.names), query=query.append_clause(self.query, text))

    def search(self, pattern: str) -> search.SearchResult:
        self.searched = search.search(self.lines, pattern)
        return self.searched

    def levels(self) -> DataFrame:
        if self.is_json and (column := self.level_column):
            scan = profile.field_scan(self.lines, column)
            return levels.count_levels(scan, levels.field_level(F.col("raw")), column)
        return levels.count_levels(self.lines, levels.line_level(F.col("value")))

    def analyze(self, name: str) -> profile.Analysis:
        return profile.analyze(self.lines, name, filter_text=self.query)

    def table(self, columns: list[str] | None = None) -> DataFrame:
        parsed = self.lines.select("src", "line_no", jsonx.parse_line(F.col("value")).alias("_p"))
        return parsed.select("src", "line_no", *[jsonx.field_of(F.col("_p"), c).alias(c) for c in columns or self.names])

    def expand(self, line_numbers: Iterable[int]) -> DataFrame:
        return rows.sub_rows(self.lines.filter(F.col("line_no").isin(*line_numbers)))

    def head(self, n: int) -> DataFrame:
        return rows.head_sample(self.lines, n)

    def export(self, path: str, kind: str = "raw"):
        chosen = export.choose_set(self.is_json, self.lines if self.query else None, self.searched.hits if self.searched else None, self.lines)
        if not self.is_json and self.searched is not None:
            export.refuse_unless_known(capped=self.searched.capped)
        if kind == "csv":
            return export.export_csv(chosen, self.names, path)
        if kind == "pretty":
            return export.export_pretty(chosen, path)
        local = self.path.removeprefix("file://")
        if chosen is self.lines and not self.query:
            return export.export_full(local, path)
        return export.export_raw(read_raw(self.spark, self.path).join(chosen.select("line_no"), "line_no", "left_semi"), local, path)


def open_log(spark: SparkSession, path: str, encoding: str | None = None, src: int = 0) -> LogFrame:
    """Only the file's head is read for what it is; a folder's first lines are looked up."""
    lines = read_lines(spark, path, encoding, src)
    first = head_lines(spark, path, encoding, max(DETECT_BYTES, SCHEMA_BYTES))
    seen = lines if first is None else first
    is_json = schema.is_json_lines(seen)
    return LogFrame(spark, path, lines, is_json, schema.discover_columns(seen) if is_json else [], first=first)


def open_source(log: LogFrame, offset_ms: int = 0, zone_ms: int = 0, hidden: bool = False) -> tl.Source | tl.Rejected:
    route = schema.probe_route(log.path, log.lines if log.first is None else log.first, log.names, log.spark)
    if isinstance(route, tl.Rejected):
        return route
    return tl.Source(log.path, log.lines.select("line_no", "value"), route, log.names, offset_ms, zone_ms, hidden)


def merge(logs: list[LogFrame], offsets: list[int] | None = None, zones: list[int] | None = None, hidden: tuple[int, ...] = ()) -> tl.Timeline:
    n = len(logs)
    made = [open_source(log, o, z, i in hidden) for i, (log, o, z) in enumerate(zip(logs, offsets or [0] * n, zones or [0] * n, strict=True))]
    return tl.merge(logs[0].spark, made)
