"""Several time-stamped sources in one stable timeline.

Merging heads of sources by the least (time, source), with each source's own order kept, gives the order of
(running maximum of time within the source, source, line). So a merge is one window and one sort; late rows
are pinned to the time that their source had reached.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import MAX_SOURCES, MAX_UNION_COLUMNS, WINDOW_ROWS
from ..functions import jsonx
from ..functions.text import contains_ci, trim_end
from ..functions.timestamps import clamp_offset, clamp_zone, prefix_ms, time_of_day, value_ms

BLOCK = 1 << 16


@dataclass
class Route:
    """How a source tells time: a JSON field, or the beginning of its lines in a format."""

    field: str | None = None
    form: str | None = None

    @property
    def label(self) -> str:
        return f"field {self.field}" if self.field else f"prefix {self.form}"


@dataclass
class Source:
    path: str
    lines: DataFrame  # line_no, value
    route: Route
    columns: list[str] = field(default_factory=list)  # empty for plain logs
    offset_ms: int = 0
    zone_ms: int = 0
    hidden: bool = False


@dataclass
class Rejected:
    path: str
    reason: str


def extract(source: Source, src: int) -> DataFrame:
    """Rows (src, line_no, value, ts_raw): milliseconds with the source's clock offset, null where a row has no time."""
    zone, offset = clamp_zone(source.zone_ms), clamp_offset(source.offset_ms)
    value = F.col("value")
    if source.route.field is None:
        ts = prefix_ms(value, source.route.form or "iso", zone)
    else:
        ts = value_ms(jsonx.native_field(value, [source.route.field]), zone)
    return source.lines.select(F.lit(src).alias("src"), "line_no", "value", (ts + offset).alias("ts_raw"))


def running_order(rows: DataFrame, ts: str = "ts_raw") -> DataFrame:
    """Adds ts (missing times inherited) and reached, the running maximum of a source; rows (src, line_no, ...).

    Windows run within blocks of lines; what a block inherits from those before it comes from one row per block, so a
    source of any length is dealt to many tasks.
    """
    t = F.col(ts)
    placed = rows.withColumn("_b", F.floor(F.col("line_no") / BLOCK))
    blocks = placed.groupBy("src", "_b").agg(F.max_by(t, F.when(t.isNotNull(), F.col("line_no"))).alias("_last"), F.max(t).alias("_max"), F.min_by(t, F.when(t.isNotNull(), F.col("line_no"))).alias("_lead"))
    earlier = Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = blocks.select("src", "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_last"), F.max("_max").over(earlier).alias("_max"), F.first("_lead", ignorenulls=True).over(whole).alias("_lead"))
    inside = Window.partitionBy("src", "_b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(carried, ["src", "_b"])
    out = out.withColumn("ts", F.coalesce(F.last(t, ignorenulls=True).over(inside), "_last", "_lead"))
    # Inherited times never pass the maximum that the row before had reached, but leading rows take the first time.
    return out.withColumn("reached", F.greatest(F.max("ts").over(inside), "_max")).drop("_b", "_last", "_max", "_lead")


def merge_order(rows: DataFrame) -> DataFrame:
    """Adds merge_pos from 0 to rows with reached, src, line_no; rows of sources without any time come last."""
    return positions(rows, "reached", ["src", "line_no"], "merge_pos")


def positions(rows: DataFrame, by: str, then: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """A dense place over the order of a number (nulls last) and further columns.

    Rows are ranked within ranges of the number; a range's first place is the sum of the rows below it, one
    row per range. No task sorts all rows.
    """
    ranges = ranges or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = rows.filter(F.col(by).isNotNull()).select(F.col(by).cast("double").alias("x"))
    bounds = sorted(set(known.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(by))) if bounds else F.lit(0)
    marked = rows.withColumn("_p", F.when(F.col(by).isNull(), F.lit(len(bounds) + 1)).otherwise(bucket))
    keys = [F.col(by).asc_nulls_last(), *then]
    sizes = marked.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    joined = ranked.join(before, F.col("_p") == F.col("_q"))
    return joined.withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_p", "_q", "_r", "_before")


@dataclass
class Timeline:
    """Merged sources; every change makes a new timeline from the extracted rows."""

    spark: SparkSession
    sources: list[Source]
    rejected: list[Rejected] = field(default_factory=list)
    traced: str | None = None

    def extracted(self, src: int) -> DataFrame:
        return extract(self.sources[src], src)

    def rows(self) -> DataFrame:
        """(src, line_no, value, ts, reached, merge_pos, time): hidden sources are left out, source numbers stay."""
        shown = [self.extracted(i) for i, s in enumerate(self.sources) if not s.hidden]
        if not shown:
            empty = self.spark.createDataFrame([], "src int, line_no long, value string, ts_raw long")
            shown = [empty]
        one = reduce(DataFrame.unionByName, shown)
        out = merge_order(running_order(one)).withColumn("time", time_of_day(F.col("ts")))
        return out if self.traced is None else out.filter(contains_ci(F.col("value"), self.traced))

    def _with(self, **changes) -> Timeline:
        return Timeline(**({"spark": self.spark, "sources": self.sources, "rejected": self.rejected, "traced": self.traced} | changes))

    def hide(self, *srcs: int) -> Timeline:
        return self._with(sources=[Source(**(vars(s) | {"hidden": i in srcs})) for i, s in enumerate(self.sources)])

    def set_time(self, src: int, *, offset_ms: int | None = None, zone_ms: int | None = None) -> Timeline:
        new = {k: v for k, v in (("offset_ms", offset_ms and clamp_offset(offset_ms)), ("zone_ms", zone_ms and clamp_zone(zone_ms))) if v is not None}
        return self._with(sources=[Source(**(vars(s) | (new if i == src else {}))) for i, s in enumerate(self.sources)])

    def trace(self, value: str | None) -> Timeline:
        """Rows of all sources whose line holds the value, literally and in any ASCII case; None shows all again."""
        return self._with(traced=value)

    def row_at(self, position: int) -> DataFrame:
        return self.rows().filter(F.col("merge_pos") == position)

    def position_of(self, src: int, line_no: int) -> DataFrame:
        return self.rows().filter((F.col("src") == src) & (F.col("line_no") == line_no)).select("merge_pos")

    def window(self, start: int, n: int = WINDOW_ROWS) -> DataFrame:
        return self.rows().filter(F.col("merge_pos").between(start, start + min(n, WINDOW_ROWS) - 1)).orderBy("merge_pos")

    def columns(self) -> tuple[list[str], int]:
        return union_columns([s.columns for s in self.sources])

    def table(self) -> DataFrame:
        """Rows (src, line_no, merge_pos, time, cells); cells has the union of the sources' columns, whatever their names."""
        names, _ = self.columns()
        parts = [union_cells(self.extracted(i), s.columns, names) for i, s in enumerate(self.sources) if not s.hidden]
        cells = reduce(DataFrame.unionByName, parts).select("src", "line_no", F.struct(*[F.col(f"`{n}`") for n in names]).alias("cells"))
        return self.rows().select("src", "line_no", "merge_pos", "time").join(cells, ["src", "line_no"])

    def text(self) -> DataFrame:
        return self.rows().withColumn("value", trim_end(F.col("value")))


def union_columns(schemas: list[list[str]], cap: int = MAX_UNION_COLUMNS) -> tuple[list[str], int]:
    """Columns of all sources as they first appear, at most ``cap``, and how many mentions of others were left out."""
    kept = list(dict.fromkeys(c for s in schemas for c in s))[:cap]
    shown = set(kept)
    return kept, sum(c not in shown for s in schemas for c in s)


def union_cells(rows: DataFrame, own: list[str], names: list[str]) -> DataFrame:
    """One source's cells: blank where its schema lacks the column, the line lacks the field or is no JSON."""
    parsed = rows.select("src", "line_no", jsonx.parse_line(F.col("value")).alias("_p"))
    cells = [(F.coalesce(jsonx.field_of(F.col("_p"), c), F.lit("")) if c in own else F.lit("")).alias(c) for c in names]
    return parsed.select(F.col("src"), F.col("line_no"), *cells)


def carry_state(state: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Rows with a source number (bookmarks, selection) renumbered to the places of their paths; those of sources that left go."""
    moves = [(i, new.index(p)) for i, p in enumerate(old) if p in new]
    to = state.sparkSession.createDataFrame(moves, "src int, _to int")
    return state.join(F.broadcast(to), "src").withColumn("src", F.col("_to")).drop("_to")


def merge(spark: SparkSession, sources: list[Source | Rejected]) -> Timeline:
    """At most eight sources in the given order; those that were refused are listed with their reasons."""
    good = [s for s in sources if isinstance(s, Source)]
    bad = [s for s in sources if isinstance(s, Rejected)]
    bad += [Rejected(s.path, "too many sources") for s in good[MAX_SOURCES:]]
    return Timeline(spark, good[:MAX_SOURCES], bad)
