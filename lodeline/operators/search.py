"""Regular-expression search over lines: case-insensitive and Unicode-aware unless the pattern says otherwise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SEARCH_CAP


class BadPattern(ValueError):
    """The pattern is no regular expression; earlier results stand."""


def build_pattern(query: str) -> str:
    """Lines are matched decoded, so all encodings take the full syntax; (?-i) in a pattern restores case."""
    return "(?iuU)" + query


def check_pattern(spark: SparkSession, query: str) -> str:
    pattern = build_pattern(query)
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        raise BadPattern(query) from e
    return pattern


def matches(line: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(line, F.lit(pattern)), F.lit(False))


@dataclass
class SearchResult:
    """``hits`` has the first matching lines in order; both totals count all of them."""

    hits: DataFrame
    hit_lines: int
    total_matches: int

    @property
    def capped(self) -> bool:
        return self.hit_lines > SEARCH_CAP


def search_lines(lines: DataFrame, query: str, *, line: str = "value") -> DataFrame:
    return lines.filter(matches(F.col(line), check_pattern(lines.sparkSession, query)))


def search(lines: DataFrame, query: str, *, line: str = "value", cap: int = SEARCH_CAP) -> SearchResult:
    pattern = check_pattern(lines.sparkSession, query)
    found = lines.filter(matches(F.col(line), pattern))
    hit_lines, total = totals(lines, pattern, line).first()
    hits = found if hit_lines <= cap else found.orderBy(*[c for c in ("src", "line_no") if c in lines.columns]).limit(cap)
    return SearchResult(hits, hit_lines, total)


def totals(lines: DataFrame, pattern: str, line: str = "value") -> DataFrame:
    """One row: hit_lines, total_matches."""
    found = lines.filter(matches(F.col(line), pattern))
    return found.agg(F.count("*").alias("hit_lines"), F.coalesce(F.sum(F.regexp_count(F.col(line), F.lit(pattern))), F.lit(0)).cast("long").alias("total_matches"))


def first_from(hits: DataFrame, current: int) -> DataFrame:
    """The first hit at or after a line, else the first of all: one row, line_no null without hits."""
    x = F.col("line_no")
    return hits.agg(F.coalesce(F.min(F.when(x >= current, x)), F.min(x)).alias("line_no"))


def next_hit(hits: DataFrame, current: int) -> DataFrame:
    x = F.col("line_no")
    return hits.agg(F.coalesce(F.min(F.when(x > current, x)), F.min(x)).alias("line_no"))


def previous_hit(hits: DataFrame, current: int) -> DataFrame:
    x = F.col("line_no")
    return hits.agg(F.coalesce(F.max(F.when(x < current, x)), F.max(x)).alias("line_no"))


def position(hits: DataFrame, current: int) -> DataFrame:
    """k of n, k from 1, for a line that is a hit."""
    return hits.agg(F.count(F.when(F.col("line_no") <= current, 1)).alias("k"), F.count("*").alias("n"))


def highlights(lines: DataFrame, query: str, *, line: str = "value") -> DataFrame:
    """One row per match that has characters: keys of the line, begin, end (code points) and the text.

    A line is what stands between its matches and the matches in turn, both as the JVM's engine sees them in the whole line, so
    places follow from lengths, whatever boundaries, anchors or looks around a pattern has.
    """
    pattern = check_pattern(lines.sparkSession, query)
    keys = [c for c in ("src", "line_no") if c in lines.columns]
    c = F.col(line)
    found = lines.filter(matches(c, pattern)).select(*keys, F.split(c, pattern, -1).alias("_between"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("_all"))
    # An empty match at a line's very beginning leaves no part before it.
    own = F.when(F.size("_between") == F.size("_all"), F.slice("_all", F.lit(2), F.size("_all") - 1)).otherwise(F.col("_all"))
    both = found.withColumn("_m", own)
    turns = F.zip_with("_between", "_m", lambda b, m: F.struct(F.char_length(b).alias("gap"), m.alias("text")))
    kind = "array<struct<begin:int,end:int,text:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def add(acc, t):
        begin = acc["at"] + t["gap"]
        end = begin + F.coalesce(F.char_length(t["text"]), F.lit(0))
        span = F.array(F.struct(begin.alias("begin"), end.alias("end"), t["text"].alias("text"))).cast(kind)
        return F.struct(end.alias("at"), F.when(end > begin, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return both.select(*keys, F.inline(F.aggregate(turns, start, add, lambda acc: acc["out"])))
