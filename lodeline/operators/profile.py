"""Field profiles: numeric statistics with nearest-rank quantiles, or the most frequent values.

Input is a scope (any filtered DataFrame) with columns src, line_no, kind and raw (the typed token of one
field; both null where the line lacks it).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISTINCT_CAP, TOP_VALUES, VOTE_ROWS
from ..functions import jsonx

#: A JSON number as text.
NUMBER = r"\A-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\z"
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
#: Bins of a histogram; so many values are counted one by one.
BINS, FEW = 4096, 200_000


def field_scan(lines: DataFrame, field: str, line: str = "value") -> DataFrame:
    """Rows (src, line_no, kind, raw) of a top-level field, by the strict parser."""
    parsed = lines.withColumn("_p", jsonx.parse_line(F.col(line)))
    keep = [c for c in ("src", "line_no") if c in lines.columns]
    return parsed.select(*keep, jsonx.field_of(F.col("_p"), field, "kinds").alias("kind"), jsonx.field_of(F.col("_p"), field, "raw").alias("raw"))


def number_of(kind: Column, raw: Column) -> Column:
    return F.when((kind == "Num") & F.rlike(raw, F.lit(NUMBER)), raw.try_cast("double"))


def is_numeric(scan: DataFrame, order: list[str]) -> bool:
    """Whether half of the scope's first rows, those without the field counted, are numbers."""
    head = scan.orderBy(*order).limit(VOTE_ROWS)
    seen, num = head.agg(F.count("*"), F.count(F.when(F.col("kind") == "Num", 1))).first()
    return bool(seen) and 2 * num >= seen


def nearest_rank(p: float, n: Column) -> Column:
    """1-based place of a quantile among n sorted values: round((n - 1) p), halves away from zero."""
    return (F.floor((n - 1) * p + 0.5) + 1).cast("long")


def numeric_stats(scan: DataFrame) -> DataFrame:
    """One row: count, skipped, scope_rows, min, max, mean, p50, p95, p99, sampled (never).

    Quantiles are exact at any size: one pass for the sums, then histograms of ``BINS`` bins, of which only those that hold a rank
    are looked into again, until few enough values are left to be counted one by one. What is shuffled is a row per bin and task.
    """
    x = number_of(F.col("kind"), F.col("raw"))
    values = scan.select(x.alias("x"))
    base = values.agg(F.count("*").alias("scope_rows"), F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.sum("x").alias("sum")).first()
    nan, n = float("nan"), base["count"]
    ranks = {k: math.floor((n - 1) * p + 0.5) + 1 for k, p in QUANTILES.items()} if n else {}
    found = at_ranks(values.filter("x is not null"), "x", sorted(set(ranks.values())), base["min"], base["max"], n) if n else {}
    picked = {"min": base["min"], "max": base["max"], "mean": base["sum"] / n if n else None, **{k: found.get(ranks.get(k)) for k in QUANTILES}}
    cells = [F.lit(n).cast("long").alias("count"), F.lit(base.scope_rows - n).cast("long").alias("skipped"), F.lit(base.scope_rows).cast("long").alias("scope_rows")]
    return scan.sparkSession.range(1).select(*cells, *[F.lit(nan if v is None else float(v)).alias(k) for k, v in picked.items()], F.lit(False).alias("sampled"))


def at_ranks(values: DataFrame, name: str, ranks: list[int], low: float, high: float, n: int, before: int = 0) -> dict[int, float]:
    """The values at 1-based ranks of the n values in [low, high]; ``before`` values are less."""
    x = F.col(name)
    if low == high or not ranks:
        return dict.fromkeys(ranks, low)
    width = high - low
    if n <= FEW or not math.isfinite(width):
        counts = values.groupBy(name).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.orderBy(name)) + before
        ranked = counts.select(name, upto.alias("upto"))
        row = ranked.agg(*[F.min(F.when(F.col("upto") >= r, x)).alias(f"r{r}") for r in ranks]).first()
        return {r: row[f"r{r}"] for r in ranks}
    # The same expression in every pass and never falling with x, so a bin's values are one range.
    bin_ = F.least(F.floor((x - F.lit(low)) / F.lit(width) * BINS), F.lit(BINS - 1))
    rows = values.groupBy(bin_.alias("b")).agg(F.count("*").alias("c"), F.min(name).alias("lo"), F.max(name).alias("hi")).collect()
    out, left = {}, list(ranks)
    for r in sorted(rows, key=lambda r: r.b):
        own = [k for k in left if k <= before + r.c]
        if own:
            left = left[len(own) :]
            out |= at_ranks(values.filter((x >= F.lit(r.lo)) & (x <= F.lit(r.hi))), name, own, r.lo, r.hi, r.c, before)
        before += r.c
    return out


def quantiles(counts: DataFrame, value: str, weight: str, ps: dict[str, float], buckets: int = 256) -> DataFrame:
    """One row with a nearest-rank quantile per name, of values with weights.

    Values are put in buckets between approximate quantiles; a bucket's first rank is the sum of those below it
    (a row per bucket), so windows run within buckets only.
    """
    marks = counts.approxQuantile(value, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    marks = sorted(set(marks))
    bucket = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col(value))) if marks else F.lit(0)
    placed = counts.withColumn("_b", bucket)
    sums = placed.groupBy("_b").agg(F.sum(weight).alias("_w"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_w").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("_n", F.sum("_w").over(Window.partitionBy())).select("_b", "_before", "_n")
    ranked = placed.join(F.broadcast(before), "_b").withColumn("_upto", F.col("_before") + F.sum(weight).over(Window.partitionBy("_b").orderBy(value)))
    picked = [F.min(F.when(F.col("_upto") >= nearest_rank(p, F.col("_n")), F.col(value))).alias(k) for k, p in ps.items()]
    return ranked.agg(*picked)


def enum_stats(scan: DataFrame, top: int = TOP_VALUES, cap: int | None = DISTINCT_CAP) -> DataFrame:
    """Most frequent values: rank, value, n, and on each row others, total, skipped, capped, scope_rows.

    Only the first ``cap`` values to appear are told apart; rows of later ones are in ``others``. Without a cap (None) all are. A field that
    is missing or nested is skipped. The counts add up: sum of n and others is total. An empty scope gives one row
    without a value.
    """
    order = F.struct(*[c for c in ("src", "line_no") if c in scan.columns])
    text = F.when(F.col("kind").isNotNull() & (F.col("kind") != "Nested"), F.col("raw"))
    rows = scan.select(text.alias("value"), order.alias("_at"))
    totals = rows.agg(F.count("*").alias("scope_rows"), F.count("value").alias("total"))
    each = rows.filter("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.min("_at").alias("_at"))
    distinct = each.agg(F.count("*").alias("_distinct"))
    kept = each if cap is None else each.orderBy("_at").limit(cap)
    best = kept.orderBy(F.desc("n"), "value").limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    summary = totals.join(distinct, F.lit(True)).withColumn("_one", F.lit(1))
    shown = ranked.withColumn("_one", F.lit(1))
    out = summary.join(shown, "_one", "left")  # at most ``top`` rows
    listed = F.coalesce(F.sum("n").over(Window.partitionBy("_one")), F.lit(0))
    return out.select("rank", "value", "n", (F.col("total") - listed).alias("others"), "total", (F.col("scope_rows") - F.col("total")).alias("skipped"), (F.lit(False) if cap is None else F.col("_distinct") > cap).alias("capped"), "scope_rows")


@dataclass
class Analysis:
    """A field's profile with the filter that made its scope."""

    field: str
    numeric: bool
    rows: DataFrame
    filter_text: str = ""


def analyze(lines: DataFrame, field: str, *, line: str = "value", filter_text: str = "") -> Analysis:
    scan = field_scan(lines, field, line)
    order = [c for c in ("src", "line_no") if c in scan.columns]
    numeric = is_numeric(scan, order)
    rows = numeric_stats(scan) if numeric else enum_stats(scan)
    return Analysis(field, numeric, rows.withColumn("filter_text", F.lit(filter_text)), filter_text)
