"""Mixing sources to target weights.

Sizes are summed per source, the target shares are filled up to a cap, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as its probability. All of it is
DataFrame expressions: one pass sums sizes (partial aggregation before a shuffle of one row per source and
task), a second gives every document its source's rate. The table of rates is written first, so Spark knows
its size and broadcasts it only under ``autoBroadcastJoinThreshold``; beyond, the join is salted, so a source
with a third of all rows is dealt to many tasks.

Defined results: null text has size 0; the null source is a source like any other, last in order; an
empty table gives an empty result; repeated rows are mixed independently of each other but decided alike,
since the decision depends on the document id only; further columns, whatever their names, are kept by
``mix`` and not looked at. Where all sizes are 0 every target and rate is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, stored, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: A source, and so a document, is repeated at most so many times.
MAX_REPEAT = 3
#: Salts that a source's rows are dealt over.
SALTS = 16
SEED = "mix-1"


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of ``key`` and ``seed``: 52 bits of it."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source (source, source_size, target, rate) from rows of (source, size).

    The cap of a source is ``max_repeat`` times its size. Sources fill up in the order of cap over
    weight, so the capped ones are a prefix of that order; the rest share what is left by weight. The
    windows see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = per.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * max_repeat)
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k").asc())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_wleft", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # Of this source's order on, would an even level pass this source's cap?
        .withColumn("_over", F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_wleft"))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_wleft"))
    )
    # The level of all uncapped sources is the one met at the first that stays under its cap.
    first = F.min(F.when(~F.col("_over"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_k"), F.col("_level")))).over(every)
    settled = levels.withColumn("_first", first)
    target = F.when(F.col("_over") | F.col("_first").isNull(), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_first._level"))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))
    return settled.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED, salts: int = SALTS) -> DataFrame:
    """Every row of ``docs`` once, in a struct ``doc``, with size, source_size, target and copies."""
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc", F.col(f"doc.`{source}`").alias("source"), F.col(f"doc.`{doc_id}`").alias("_id"), word_count(F.col(f"doc.`{text}`")).alias("size")
    )
    sizes = docs.select(F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    # Written first, so that its true size decides whether the join broadcasts it or shuffles by salt.
    targets = stored(source_targets(sizes, weights, max_repeat).coalesce(1), "targets")
    targets = targets.select(F.col("source").alias("_source"), "source_size", "target", "rate", salt)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["_source"]) & (rows["_salt"] == targets["_salt"]))
    whole = F.floor("rate").cast("int")
    extra = (unit_hash(F.col("_id"), seed) < F.col("rate") - whole).cast("int")
    return joined.select("doc", "size", "source_size", "target", (whole + extra).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    copies = mix(docs, **options).filter("copies > 0")
    return copies.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document with the words that the mix takes from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix(docs)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * 3 AS cap FROM p
), l AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(cap) OVER before AS BIGINT), 0) AS rest,
         CAST(sum(w) OVER () AS BIGINT) - coalesce(CAST(sum(w) OVER before AS BIGINT), 0) AS wrest
  FROM k WINDOW before AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, rest * w > cap * wrest AS above FROM l
), t AS (
  SELECT source, source_size, CASE WHEN above THEN CAST(cap AS DOUBLE)
    ELSE w * (SELECT CAST(rest AS DOUBLE) / wrest FROM o WHERE NOT above ORDER BY cap / w, k LIMIT 1) END AS target
  FROM o
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t
)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
