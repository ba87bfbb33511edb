"""Synthetic logs as DataFrames: deterministic by row number and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import civil

#: Levels with their thousandths.
LEVEL_MIX = (("INFO", 940), ("DEBUG", 30), ("WARN", 20), ("ERROR", 9), ("FATAL", 1))
COMPONENTS = ("auth", "billing", "cache", "gateway", "orders", "search", "storage")
START_MS = 1_790_467_200_000
STATUS = (200, 201, 204, 301, 404, 500)


def draw(key: Column, salt: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(n))


def _picked(key: Column, salt: str, names) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (draw(key, salt, len(names)) + 1).cast("int"))


def level_of(key: Column, salt: str = "level") -> Column:
    x = draw(key, salt, 1000)
    edges, low = [], 0
    for name, share in LEVEL_MIX:
        low += share
        edges.append((low, name))
    out = F.lit(edges[-1][1])
    for edge, name in reversed(edges[:-1]):
        out = F.when(x < edge, F.lit(name)).otherwise(out)
    return out


def records(spark: SparkSession, n: int, seed: str = "66") -> DataFrame:
    """Fields of n requests."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("line_no"), (F.lit(START_MS) + i * 7 + draw(i, seed + "t", 5)).alias("ts_ms"), level_of(i, seed + "l").alias("level"), _picked(i, seed + "c", COMPONENTS).alias("logger"),
        F.lower(F.lpad(F.hex(F.xxhash64(i, F.lit(seed + "r"))), 16, "0")).alias("req_id"), draw(i, seed + "u", 100_000).alias("user_id"), draw(i, seed + "d", 3000).alias("duration_ms"),
        draw(i, seed + "b", 65_536).alias("bytes"), _picked(i, seed + "s", STATUS).alias("status"), draw(i, seed + "p", 10_000).alias("order_id"),
    )


def stamp(ms: Column, sep: str = "T", zone: str = "Z") -> Column:
    return F.concat(F.regexp_replace(civil(ms), " ", sep), F.lit(zone))


def plain_lines(spark: SparkSession, n: int, seed: str = "66") -> DataFrame:
    r = records(spark, n, seed)
    text = F.concat(
        stamp(F.col("ts_ms")), F.lit(" "), F.rpad("level", 5, " "), F.lit(" ["), "logger", F.lit("] request completed req_id="), "req_id", F.lit(" user=user_"), F.col("user_id").cast("string"),
        F.lit(" duration_ms="), F.col("duration_ms").cast("string"), F.lit(" bytes="), F.col("bytes").cast("string"), F.lit(" status="), F.col("status").cast("string"), F.lit(" path=/api/v1/orders/"), F.col("order_id").cast("string"),
    )
    return r.select("line_no", text.alias("value"))


def json_lines(spark: SparkSession, n: int, seed: str = "66", nested: bool = False) -> DataFrame:
    r = records(spark, n, seed)
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    user = F.struct(F.col("user_id").alias("id"), name.alias("name")) if nested else name
    tags = [F.array(F.lit("api"), F.lit("orders")).alias("tags")] if nested else []
    fields = [stamp(F.col("ts_ms")).alias("ts"), F.col("level"), F.col("logger"), F.lit("request completed").alias("msg"), F.col("req_id"), user.alias("user"), *tags, F.col("duration_ms"), F.col("bytes"), F.col("status"), F.concat(F.lit("/api/v1/orders/"), F.col("order_id").cast("string")).alias("path")]
    return r.select("line_no", F.to_json(F.struct(*fields)).alias("value"))


def merge_sources(spark: SparkSession, n: int, sources: int) -> tuple[list[DataFrame], DataFrame]:
    """Skewed sources, JSON and plain by turns, with late rows and rows without time, and a table of the truth."""
    made, truth = [], []
    for s in range(sources):
        skew = (s % 5 - 2) * 1700
        r = records(spark, n, f"m{s}")
        i = F.col("line_no")
        back = F.when(draw(i, f"o{s}", 1000) < 3, 500 + draw(i, f"j{s}", 1500)).otherwise(0)
        ts = F.col("ts_ms") + skew - back
        shared = F.when(i % 997 == 0, F.concat(F.lit("c0ffee"), F.lpad(F.lower(F.hex(i)), 11, "0"))).otherwise(F.col("req_id"))
        if s % 2 == 0:
            time = (ts.cast("string") if s % 4 == 2 else F.concat(F.lit('"'), stamp(ts), F.lit('"')))
            head = F.when(draw(i, f"n{s}", 1000) < 5, F.lit("{")).otherwise(F.concat(F.lit('{"ts":'), time, F.lit(",")))
            value = F.concat(head, F.lit('"level":"'), "level", F.lit('","req_id":"'), shared, F.lit('","duration_ms":'), F.col("duration_ms").cast("string"), F.lit("}"))
        else:
            front = (stamp(ts, " ", ""), stamp(ts), ts.cast("string"))[s % 3]
            front = F.regexp_replace(front, r"\.", ",") if s % 3 == 0 else front
            value = F.when(draw(i, f"n{s}", 100) < 1, F.lit("    at handler.process(Handler.java:42)")).otherwise(F.concat(front, F.lit(" "), "level", F.lit(" req_id="), shared))
        df = r.select("line_no", value.alias("value"), ts.alias("true_ts"))
        made.append(df.select("line_no", "value"))
        truth.append(df.agg(F.lit(s).alias("src"), F.lit("jsonl" if s % 2 == 0 else "log").alias("format"), F.lit(skew).alias("skew_ms"), F.count("*").alias("lines"), F.min("true_ts").alias("first_ts"), F.max("true_ts").alias("last_ts")))
    out = truth[0]
    for t in truth[1:]:
        out = out.unionByName(t)
    return made, out
