"""Following files that grow, as a Structured Streaming source.

``spark.readStream.format("lodeline_tail")`` gives rows (src, path, generation, line_no, value, status). Lines
come once they are ended, so each row is final: counts and filters over the stream equal those over the
whole file. A file that became shorter or has another beginning starts a new generation from line 0. A file that can't
be read gives a status row and is tried again; it never fails the query. Rows are read by executors, one task per file.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.levels import field_level, line_level
from ..operators.timeline import merge_order, running_order

SCHEMA = "src int, path string, generation long, line_no long, value string, status string"
HEAD = 1024
BLOCK = 1 << 20


class Part(InputPartition):
    def __init__(self, src: int, path: str, generation: int, begin: int, end: int, line_no: int, status: str = ""):
        self.src, self.path, self.generation, self.begin, self.end, self.line_no, self.status = src, path, generation, begin, end, line_no, status


def _head(path: str, n: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(n)).hexdigest()


def ended_at(path: str, begin: int, size: int) -> tuple[int, int]:
    """(place after the last line feed, line feeds) between two places of a file."""
    last, lines, at = begin, 0, begin
    with open(path, "rb") as f:
        f.seek(begin)
        while at < size and (chunk := f.read(min(BLOCK, size - at))):
            lines += chunk.count(b"\n")
            if (k := chunk.rfind(b"\n")) >= 0:
                last = at + k + 1
            at += len(chunk)
    return last, lines


class TailReader(DataSourceStreamReader):
    """Offsets hold for each file: generation, bytes and lines that were given, and the hash of its beginning."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def initialOffset(self) -> dict:
        return {p: json.dumps({"gen": 0, "pos": 0, "line": 0, "head": "", "n": 0, "status": ""}) for p in self.paths}

    def _next(self, path: str, old: dict) -> dict:
        try:
            size = os.stat(path).st_size
            same = size >= old["pos"] and (not old["n"] or _head(path, old["n"]) == old["head"])
            base = old if same else {"gen": old["gen"] + 1, "pos": 0, "line": 0}
            pos, lines = ended_at(path, base["pos"], size)
            n = min(HEAD, pos)
            return {"gen": base["gen"], "pos": pos, "line": base["line"] + lines, "head": _head(path, n), "n": n, "status": ""}
        except OSError as e:
            return old | {"status": type(e).__name__}

    def latestOffset(self) -> dict:
        held = getattr(self, "_held", None) or self.initialOffset()
        self._held = {p: json.dumps(self._next(p, json.loads(held[p]))) for p in self.paths}
        return self._held

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self._held = end
        out = []
        for src, p in enumerate(self.paths):
            a, b = json.loads(start[p]), json.loads(end[p])
            if b["status"] and b["status"] != a["status"]:
                out.append(Part(src, p, b["gen"], 0, 0, 0, b["status"]))
            begin, line = (a["pos"], a["line"]) if a["gen"] == b["gen"] else (0, 0)
            if b["pos"] > begin:
                out.append(Part(src, p, b["gen"], begin, b["pos"], line))
        return out

    def read(self, part: Part):
        if part.status:
            yield part.src, part.path, part.generation, None, None, part.status
            return
        with open(part.path, "rb") as f:
            f.seek(part.begin)
            line_no, left = part.line_no, part.end - part.begin
            while left > 0:
                raw = f.readline()
                left -= len(raw)
                raw = raw[:-1] if raw.endswith(b"\n") else raw
                raw = raw[:-1] if raw.endswith(b"\r") else raw
                text = raw.decode("utf-8", "replace")
                if line_no == 0 and text.startswith("﻿"):
                    text = text[1:]
                yield part.src, part.path, part.generation, line_no, text, ""
                line_no += 1

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodeline_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(json.loads(self.options["paths"]))


def tail(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A stream of the lines of growing files."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("lodeline_tail").option("paths", json.dumps(paths)).load()


def current(rows: DataFrame) -> DataFrame:
    """Of stored rows those of each file's latest generation."""
    latest = rows.groupBy("src").agg(F.max("generation").alias("_g"))
    return rows.join(F.broadcast(latest), "src").filter("generation = _g").drop("_g")


def level_counts(stream: DataFrame, token=None) -> DataFrame:
    """Running counts by file, generation and level, for complete or update mode."""
    level = line_level(F.col("value")) if token is None else field_level(token)
    return stream.filter("line_no is not null").groupBy("src", "generation", level.alias("level")).agg(F.count("*").alias("n"))


def filtered(stream: DataFrame, predicate) -> DataFrame:
    """A filter or trace that follows: stateless, so it appends."""
    return stream.filter(F.col("line_no").isNotNull() & predicate)


def follow_merge(stream: DataFrame, extract, path: str, checkpoint: str, **trigger):
    """Appends extracted rows (src, generation, line_no, value, ts_raw) to a table; ``merged`` reads it in merge order.

    Each batch goes to a folder of its own that a repeated batch replaces, so a batch counts once. Late rows are never
    dropped: the order is made anew when it is read.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("line_no is not null")
        rows.select("src", "generation", "line_no", "value", extract(rows).alias("ts_raw")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def merged(spark: SparkSession, path: str, hidden: tuple[int, ...] = ()) -> DataFrame:
    rows = current(spark.read.parquet(path)).select("src", "line_no", "value", "ts_raw")
    return merge_order(running_order(rows.filter(~F.col("src").isin(*hidden)) if hidden else rows))
