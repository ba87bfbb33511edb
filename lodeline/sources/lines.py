"""Log files as numbered lines: encodings, line ends, byte-order marks.

``read_lines`` numbers lines by the offset of the split that holds them: lines are counted per split, the counts are
added up (one row per split), and a line's place in its split follows from consecutive ids, so a file of any size is read in
parallel and no line is shuffled.
"""

from __future__ import annotations

import codecs
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD_BYTES = 64 << 10
#: The table of splits is broadcast up to so many rows.
BROADCAST_SPLITS = 500_000
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
BOM = "﻿"


def _utf8_but_for_its_end(head: bytes) -> bool:
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return False
    return True


def _gbk_pairs(head: bytes) -> tuple[int, int]:
    """(two-byte characters of the code page, bytes that fit none)."""
    good = bad = i = 0
    while i < len(head):
        b = head[i]
        if b < 0x80:
            i += 1
        elif 0x81 <= b <= 0xFE and i + 1 < len(head) and (0x40 <= head[i + 1] <= 0x7E or 0x80 <= head[i + 1] <= 0xFE):
            good, i = good + 1, i + 2
        else:
            bad, i = bad + (i + 1 < len(head)), i + 1
    return good, bad


def detect_encoding(head: bytes) -> str:
    """Mark, UTF-16 by its zero bytes, valid UTF-8, GBK by its pairs, else Latin-1."""
    for mark, name in BOMS:
        if head.startswith(mark):
            return name
    if len(head) >= 4:
        even, odd = head[0::2].count(0) / len(head[0::2]), head[1::2].count(0) / len(head[1::2])
        if odd > 0.3 > 0.05 > even:
            return "utf-16-le"
        if even > 0.3 > 0.05 > odd:
            return "utf-16-be"
    if _utf8_but_for_its_end(head):
        return "utf-8"
    good, bad = _gbk_pairs(head)
    return "gbk" if good and bad * 20 <= good else "latin-1"


def head_of(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, by the file system that its path names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return b""
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def split_text(text: str) -> list[str]:
    """Lines of a whole text: ended by line feeds alone, carriage returns before them cut, blank lines kept."""
    rows = text.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    return [r[:-1] if r.endswith("\r") else r for r in rows]


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of files that Spark's text reader can't decode: whole files, one task each."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                text = content.decode(encoding, "replace")
                rows = split_text(text[1:] if text.startswith(BOM) else text)
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [p] * len(part), "line_no": range(k, k + len(part)), "value": part}, schema=pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("value", pa.string())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line_no long, value string")


def read_lines(spark: SparkSession, path: str, encoding: str | None = None, src: int = 0) -> DataFrame:
    """Rows (src, path, line_no from 0, value) of a file or folder."""
    encoding = encoding or detect_encoding(head_of(spark, path))
    if encoding not in ("utf-8", "ascii"):
        return _decoded(spark, path, encoding).select(F.lit(src).alias("src"), "path", "line_no", "value")
    raw = spark.read.option("lineSep", "\n").text(path)
    tagged = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    # A split's lines have consecutive ids, so a line's place in it needs its first id alone.
    splits = tagged.groupBy("path", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_begin"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    first = splits.select("path", "_at", (F.coalesce(before, F.lit(0)) - F.col("_begin")).alias("_shift"))
    numbered = tagged.join(F.broadcast(first) if split_bound(spark, path) <= BROADCAST_SPLITS else first, ["path", "_at"])
    line = F.regexp_replace("value", "\r$", "")
    line_no = (F.col("_shift") + F.col("_id")).cast("long")
    return numbered.select(F.lit(src).alias("src"), "path", line_no.alias("line_no"), F.when(line_no == 0, F.regexp_replace(line, f"^{BOM}", "")).otherwise(line).alias("value"))


def split_bound(spark: SparkSession, path: str) -> int:
    """No fewer than the splits that reading a file or folder has."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    opened = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    return held.getFileCount() + held.getLength() // max(1, min(size, opened))


def head_lines(spark: SparkSession, path: str, encoding: str | None = None, n: int = HEAD_BYTES) -> list[str] | None:
    """The whole lines among a file's first bytes; None for a folder."""
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        return None
    head = head_of(spark, path, n + 1)
    text = head[:n].decode(encoding or detect_encoding(head), "replace")
    rows = split_text(text[1:] if text.startswith(BOM) else text)
    return rows[:-1] if len(head) > n and len(rows) > 1 and not text.endswith("\n") else rows


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, line_no, raw) with the bytes of each line, line ends cut; for exports that must not change a byte."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                rows = content.split(b"\n")
                if rows[-1] == b"":
                    rows.pop()
                rows = [r[:-1] if r.endswith(b"\r") else r for r in rows]
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_pydict({"path": [p] * len(part), "line_no": range(k, k + len(part)), "raw": part}, schema=pa.schema([("path", pa.string()), ("line_no", pa.int64()), ("raw", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line_no long, raw binary")


def read_sources(spark: SparkSession, paths: list[str], encodings: list[str | None] | None = None) -> DataFrame:
    """Several files in one table, src by their order."""
    encodings = encodings or [None] * len(paths)
    return reduce(DataFrame.unionByName, [read_lines(spark, p, e, i) for i, (p, e) in enumerate(zip(paths, encodings, strict=True))])


def ingest(lines: DataFrame, path: str) -> DataFrame:
    """Writes lines as Parquet sorted by (src, line_no), so that line ranges skip row groups, and reads them back."""
    lines.repartitionByRange("src", "line_no").sortWithinPartitions("src", "line_no").write.mode("overwrite").parquet(path)
    return lines.sparkSession.read.parquet(path)


def lines_of_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines (src_key, line_no, value) of texts in a table."""
    t = F.col(text)
    body = F.when(F.endswith(t, F.lit("\n")), F.expr(f"substring(`{text}`, 1, char_length(`{text}`) - 1)")).otherwise(t)
    return df.filter(t.isNotNull() & (t != "")).select(F.col(key).alias("src_key"), F.posexplode(F.split(body, "\n")).alias("line_no", "value")).select("src_key", F.col("line_no").cast("long").alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))
