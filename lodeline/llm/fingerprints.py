"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence. For each of ``HASHES`` hash functions the ``TUPLE``
k-mers of least hash are selected, put back in text order and hashed as a tuple. The share of equal
tuple hashes estimates likeness under edits: it falls both when k-mers change and when they change order.

A text is one row and its fingerprint needs no other, so fingerprints are a map over Arrow batches. The
edited text of op10 needs the next document in order: documents are dealt by ranges of doc_id, sorted, and
each range gets a copy of the first document of the following range, so no task sees more than its range.

Defined results: null is the empty text; texts shorter than a k-mer are one k-mer; an empty text has
the fingerprint of an empty k-mer; equal texts have equal fingerprints; null doc_ids come first, equal doc_ids
go by text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K, TUPLE, HASHES = 6, 2, 32
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FACTORS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _M) | np.uint64(1)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """A hash for each k-mer and its occurrence number, in text order."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(code) < k:
        code = np.concatenate([code, np.full(k - len(code), 0x110000, np.uint64)])
    n = len(code) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + code[j : j + n]
    h = _mix(h * _M)
    # Equal k-mers stand together once sorted by hash and place; a place takes the low bits.
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    key = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    place, group = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), key >> bits
    first = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    number = np.empty(n, np.uint64)
    number[place] = (np.arange(n) - begin).astype(np.uint64)
    return _mix(h + number * _M)


def signature(text: str | None, k: int = K, size: int = TUPLE) -> np.ndarray:
    """The ``HASHES`` tuple hashes of a text (32 bits each)."""
    x = numbered_kmers(text or "", k)
    n = len(x)
    size = min(size, n)
    rows = np.arange(HASHES)[:, None]
    spread = _FACTORS[:, None]
    if n <= 64:
        least = np.argsort(_hashed(x, spread), axis=1, kind="stable")[:, :size]
    else:
        # Few values lie under a bound that lets about 12 through; where it lets too few through, all are ranked.
        bound = np.uint64(min(2**64 - 1, 12 * size * (2**64 // n) // 2))
        least = np.empty((HASHES, size), np.int64)
        for at in range(0, HASHES, step := max(1, min(HASHES, (1 << 16) // n))):
            h = _hashed(x, spread[at : at + step])
            low = np.flatnonzero((h < bound).ravel())
            row, col = np.divmod(low, n)
            order = np.lexsort((h.ravel()[low], row))
            row, col = row[order], col[order]
            begin = np.searchsorted(row, np.arange(len(h) + 1))
            enough = np.diff(begin) >= size
            for j in np.flatnonzero(~enough):
                least[at + j] = np.argsort(h[j], kind="stable")[:size]
            good = np.flatnonzero(enough)
            least[at + good] = col[begin[good][:, None] + np.arange(size)]
    kept = np.sort(least, axis=1)
    out = _mix(rows[:, 0].astype(np.uint64) + np.uint64(1))
    for j in range(size):
        out = _mix(out * _M + x[kept[:, j]])
    return (out >> np.uint64(32)).astype("<u4")


def _hashed(x: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Multiplication spreads values that are mixed already; their upper bits decide."""
    return x[None, :] * factors


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """The text with its last quarter replaced by the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (doc_id, text, bucket, ghost) so that each bucket holds a range of doc_id and the row after it.

    ``ghost`` rows are the copies; the first row of all follows the last. Ids alone are read for the bounds
    and the first rows; both are one value per bucket.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null")
    bounds = sorted(set(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    bounds = [int(b) for b in bounds]
    step = F.lit(0)
    if bounds:
        step = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("doc_id")))
    rows = docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(step).cast("int"))
    firsts = {r.bucket: (r.none, r.least) for r in rows.groupBy("bucket").agg(F.max(F.col("doc_id").isNull()).alias("none"), F.min("doc_id").alias("least")).collect()}
    order = sorted(firsts)
    ghosts = [(order[k - 1], order[k]) for k in range(len(order))]
    to = F.array().cast("array<int>")
    for before, bucket in ghosts:
        none, least = firsts[bucket]
        is_first = F.col("doc_id").isNull() if none else F.col("doc_id") == least
        to = F.when((F.col("bucket") == bucket) & is_first, F.array(F.lit(before))).otherwise(to)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    copies = F.transform(to, lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("ghost")))
    dealt = rows.select("doc_id", "text", F.explode(F.concat(F.array(own), copies)).alias("to")).select("doc_id", "text", "to.bucket", "to.ghost")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: fingerprints of every document and its edited text, and likeness to both neighbours."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return compare_neighbours(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def compare_neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """Per row of (doc_id, text): fingerprints of the text and its edited text, and the likenesses."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows_of(batches):
        """(bucket, ghost, doc_id, text, signature) in order; several ghosts of one id count once."""
        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("bucket", "ghost", "doc_id", "text")), strict=True):
                yield (*r, signature(r[3]))

    def out(made):
        cols = list(zip(*made, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches):
        made, held = [], None
        for row in rows_of(batches):
            if held is not None and held[0] == row[0]:
                made.append(finish(held, row))
            held = row if not row[1] else None
            if len(made) >= 2000:
                yield out(made)
                made = []
        if made:
            yield out(made)

    def finish(row, after):
        _, _, doc_id, text, own = row
        changed = edited(text, after[3])
        sig = signature(changed)
        return doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), sig.tobytes().hex(), likeness(own, sig), likeness(own, after[4])

    return in_ranges(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
