"""Token ids as compact binary files.

Documents are tokenised, an end id is appended to each, and the ids are written in ascending doc_id order as
range-partitioned files of rANS blocks (``rans``) that share one frequency table. A file has

    b"LTOK" version  |  blocks  |  index  |  length of the index, its CRC-32, b"LEND"

and its index (zlib) holds a checkpoint per block (byte offset, ids before it) and the documents (doc_id,
ids). A reader may start at any checkpoint; each block carries a checksum of its ids.

Texts are dealt by ranges of doc_id (the only shuffle), sorted and tokenised; each task keeps its ids in a file
and counts them (a row per id and task, summed: bounded by the vocabulary). With the common table a second step codes each of
those files. A task writes its file under a name of its own and then renames it, so a retried task replaces it whole.
Files go to the folder that the cluster shares, by the file system its URI names.

Tokenising is by word: the tokenizer never joins over white space, so a batch of texts is split and its words told apart by
Arrow, distinct words are encoded once by the library and remembered, and the ids of all places are gathered at once.

A file is read back by ranges of blocks, a task each: a task starts at the checkpoint of its first block and passes over the
rest of a document that began before it; who has a document's first id decodes it to its end, also into later ranges.

Defined results: null and empty texts are the end id alone; a null doc_id is first; rows of equal doc_id go by
text; repeated rows are written again; a text of any length is one document; an empty table writes no files; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .shared import held, lean, scratch_dir, stored
from .words import coded_words, parts_of, strings_of

END_ID = 2
#: Words of a generation; bytes of text in a chunk.
CACHE, CHUNK = 700_000, 4 << 20
#: Blocks that a task reads back.
READ_BLOCKS = 8


class WordIds(dict):
    """Ids of a word as bytes of little-endian unsigned 16-bit integers, by the tokenizers library.

    Two generations of words are kept: when the younger is full the older goes, and words met again move to the younger.
    """

    @classmethod
    def of(cls, path: str) -> WordIds:
        """This process's own; Spark's Python workers serve many tasks."""
        return held(("word ids", path), lambda: cls(path))

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("this format has ids of 16 bits")
        self.marks: dict[str, bytes] = {}
        self.encode([".", ","], self.marks)

    def learn(self, words: set[str]) -> None:
        if len(self) + len(words) > CACHE:
            self.old = dict(self)
            self.clear()
        # A Latin word of letters alone reads as in lower case, and a point or comma after it is a token of its own.
        simple: dict[str, tuple[str, bytes]] = {}
        old, marks = self.old, self.marks
        for w in words:  # set operations would pass over all words that are remembered
            if w in self:
                continue
            if (ids := old.get(w)) is not None:
                self[w] = ids
                continue
            base, mark = (w[:-1], marks[w[-1]]) if w[-1] in marks else (w, b"")
            simple[w] = (base.lower(), mark) if base.isalpha() and (base.isascii() or max(base) < "\u0250") else (w, b"")
        bases = {b for b, _ in simple.values()}
        known = {b: x for b in bases if (x := self.get(b) or self.old.get(b)) is not None}
        self.encode(list(bases.difference(known)), known)
        for w, (b, mark) in simple.items():
            self[w] = known[b] + mark if mark else known[b]

    def encode(self, new: list[str], out: dict[str, bytes]) -> None:
        """Ids of words, in one call for many; words are told apart by where their characters stand."""
        for k in range(0, len(new), 2048):
            part = new[k : k + 2048]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(w) + 1 for w in part)])
            at = np.fromiter((o[0] for o in found.offsets), np.int64, len(found))
            cut = np.searchsorted(at, begins) * 2
            raw = np.array(found.ids, "<u2").tobytes()
            for w, b, e in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                out[w] = raw[b:e]

    def ids(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ``end`` after each; how many each has)."""
        codes, offsets, words = coded_words(texts, lower=False)
        strings = strings_of(words)
        parts = list(map(self.get, strings))
        if new := {w for w, x in zip(strings, parts, strict=True) if x is None and w}:
            self.learn(new)
        parts = [x if x is not None else self[w] if w else b"" for w, x in zip(strings, parts, strict=True)]
        parts.append(end)
        codes = np.insert(codes, offsets[1:], len(words))
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
        begin = np.cumsum(length) - length
        many = length[codes]
        ends = np.cumsum(many)
        ids = np.frombuffer(b"".join(parts), "<u2")[np.repeat(begin[codes] - ends + many, many) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(ends[offsets[1:] + np.arange(len(texts))], prepend=0)


def place(root: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(root if "://" in root or root.startswith("/") else root.replace("file:", "file://", 1))
    return fs, path


def put(root: str, name: str, chunks) -> None:
    """Writes a file whole: under another name first, then renamed."""
    fs, path = place(root)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
        for c in chunks:
            out.write(c)
    fs.move(part, f"{path}/{name}")


def get(root: str, name: str) -> pa.NativeFile:
    fs, path = place(root)
    return fs.open_input_file(f"{path}/{name}")


def tokenised(batches, words: WordIds, end_id: int, counts: np.ndarray, totals: dict):
    """Yields the documents of a partition as chunks of compressed ids; ``counts`` and ``totals`` are filled on the way.

    A chunk has its documents' ids, which of those are null, their lengths and all their token ids.
    """
    end = np.array([end_id], "<u2").tobytes()
    totals |= {"n_ids": 0, "n_docs": 0}
    for batch in (part for whole in batches for part in parts_of(whole, size=CHUNK)):
        own = batch["doc_id"].to_pylist()
        ids, lengths = words.ids(batch["text"], end)
        counts += np.bincount(ids, minlength=len(counts))
        totals["n_ids"] += len(ids)
        totals["n_docs"] += len(own)
        raw = np.array([0 if d is None else d for d in own], "<i8").tobytes() + np.array([d is None for d in own], "u1").tobytes() + lengths.astype("<u8").tobytes() + ids.astype("<u2").tobytes()
        packed = pa.compress(raw, codec="zstd", asbytes=True)
        yield struct.pack("<QQQ", len(own), len(raw), len(packed)) + packed


def read_chunks(f: pa.NativeFile):
    """(doc ids, which are null, lengths, ids) of each chunk."""
    while head := f.read(24):
        n, size, packed = struct.unpack("<QQQ", head)
        raw = pa.decompress(f.read(packed), decompressed_size=size, codec="zstd", asbytes=True)
        yield np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n), np.frombuffer(raw, "<u8", n, 9 * n), np.frombuffer(raw, "<u2", -1, 17 * n)


def encoded_file(table: rans.Table, chunks):
    """Yields the bytes of one file."""
    yield b"LTOK\x01\x00\x00\x00"
    at, n_ids, waiting = 8, 0, np.zeros(0, "<u2")
    docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    points: list[tuple[int, int]] = []

    def block(ids: np.ndarray) -> bytes:
        nonlocal at, n_ids
        raw = table.encode(ids)
        points.append((at, n_ids))
        at, n_ids = at + len(raw), n_ids + len(ids)
        return raw

    for doc_ids, nulls, lengths, ids in chunks:
        docs.append((doc_ids, nulls, lengths))
        waiting = np.concatenate([waiting, ids])
        while len(waiting) >= rans.BLOCK:
            yield block(waiting[: rans.BLOCK])
            waiting = waiting[rans.BLOCK :]
    if len(waiting):
        yield block(waiting)
    doc_ids, nulls, lengths = (np.concatenate(x) for x in zip(*docs, strict=True))
    index = struct.pack("<QQ", len(points), len(lengths)) + np.array(points, "<u8").tobytes() + doc_ids.tobytes() + nulls.tobytes() + lengths.tobytes()
    index = zlib.compress(index, 6)
    yield index + struct.pack("<QI", len(index), zlib.crc32(index)) + b"LEND"


def read_index(f: pa.NativeFile):
    """(checkpoints as rows of offset and ids before, doc ids, which of them are null, ids of each)."""
    size = f.size()
    f.seek(size - 16)
    length, crc, mark = struct.unpack("<QI4s", f.read(16))
    f.seek(size - 16 - length)
    raw = f.read(length)
    if mark != b"LEND" or zlib.crc32(raw) != crc:
        raise ValueError("not a token file, or damaged")
    raw = zlib.decompress(raw)
    p, d = struct.unpack_from("<QQ", raw)
    points = np.frombuffer(raw, "<u8", 2 * p, 16).reshape(p, 2)
    ids = np.frombuffer(raw, "<i8", d, 16 + 16 * p)
    nulls = np.frombuffer(raw, "u1", d, 16 + 16 * p + 8 * d).astype(bool)
    return points, ids, nulls, np.frombuffer(raw, "<u8", d, 16 + 16 * p + 9 * d), size - 16 - length


def read_blocks(f: pa.NativeFile, table: rans.Table, first: int = 0, last: int | None = None, index=None):
    """Decodes the blocks first ... last - 1 of a file, each from its checkpoint."""
    points, *_, stop = index or read_index(f)
    ends = [*(int(o) for o, _ in points[1:]), stop]
    for k in range(first, len(points) if last is None else last):
        f.seek(int(points[k][0]))
        yield table.decode(f.read(ends[k] - int(points[k][0])))


def read_documents(f: pa.NativeFile, table: rans.Table, first: int, last: int):
    """(place of the first, doc ids, which are null, ids before each, lengths, crc32 of each) of the documents that begin in blocks first ... last - 1."""
    index = read_index(f)
    points, ids, nulls, lengths, _ = index
    n = lengths.astype(np.int64)
    ends = np.cumsum(n)
    begins = ends - n
    before = [*points[:, 1].astype(np.int64).tolist(), int(ends[-1]) if len(ends) else 0]
    low, high = np.searchsorted(begins, [before[first], before[min(last, len(points))]])
    at, doc, crc, crcs = before[first], int(low), 0, np.zeros(high - low, np.int64)
    for block in read_blocks(f, table, first, index=index) if high > low else ():
        raw, k = block.astype("<u4").data.cast("B"), max(0, min(len(block), int(begins[doc]) - at))
        while k < len(block) and doc < high:
            take = min(int(ends[doc]) - at - k, len(block) - k)
            crc = zlib.crc32(raw[4 * k : 4 * (k + take)], crc)
            k += take
            if at + k == ends[doc]:
                crcs[doc - low], crc, doc = crc, 0, doc + 1
        at += len(block)
        if doc == high:
            break
    if doc != high:
        raise ValueError(f"{doc - low} of {high - low} documents are whole")
    return int(low), ids[low:high], nulls[low:high], begins[low:high], n[low:high], crcs


def write_tokens(docs: DataFrame, tokenizer: str, root: str, *, end_id: int = END_ID, files: int | None = None) -> list[tuple[str, int, int]]:
    """Writes all documents (columns doc_id, text) under ``root``: (file, ids, documents) in order, a row per file."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def tokenise(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        name, counts, totals = f"part-{TaskContext.get().partitionId():06d}", np.zeros(1 << 16, np.int64), {}
        put(root, f"{name}.ids", tokenised(rest(), WordIds.of(tokenizer), end_id, counts, totals))
        seen = np.flatnonzero(counts)
        none = pa.nulls(len(seen), pa.int64())
        yield pa.RecordBatch.from_pydict({"file": [name], "n_ids": [totals["n_ids"]], "n_docs": [totals["n_docs"]], "id": pa.array([None], pa.int32()), "n": pa.array([None], pa.int64())})
        yield pa.RecordBatch.from_arrays([none.cast(pa.string()), none, none, pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["file", "n_ids", "n_docs", "id", "n"])

    made = stored(dealt.mapInArrow(lean(tokenise), "file string, n_ids long, n_docs long, id int, n long"), "made", root)
    counts = np.zeros(1 << 16, np.int64)
    for r in made.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id of the vocabulary
        counts[r.id] = r.n
    put(root, "table.bin", [rans.Table.of(counts).dump()])
    rows = sorted((r.file, r.n_ids, r.n_docs) for r in made.filter("file is not null").select("file", "n_ids", "n_docs").collect())

    def encode(batches):
        with get(root, "table.bin") as f:
            table = rans.Table.load(f.read())
        for batch in batches:
            for name in batch["file"].to_pylist():
                with get(root, f"{name}.ids") as f:
                    put(root, f"{name}.ltok", encoded_file(table, read_chunks(f)))
            yield batch

    if rows:
        names = spark.createDataFrame([(k, n) for k, (n, *_) in enumerate(rows)], "no int, file string").repartition(len(rows), "no").select("file")
        names.mapInArrow(lean(encode), "file string").count()
        fs, path = place(root)
        for name, *_ in rows:  # what was kept for the second step
            fs.delete_file(f"{path}/{name}.ids")
    return [(f"{name}.ltok", n_ids, n_docs) for name, n_ids, n_docs in rows]


def read_tokens(spark: SparkSession, root: str, files: list[tuple[str, int, int]], blocks: int = READ_BLOCKS) -> DataFrame:
    """Reads the files back, a task for each run of ``blocks`` blocks: doc_id, start, n_tokens, ids_crc32."""
    placed, start = [], 0
    for name, n_ids, _ in files:
        placed += [(len(placed) + k, name, start, k * blocks) for k in range(max(1, -(-n_ids // (rans.BLOCK * blocks))))]
        start += n_ids
    rows = spark.createDataFrame(placed, "no int, file string, start long, first int").repartitionByRange(max(1, len(placed)), "no")

    def read(batches):
        table = None
        for batch in batches:
            for name, start, first in zip(*(batch[c].to_pylist() for c in ("file", "start", "first")), strict=True):
                if table is None:
                    with get(root, "table.bin") as f:
                        table = rans.Table.load(f.read())
                with get(root, name) as f:
                    _, ids, nulls, begins, n, crcs = read_documents(f, table, first, first + blocks)
                for k in range(0, len(ids), 10_000):
                    s = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64(), mask=nulls[s]), pa.array(start + begins[s]), pa.array(n[s]), pa.array(crcs[s])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """op5: all documents written as token files and read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    root = scratch_dir(spark)
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer, root)
    return read_tokens(spark, root, files)
