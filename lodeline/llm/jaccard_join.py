"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A text's set is its distinct shingles of five words (ASCII-lower-cased), as 64-bit hashes; texts of equal
sets are one node. All shingles have one global order, rarest first: by a table of fixed size that counts all shingles
of all documents by a slot of their hash, ties by hash. Two nodes of similarity t or more share a
shingle within the first n - ceil(t n) + 1 of each, and at their first shared one at places i and j
1 + min(n - i - 1, m - j - 1) reaches the overlap that t asks for. So postings of prefix shingles are dealt by
shingle, and pairs of a list pass the length and positional filters; the suffix filter then bounds the overlap of what
follows from three probes before the sets are intersected, once per pair.

A list first gives only the pairs with its hub, the node at which its shingle stands earliest (fewest rarer
shingles: of a group of near copies the one with the fewest changes of its own). After those are verified and contracted
to components, pairs within one component can't change the result; nodes outside their hub's
component are then held against the rest of their lists, by a join that keeps no list in memory. No link
between components is lost: the filters are exact and nothing is capped.

Passes over texts: counts and membership; postings; sets of candidate nodes. Texts are not shuffled unless the ids of
candidates are more than ``shared.BROADCAST_BYTES``.

Defined results: null or wordless texts have the empty set and link with nothing; texts of fewer than five
words have their whole sequence as one shingle; rows of equal doc_id count as texts of their own with that
id; null doc_ids link like others and lose to any id as a component's id; an empty table gives an empty
result; further columns are ignored. Sets and nodes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import checked_broadcast, held, lean, scratch_dir, stored
from .words import hashed_words, parts_of

WORDS, SIMILAR = 5, (4, 5)  # shingle length; the similarity as a fraction
#: Slots of the table of counts, the ranges it is summed in, and shingles that a task gathers before it sums its own.
SLOTS, RANGES, GATHER = 1 << 24, 16, 1_000_000
CACHE = 150_000
#: Bytes of text that are turned into sets at once.
PART = 4 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, given theirs."""
    total = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        total = total + mixed(h[j : j + len(total)] * _ROLL[j] + np.uint64(j)) * _ROLL[j]
    return mixed(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text, ascending."""
    held("shingles", dict)
    h, offsets = hashed_words(texts)
    whole, at = rolled(h, WORDS), offsets.tolist()
    for begin, end in zip(at, at[1:], strict=False):
        if end - begin >= WORDS:
            yield np.unique(whole[begin : end - WORDS + 1])
        else:
            yield rolled(h[begin:end], end - begin) if end > begin else np.zeros(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


def rare_first(s: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The set in the global order."""
    return s[np.argsort(rarity[s & np.uint64(SLOTS - 1)], kind="stable")]


def least_overlap(n, m):
    """The overlap that sets of n and m need: num (n + m) / (num + den), rounded up."""
    num, den = SIMILAR
    return -(-num * (n + m) // (num + den))


def prefix_length(n: int) -> int:
    num, den = SIMILAR
    return n - -(-num * n // den) + 1


def counted(slots: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(range, size, compressed slots and counts) of a task's shingles."""
    slot, count = np.unique(np.concatenate(slots), return_counts=True)
    width = SLOTS // RANGES
    cut = np.searchsorted(slot, np.arange(RANGES + 1) * width)
    for r in range(RANGES):
        part = slot[cut[r] : cut[r + 1]] - np.uint32(r * width)
        if len(part):
            raw = np.diff(part, prepend=np.uint32(0)).astype("<u4").tobytes() + np.minimum(count[cut[r] : cut[r + 1]], 0xFFFFFFFF).astype("<u4").tobytes()
            yield r, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def profile(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, node, n) of documents and rows (range, size, blob) of each task's counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("range", pa.int32()), ("size", pa.int64()), ("blob", pa.binary())])

    def rows(**given):
        length = max(len(v) for v in given.values())
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(length, f.type) for f in schema], schema=schema)

    def sums(slots):
        ranges, sizes, blobs = zip(*counted(slots), strict=True)
        return rows(range=ranges, size=sizes, blob=blobs)

    def run(batches: Iterator[pa.RecordBatch]):
        slots, held = [], 0
        for batch in (part for whole in batches for part in parts_of(whole, size=PART)):
            nodes, sizes = [], []
            for s in shingle_sets(batch["text"]):
                nodes.append(node_of(s) if len(s) else None)
                sizes.append(len(s))
                slots.append((s & np.uint64(SLOTS - 1)).astype(np.uint32))
                held += len(s)
                if held >= GATHER:
                    yield sums(slots)
                    slots, held = [], 0
            if batch.num_rows:
                yield rows(doc_id=batch["doc_id"].to_pylist(), text_hash=batch["text_hash"].to_pylist(), node=nodes, n=sizes)
        if held:
            yield sums(slots)

    return docs.mapInArrow(lean(run), "doc_id long, text_hash long, node long, n int, range int, size long, blob binary")


def rarity_of(made: DataFrame, root: str | None = None) -> np.ndarray:
    """For each slot eight times the logarithm of its count, in a byte. Ranges are summed by executors; the driver gets ``SLOTS`` bytes at any size."""
    width = SLOTS // RANGES

    def add(batches):
        at, total = None, np.zeros(width, np.int64)

        def out():
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "blob": [np.minimum(255, np.rint(8 * np.log2(1 + total))).astype(np.uint8).tobytes()]})

        for batch in batches:
            for r, size, blob in zip(batch["range"].to_pylist(), batch["size"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if r != at:
                    if at is not None:
                        yield out()
                    at, total = r, np.zeros(width, np.int64)
                raw = np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd"), "<u4")
                half = len(raw) // 2
                total[np.cumsum(raw[:half], dtype=np.int64)] += raw[half:]
        if at is not None:
            yield out()

    table = np.zeros(SLOTS, np.uint8)
    dealt = made.filter("range is not null").select("range", "size", "blob").repartition(RANGES, "range").sortWithinPartitions("range")
    # Written first and fetched a range at a time, so that the driver's heap never holds them all.
    for r in stored(dealt.mapInArrow(lean(add), "range int, blob binary"), "rarity", root).toLocalIterator():
        table[r.range * width : (r.range + 1) * width] = np.frombuffer(r.blob, np.uint8)
    return table


def postings(docs: DataFrame, rarity) -> DataFrame:
    """Rows (token, node, n, pos) of prefix shingles; a task gives each node once while it remembers it. ``rarity`` is a broadcast."""

    def run(batches):
        given, table = set(), rarity.value
        for batch in (part for whole in batches for part in parts_of(whole, size=PART)):
            tokens, nodes, sizes, places = [], [], [], []
            for s in shingle_sets(batch["text"]):
                if not len(s) or (node := node_of(s)) in given:
                    continue
                if len(given) >= CACHE:
                    given.clear()
                given.add(node)
                first = rare_first(s, table)[: prefix_length(len(s))]
                tokens.append(first)
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(s), np.int32))
                places.append(np.arange(len(first), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "node", "n", "pos"])

    return docs.select("text").mapInArrow(lean(run), "token long, node long, n int, pos int")


def with_hubs(batches):
    """Of postings sorted by token, place, size and node the lists of two nodes or more: each node once, beside its list's first node.

    Holds one row between batches, whatever the length of a list.
    """
    names = ["token", "node", "n", "pos"]
    hub_names = ["hub", "hub_n", "hub_pos"]
    held, held_hub, listed = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        new = np.ones(len(cols[0]), bool)
        new[1:] = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)
        cols = [c[new] for c in cols]
        same = np.diff(cols[0]) == 0
        keep = np.zeros(len(cols[0]), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= listed
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(keep)), 0))
        hubs = [c[begin] for c in cols[1:]]
        if held is not None:
            run = cols[0] == cols[0][0]  # continues the list of the row held
            for h, old in zip(hubs, held_hub, strict=True):
                h[run] = old
        held, held_hub, listed = [c[-1:] for c in cols], [h[-1] for h in hubs], bool(keep[-1])
        keep[-1] = False  # its turn comes with the next batch
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*cols, *hubs)], names=names + hub_names)
    if held is not None and listed:
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in held), *(pa.array([h], pa.array(c).type) for h, c in zip(held_hub, held[1:], strict=True))], names=names + hub_names)


def passing_rows(n, i, m, j) -> Column:
    """Length and positional filters for sizes n, m and places i, j (column names)."""
    num, den = SIMILAR
    need = f"(({num} * ({n} + {m}) + {num + den - 1}) div {num + den})"
    return F.expr(f"least({n}, {m}) * {den} >= greatest({n}, {m}) * {num} AND 1 + least({n} - {i} - 1, {m} - {j} - 1) >= {need}")


def suffix_apart(a: np.ndarray, b: np.ndarray, need: int) -> bool:
    """Whether sorted sets can't overlap enough: each probe splits both, and halves overlap by their smaller parts at most."""
    spots = a[[len(a) // 4, len(a) // 2, 3 * len(a) // 4]]
    cuts_a, cuts_b = np.searchsorted(a, spots), np.searchsorted(b, spots)
    parts_a = np.diff(cuts_a, prepend=0, append=len(a))
    parts_b = np.diff(cuts_b, prepend=0, append=len(b))
    return int(np.minimum(parts_a, parts_b).sum()) < need


def verify(batches):
    """Of rows (a, b, set_a, set_b) the pairs that link."""
    num, den = SIMILAR
    for batch in batches:
        a, b = [], []
        last, left = None, np.zeros(0, np.uint64)
        for x, y, p, q in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["set_a"], batch["set_b"], strict=True):
            if x != last:
                last, left = x, np.frombuffer(p.as_buffer(), np.uint64)
            right = np.frombuffer(q.as_buffer(), np.uint64)
            need = least_overlap(len(left), len(right))
            if suffix_apart(left, right, need):
                continue
            at = np.searchsorted(left, right)
            both = int((left[np.minimum(at, len(left) - 1)] == right).sum())
            if den * both >= num * (len(left) + len(right) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sets_of(docs: DataFrame, members: DataFrame, nodes: DataFrame, root: str, name: str) -> DataFrame:
    """Rows (node, s) of the sets of ``nodes``, made again from one document of each; some of other nodes may come along."""
    id_of = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    one = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(id_of(F.col("doc_id"))).alias("_id"))
    ids = checked_broadcast(stored(one.select("_id").distinct(), f"{name}-ids", root))
    texts = docs.withColumn("_id", id_of(F.col("doc_id"))).join(ids, "_id", "left_semi").select("text")

    def run(batches):
        for batch in (part for whole in batches for part in parts_of(whole, size=PART)):
            made = list(shingle_sets(batch["text"]))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else None for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["node", "s"])

    return texts.mapInArrow(lean(run), "node long, s binary")


def linked(docs: DataFrame, members: DataFrame, pairs: DataFrame, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (a, b), and those whose sets are similar enough; each is verified once.

    The sets of b go to those of a, so a is to be the side of fewer nodes.
    """
    pairs = stored(pairs.distinct(), f"{name}-pairs", root)
    few = stored(sets_of(docs, members, pairs.select(F.col("a").alias("node")).distinct(), root, f"{name}-a"), f"{name}-sets", root)
    many = sets_of(docs, members, pairs.select(F.col("b").alias("node")).distinct(), root, f"{name}-b")
    right = many.select(F.col("node").alias("b"), F.col("s").alias("set_b")).join(checked_broadcast(pairs), "b")
    whole = right.join(few.select(F.col("node").alias("a"), F.col("s").alias("set_a")), "a")
    return pairs, stored(whole.select("a", "b", "set_a", "set_b").mapInArrow(lean(verify), "a long, b long").distinct(), f"{name}-links", root)


def similar_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, node, root (of its component's nodes), n_shingles, component_id; text_hash if kept."""
    spark = docs.sparkSession
    root = scratch_dir(spark)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"))
    made = stored(profile(docs), "profile", root)
    members = made.filter("range is null").select("doc_id", "text_hash", "node", "n")
    rarity = spark.sparkContext.broadcast(rarity_of(made, root))
    order = ["token", "pos", "n", "node"]
    dealt = postings(docs, rarity).repartition("token").sortWithinPartitions(*order)
    # Only shingles of two nodes or more go on: the few that documents share.
    lists = stored(dealt.mapInArrow(lean(with_hubs), "token long, node long, n int, pos int, hub long, hub_n int, hub_pos int"), "lists", root)
    rarity.destroy()
    hubs = lists.filter("hub <> node").filter(passing_rows("n", "pos", "hub_n", "hub_pos")).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    tried, links = linked(docs, members, hubs, root, "first")
    found = stored(components(links), "found", root)
    roots = checked_broadcast(found)
    tagged = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tagged = tagged.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    # Nodes that are not in their hub's component; one beside its hub alone has been held against it.
    outside = stored(tagged.filter("root <> hub_root").select("token", F.col("node").alias("x"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("xroot")), "outside", root)
    rest = tagged.select("token", "node", "n", "pos", "root", "hub")
    across = outside.join(rest, "token").filter("root <> xroot and node <> hub").filter(passing_rows("n", "pos", "m", "at")).select(F.col("node").alias("a"), F.col("x").alias("b")).distinct()
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = stored(across.join(known, ["a", "b"], "left_anti").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "across", root)
    if not fresh.isEmpty():
        _, more = linked(docs, members, fresh, root, "more")
        if not more.isEmpty():
            found = components(links.unionByName(more))
    classes = members.join(found, "node", "left").select("doc_id", "text_hash", "node", "n", F.coalesce("root", "node").alias("root"))
    least = classes.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = classes.join(least, "root", "left")
    return out.select("doc_id", *["text_hash"] * keep_hash, "node", "root", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: the one of least doc_id, then least text hash. Rows with empty sets stay."""
    spark = docs.sparkSession
    names = docs.columns
    packed = docs.select(F.struct("*").alias("_doc"))
    rows = packed.select("_doc", F.col(f"_doc.`{doc_id}`").cast("long").alias("_id"), F.xxhash64(F.col(f"_doc.`{text}`")).alias("_hash"))
    groups = similar_groups(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash")), keep_hash=True)
    groups = stored(groups.filter("n_shingles > 0").select("doc_id", "text_hash", "root"), "groups")
    least = groups.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    gone = groups.join(least, "root").select("doc_id", "text_hash", (F.struct("doc_id", "text_hash") != F.col("first")).alias("other"), F.lit(True).alias("grouped"))
    fate = gone.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.max("other").alias("other"), F.count("*").alias("copies"))
    joined = rows.join(fate, rows["_id"].eqNullSafe(fate["_d"]) & (rows["_hash"] == fate["_h"]), "left")
    kept = joined.filter(F.col("other").isNull() | ~F.col("other"))
    # Repeated rows of the one that stays: the first of them.
    several = Window.partitionBy("_id", "_hash").orderBy(F.lit(0))
    once = kept.filter("copies > 1").withColumn("_n", F.row_number().over(several)).filter("_n = 1")
    single = kept.filter("copies is null or copies = 1")
    return single.select("_doc").unionByName(once.select("_doc")).select(*[F.col(f"_doc.`{c}`").alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_groups(docs).select("doc_id", "n_shingles", "component_id")
