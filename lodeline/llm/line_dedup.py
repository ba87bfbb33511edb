"""Line dedup as an exact set-similarity join, in DataFrame expressions alone.

A line's set is its distinct lower-cased words. A line goes if its set has a Jaccard similarity of 0.8 or more with
that of an earlier line. Lines without words stay.

Order: lines that are equal in lower case are one distinct line, whose first place is its least (doc_id, hash of the text,
line number); distinct lines are numbered along those. Of a distinct line only the first place can stay, and it stays unless
a similar distinct line has a lower number.

Words are 64-bit keys: their rarity class (power of two of the count of all words in their hash slot, of 1,048,576, over the
whole table) in the high bits, their hash below, so sorting keys is rarest-first and equal keys are equal words.
Similar lines of n and m words share one of the first n - ceil(0.8 n) + 1 of each (prefix filter); at their first
shared one at places i and j the overlap is 1 + min(n - i - 1, m - j - 1) at most (positional filter); lengths differ by
a fifth at most (length filter). A line also has the parities of its words' hashes in 128 slots: each word that only one
of two lines has changes one bit at most, so two lines whose parities differ in more bits than they may differ in words are
no pair (an exact bitmap filter). With 64 slots one in four pairs of a similarity of 0.7 would pass, as copies of one line with edits of their
own have, and those grow with the square of their number. Of a line's pairs the one whose parities differ least is verified, by intersecting
the sets; only lines that it leaves unmatched are held against the rest, by 256 more parities first.

Sets of up to four words are similar only if they are equal, or if one of four lies in one of five. So
lines of up to four words are grouped by the hash of their set, and a line of five joins the groups of its five
subsets of four; whether a line goes follows from the earliest of each size in its groups, without pairs.

Lists of a word: up to ``SMALL`` lines give all their pairs that pass. Longer lists, as of large groups of near copies, first
give the pairs with their earliest line, and only lines without a match are then held against the rest of their lists. A
word's class bounds the length of its list, so the lists that could be longest are dealt over several tasks by the
line's number, each part with an earliest line of its own. Nothing is capped.

Disk: shuffles go when what they were for is written, and a stored table goes when its successors stand.

Defined results: null texts stay null and have no lines; empty texts have one empty line, which stays; rows of one
(doc_id, text) are one place, so repeated rows keep and lose the same lines; a null doc_id comes first; a long text is
its lines, of any number; an empty table gives an empty result; further columns are kept by ``dedup`` and not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import SPACE, checked_broadcast, discard, scratch_dir, stored

#: The similarity as a fraction.
NUM, DEN = 4, 5
#: ``later_lines`` starts here unless told otherwise; sets of fewer words are grouped whole.
LEAST_WORDS = 5
#: Slots of the rarity table, a constant of this size in the plan.
SLOTS = 1 << 20
#: Slots that share a number of the table, with so many bits each.
PER_LONG, CLASS_BITS = 16, 4
SMALL = 512
#: Words of this class and above have their lists dealt over parts of up to 2 ** SALT_FROM lines.
SALT_FROM = 14


def words_of(line: Column) -> Column:
    """The words, and perhaps empty strings, of a text. Spaces alone are split at without a regular expression."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\n")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")) | F.contains(line, F.lit("\r"))
    return F.when(odd, F.split(line, SPACE)).otherwise(F.split(line, " "))


def rarity_classes(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each of ``SLOTS`` hash slots the class of the words that fall in it, and the power of two that class 0 stands for.

    A class is a power of two of the slot's count; what is rarer than a quarter of a slot's mean share is class 0, as it can't be told from
    what else falls in the slot. A row per slot and task is shuffled, a row per slot collected.
    """
    lines = docs.select(F.explode_outer(F.split(F.lower("text"), "\n")).alias("line"))
    words = lines.select(F.explode_outer(words_of(F.col("line"))).alias("w")).filter("w <> ''")
    counts = words.select(F.xxhash64("w").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).groupBy("slot").agg(F.count("*").alias("c"))
    found = counts.toArrow()
    n = np.zeros(SLOTS, np.int64)
    n[found["slot"].to_numpy()] = found["c"].to_numpy()
    least = max(0, int(np.log2(max(1, n.sum() / SLOTS))) - 2)
    return np.clip(np.log2(np.maximum(n, 1)).astype(np.int64) - least, 0, (1 << CLASS_BITS) - 1), least


def packed(classes: np.ndarray) -> list[int]:
    """``PER_LONG`` classes in a number, the first lowest."""
    return (classes.reshape(-1, PER_LONG).astype(np.uint64) << np.arange(0, 64, CLASS_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def apart(df: DataFrame, name: str, array: Column) -> DataFrame:
    """``df`` with an array as column ``name``, exploded from an array of one: what follows reads it and can't be merged with what makes it. Below a
    lambda function array functions are interpreted and make an object of each number; apart from it they are compiled."""
    return df.select(*[c for c in df.columns if c != name], F.explode_outer(F.array(array)).alias(name))


def with_keys(df: DataFrame, classes: np.ndarray) -> DataFrame:
    """``df`` with the set of its lower-cased ``line``, rarest first, as ``keys`` in the line's place. The table of classes is a constant of fixed size."""
    table = F.split(F.lit(",".join(map(str, packed(classes)))), ",").cast("array<bigint>")
    right = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    # Never null, so that numbers are sorted and not objects.
    at = lambda h: F.coalesce(F.get(table, F.shiftright(h, 4).bitwiseAND(SLOTS // PER_LONG - 1).cast("int")), F.lit(0).cast("long"))
    of = lambda h: right(at(h), F.shiftleft(h.bitwiseAND(PER_LONG - 1).cast("int"), 2)).bitwiseAND((1 << CLASS_BITS) - 1)
    key = lambda h: F.shiftleft(of(h), 58).bitwiseOR(F.shiftrightunsigned(h, 6))
    df = apart(df, "keys", F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))).drop("line")
    df = apart(df, "keys", F.array_remove(F.array_distinct("keys"), F.xxhash64(F.lit(""))))
    df = apart(df, "keys", F.transform("keys", key))
    return apart(df, "keys", F.sort_array("keys"))


def parities(keys: Column, part: int, bits: int, skip: int = 0) -> Column:
    """64 bits, each the parity of how many keys fall in its slot; of 2 ** ``bits`` such parts, told apart by the bits after the first ``skip``, one."""
    part_of = lambda k: (F.shiftright(k, skip) if skip else k).bitwiseAND((1 << bits) - 1)
    one = lambda k: (part_of(k) == part).cast("long") if bits > 1 else part_of(k) if part else part_of(k).bitwiseXOR(1)
    bit = lambda k: F.call_function("shiftleft", one(k), F.shiftright(k, skip + bits).bitwiseAND(63).cast("int"))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(bit(k)))


def needed(n: str) -> Column:
    """ceil(0.8 n)."""
    return F.expr(f"({NUM} * {n} + {DEN - 1}) div {DEN}").cast("int")


def least_common(n: str, m: str) -> str:
    """The words that similar sets of n and m have in common at least."""
    return f"(({NUM} * ({n} + {m}) + {NUM + DEN - 1}) div {NUM + DEN})"


def over(a: str, b: str) -> Column:
    """By how many bits the parities of rows (n, even, odd) named by two prefixes differ more than similar sets' may: over 0 for no pair."""
    return F.expr(f"cast(bit_count({a}even ^ {b}even) + bit_count({a}odd ^ {b}odd) - ({a}n + {b}n - 2 * {least_common(a + 'n', b + 'n')}) as int)")


def passing(a: str, b: str) -> Column:
    """Length, positional and bitmap filters of rows (n, pos, even, odd) named by two prefixes."""
    fits = F.expr(f"least({a}n, {b}n) * {DEN} >= greatest({a}n, {b}n) * {NUM} AND 1 + least({a}n - {a}pos - 1, {b}n - {b}pos - 1) >= {least_common(a + 'n', b + 'n')}")
    return fits & (over(a, b) <= 0)


def numbered(docs: DataFrame) -> DataFrame:
    """Rows (place, lid, line) of all lines, in lower case; place is a struct(doc_id, text_hash, line_no)."""
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select(F.struct("doc_id", "text_hash", "line_no").alias("place"), F.lower("line").alias("line")).withColumn("lid", F.xxhash64("line"))


def distinct_lines(docs: DataFrame, classes: np.ndarray, least_words: int) -> DataFrame:
    """Rows (no, lid, place, copies, n, even, odd, first): distinct lines in order, with the keys that their signatures need."""
    sets = with_keys(numbered(docs), classes).withColumn("n", F.size("keys")).filter(F.col("n") >= least_words)
    wanted = F.when(F.col("n") <= LEAST_WORDS, F.col("keys")).otherwise(F.slice("keys", F.lit(1), F.col("n") - needed("n") + 1))
    rows = sets.select("lid", "place", "n", parities(F.col("keys"), 0, 1).alias("even"), parities(F.col("keys"), 1, 1).alias("odd"), wanted.alias("first"))
    once = rows.groupBy("lid").agg(F.min("place").alias("place"), F.count("*").alias("copies"), F.first(F.struct("n", "even", "odd", "first")).alias("set"))
    flat = once.select("lid", "place", "copies", "set.*")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(f"place.{c}").asc_nulls_first() for c in ("doc_id", "text_hash", "line_no")]
    return flat.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("no"), "*")


def prefix_words(lines: DataFrame, least: int) -> DataFrame:
    """Rows (key, part, no, n, pos, even, odd) of prefix words; ``part`` is -1 but for words whose lists are dealt. ``least``: what class 0 stands for."""
    prefix = F.slice("first", F.lit(1), F.col("n") - needed("n") + 1)
    rows = lines.filter(F.col("n") >= LEAST_WORDS).select("no", "n", "even", "odd", F.posexplode_outer(prefix).alias("pos", "key"))
    level = F.shiftright("key", 58).cast("int") + least
    parts = F.call_function("shiftleft", F.lit(1).cast("long"), level - (SALT_FROM - 1))
    part = F.when(level >= SALT_FROM, F.pmod(F.col("no"), parts)).otherwise(F.lit(-1).cast("long"))
    return rows.select("key", part.alias("part"), "no", "n", "pos", "even", "odd")


def may_be_long(least: int) -> Column:
    """Whether the list of a word that isn't dealt may be longer than ``SMALL``: it is shorter than twice the power of two that its class stands for."""
    level = F.shiftright("key", 58).cast("int") + least
    return (F.col("part") < 0) & (F.call_function("shiftleft", F.lit(1).cast("long"), level + 1) - 1 > SMALL)


def with_heads(words: DataFrame) -> DataFrame:
    """``words`` and ``head``, the earliest line of their list or part of one where it may match, with ``over`` of the two."""
    along = Window.partitionBy("key", "part")
    rows = words.withColumn("h", F.min(F.struct("no", "n", "pos", "even", "odd")).over(along))
    return rows.withColumn("head", F.when((F.col("h.no") < F.col("no")) & passing("", "h."), F.struct(F.col("h.no").alias("no"), over("", "h.").alias("over")))).drop("h")


def pairs_within(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Distinct (no, earlier, over) that share a word and pass the filters."""
    a, b = (df.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("no", "n", "pos", "even", "odd")]) for df, p in ((later, "a"), (earlier, "b")))
    found = a.join(b, "key").filter(F.col("b_no") < F.col("a_no")).filter(passing("a_", "b_"))
    return found.select(F.col("a_no").alias("no"), F.col("b_no").alias("earlier"), over("a_", "b_").alias("over")).distinct()


def verified(pairs: DataFrame, docs: DataFrame, lines: DataFrame, root: str, name: str, *, rough: bool = False) -> DataFrame:
    """Of the pairs (no, earlier) those that are similar, as distinct no. Where many pairs share a line, ``rough`` holds 256 parities, which are a few
    bytes, against each other before the sets are brought to the pairs that are left."""
    ids = pairs.select(F.explode(F.array("no", "earlier")).alias("no")).distinct()
    keys = stored(sets_again(docs, ids.join(lines.select("no", "place"), "no"), root, name), f"{name}-keys", root)
    pairs = pairs.select("no", "earlier")
    if rough:
        sig = keys.select("no", F.size("keys").alias("n"), *[parities(F.col("keys"), k, 2, 20).alias(f"p{k}") for k in range(4)])
        sig = stored(sig, f"{name}-sig", root)
        a, b = (sig.select(F.col("no").alias(no), *[F.col(c).alias(f"{p}_{c}") for c in ("n", "p0", "p1", "p2", "p3")]) for no, p in (("no", "a"), ("earlier", "b")))
        differ = " + ".join(f"bit_count(a_p{k} ^ b_p{k})" for k in range(4))
        close = pairs.join(b, "earlier").join(a, "no").filter(F.expr(f"{differ} <= a_n + b_n - 2 * {least_common('a_n', 'b_n')}"))
        pairs = stored(close.select("no", "earlier"), f"{name}-close", root)
    mine, theirs = keys.select("no", F.col("keys").alias("mine")), keys.select(F.col("no").alias("earlier"), F.col("keys").alias("theirs"))
    both = pairs.join(theirs, "earlier").join(mine, "no")
    common = F.size(F.array_intersect("mine", "theirs"))
    similar = both.filter(common * DEN >= (F.size("mine") + F.size("theirs") - common) * NUM)
    out = stored(similar.select("no").distinct(), f"{name}-matched", root)
    discard(lines.sparkSession, root, f"{name}-keys", f"{name}-wanted", f"{name}-sig", f"{name}-close")
    return out


def sets_again(docs: DataFrame, lines: DataFrame, root: str, name: str) -> DataFrame:
    """Rows (no, keys), the sets as hashes, of given lines (no, place), from the texts that hold them."""
    wanted = lines.groupBy(F.col("place.doc_id").alias("_id"), F.col("place.text_hash").alias("_hash")).agg(F.collect_list(F.struct("place.line_no", "no")).alias("wanted"))
    wanted = checked_broadcast(stored(wanted, f"{name}-wanted", root), 128)
    texts = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["text_hash"] == wanted["_hash"])).withColumn("all", F.split("text", "\n"))
    each = found.select(F.explode_outer(F.transform("wanted", lambda w: F.struct(w["no"].alias("no"), F.lower(F.get("all", w["line_no"])).alias("line")))).alias("x"))
    hashes = apart(each.select("x.no", "x.line"), "keys", F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)))
    return hashes.select("no", F.array_remove(F.array_distinct("keys"), F.xxhash64(F.lit(""))).alias("keys")).dropDuplicates(["no"])


def later_short(lines: DataFrame) -> DataFrame:
    """Of lines of up to five words those (no) that go: an equal set, or four of five words, came earlier."""
    few = F.col("n") < LEAST_WORDS
    fours = F.transform("first", lambda _, i: F.xxhash64(F.filter("first", lambda _, j: i != j)))
    sets = lines.filter(F.col("n") <= LEAST_WORDS).select("no", "n", F.explode(F.when(few, F.array(F.xxhash64("first"))).otherwise(fours)).alias("sig"))
    earliest = sets.groupBy("sig").agg(F.min(F.when(few, F.col("no"))).alias("few"), F.min(F.when(~few, F.col("no"))).alias("five"))
    return sets.join(earliest, "sig").filter((F.col("few") < F.col("no")) | (few & (F.col("five") < F.col("no")))).select("no").distinct()


def later_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, text_hash, removed): the line numbers that go, of texts (doc_id, text) that lose any."""
    least_words = max(1, least_words)
    spark = docs.sparkSession
    root = scratch_dir(spark)
    classes, least = rarity_classes(docs)
    lines = stored(distinct_lines(docs, classes, least_words), "lines", root)
    words = prefix_words(lines, least)
    counted = words.filter(may_be_long(least)).groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > SMALL)
    many = checked_broadcast(stored(counted.select("key"), "many", root))
    short = words.filter("part < 0").join(many, "key", "left_anti")
    long = stored(with_heads(words.filter(may_be_long(least)).join(many, "key", "left_semi").unionByName(words.filter("part >= 0"))), "long", root)
    with_head = long.filter("head is not null").select("no", F.col("head.no").alias("earlier"), F.col("head.over").alias("over"))
    pairs = stored(pairs_within(short, short).unionByName(with_head).distinct(), "pairs", root)
    # Any one similar line decides: each line is held against its likeliest candidate, the unmatched ones then against the others.
    likeliest = stored(pairs.groupBy("no").agg(F.min(F.struct("over", "earlier")).alias("b")).select("no", "b.earlier"), "likeliest", root)
    matched = verified(likeliest, docs, lines, root, "first")
    others = stored(pairs.join(matched, "no", "left_anti").join(likeliest, ["no", "earlier"], "left_anti"), "others", root)
    if not others.isEmpty():
        matched = stored(matched.unionByName(verified(others, docs, lines, root, "second", rough=True)), "matched", root)
    discard(spark, root, "others", "likeliest")
    if not long.isEmpty():
        left = long.join(matched, "no", "left_anti")
        more = stored(pairs_within(left, long).join(pairs, ["no", "earlier"], "left_anti"), "more", root)
        discard(spark, root, "long", "pairs")
        if not more.isEmpty():
            matched = matched.unionByName(verified(more, docs, lines, root, "more", rough=True))
    if least_words < LEAST_WORDS:
        matched = matched.unionByName(stored(later_short(lines), "matched-short", root))
    gone = lines.join(matched.distinct().withColumn("gone", F.lit(True)), "no", "left").filter("gone or copies > 1")
    fate = gone.select("lid", F.when(F.col("gone").isNull(), F.col("place")).alias("only"))
    doomed = numbered(docs).select("lid", "place").join(fate, "lid").filter("only is null or place <> only")
    return doomed.groupBy("place.doc_id", "place.text_hash").agg(F.array_sort(F.collect_set("place.line_no")).alias("removed"))


def dedup(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` in a struct ``doc``, its text without later lines as ``kept_text``, and ``n_lines``, ``n_removed``."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gone = later_lines(narrow, least_words=1).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "removed")
    gone = checked_broadcast(stored(gone, "removed", scratch_dir(spark)), 128)
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col(f"doc.`{doc_id}`").alias("_doc_id"), F.col(f"doc.`{text}`").alias("_text"))
    joined = rows.join(gone, rows["_doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64("_text") == gone["_hash"]), "left")
    cut = joined.withColumn("_lines", F.split("_text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("removed"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return cut.select(
        "doc",
        F.when(F.col("removed").isNull(), F.col("_text")).otherwise(kept).alias("kept_text"),
        F.coalesce(F.when(F.col("_text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("removed").isNotNull(), F.size("removed")), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document with the lines it loses and the hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))
