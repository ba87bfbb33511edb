r"""License scans by diagonal voting.

A text's words are the runs of ASCII letters, digits and non-ASCII characters of its lower-cased form. All
rolling word pairs of all texts are hashed and joined to the positions that those pairs have in the license
templates. A hit at text position p and template position t votes for the diagonal p - t. Votes are gathered
as bit masks per (text, template, diagonal) with partial aggregation, so a frequent pair never gathers in one
task. A phrase, and a template of fewer than ``LONG`` pairs, is a place where every pair of it voted on one diagonal. For longer
templates neighbouring diagonals (``SLACK`` apart: a word put in or left out) are merged where together they have ``COVER`` of the pairs,
and the span is verified: a bit of a diagonal's mask is a pair of the template at a known place of the text, so the most pairs
that follow each other in the template and in the text, each at most ``SLACK`` diagonals from the one before, are
found by dynamic programming over the hits in text order; they must be ``COVER`` of all pairs. Phrases of this size (at most 63 pairs) need no further comparison than the 64-bit hashes that are
seeded by both words.

The template table is a fixed list below, which is why it may be broadcast: its size doesn't depend on the data.

Defined results: null and empty texts have no words and no labels; several rows of one (doc_id, text)
each get the result of that text; a null doc_id is a key like any other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public license wordings that add labels of their own.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the apache license version 2 0": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-text",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "mozilla public license": "mpl",
    "released into the public domain": "public-domain",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "all rights reserved": "all-rights-reserved",
}
#: Share of a template's pairs that must vote.
COVER = 0.8
#: Diagonals so near each other are merged.
SLACK = 3
#: Java pattern of what stands between words after lower-casing. (Splitting takes linear time; Spark's regexp_extract_all
#: copies the whole text for each match.)
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: From so many pairs on a template may be covered in part; shorter ones must stand whole.
LONG = 12


def words_of(text: Column) -> Column:
    """Words of the lower-cased text.

    Full lower-casing maps every letter to word characters again, so the words' number and places are those of
    lower-casing A-Z alone; no phrase holds a letter (k, i with dot, a with ring) that non-ASCII letters become.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def template_pairs(spark: SparkSession) -> DataFrame:
    """Rows (template, tpos, bit, h) of the fixed lists."""
    rows = [(i, phrase.split()) for i, phrase in enumerate([*PHRASES, *TEMPLATES])]
    flat = [(i, t, 1 << t, w[t], w[t + 1]) for i, w in rows for t in range(len(w) - 1)]
    made = spark.createDataFrame(flat, "template int, tpos int, bit long, a string, b string")
    return made.select("template", "tpos", "bit", pair_hash(F.col("a"), F.col("b")).alias("h"))


def template_table(spark: SparkSession) -> DataFrame:
    """Rows (template, label, base, n_pairs)."""
    rows = [(i, label, i < len(PHRASES), len(phrase.split()) - 1) for i, (phrase, label) in enumerate([*PHRASES.items(), *TEMPLATES.items()])]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_pairs int")


def longest_chain(votes: Column, n_pairs: Column, slack: int) -> Column:
    """struct<n, start> of array<struct<diagonal, mask>>: the most hits in one order in template and text, and the diagonal of the first."""
    places = lambda v: F.filter(F.sequence(F.lit(0), n_pairs.cast("int") - 1), lambda t: F.getbit(v["mask"], t) == 1)
    hits = F.array_sort(F.flatten(F.transform(votes, lambda v: F.transform(places(v), lambda t: F.struct((v["diagonal"] + t).cast("long").alias("p"), t.cast("long").alias("t"))))))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("start"))
    begin = F.struct(none.alias("best"), F.array().cast("array<struct<p:bigint,t:bigint,n:bigint,start:bigint>>").alias("recent"))

    def add(acc: Column, h: Column) -> Column:
        recent = F.filter(acc["recent"], lambda x: x["p"] >= h["p"] - n_pairs - slack)
        before = F.filter(recent, lambda x: (x["p"] < h["p"]) & (x["t"] < h["t"]) & (F.abs((h["p"] - h["t"]) - (x["p"] - x["t"])) <= slack))
        top = F.array_max(F.transform(before, lambda x: F.struct((x["n"] + 1).alias("n"), x["start"].alias("start"))))
        own = F.coalesce(top, F.struct(F.lit(1).cast("long").alias("n"), (h["p"] - h["t"]).alias("start")))
        made = F.transform(F.array(own), lambda o: F.struct(F.greatest(acc["best"], o).alias("best"), F.concat(recent, F.array(F.struct(h["p"].alias("p"), h["t"].alias("t"), o["n"].alias("n"), o["start"].alias("start")))).alias("recent")))
        return F.get(made, F.lit(0))

    return F.aggregate(hits, begin, add, lambda acc: acc["best"])


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", cover: float = COVER, slack: int = SLACK) -> DataFrame:
    """Spans: doc_id, text_hash, template, label, base, start, coverage. One row per verified span."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), words_of(F.col(f"`{text}`")).alias("w"))
    pairs = F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), pair_hash(a, b)))
    grams = rows.select("doc_id", "text_hash", F.posexplode_outer(pairs).alias("pos", "h"))
    hits = grams.join(F.broadcast(template_pairs(spark)), "h")
    votes = hits.groupBy("doc_id", "text_hash", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.bit_or("bit").alias("mask"))
    votes = votes.join(F.broadcast(template_table(spark)), "template")
    full = F.bit_count("mask") == F.col("n_pairs")
    whole = F.col("base") | (F.col("n_pairs") < LONG)
    exact = votes.filter(whole & full).select("doc_id", "text_hash", "template", "label", "base", F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("coverage"))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    group = F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= slack, 0).otherwise(1)).over(along)
    merged = (
        votes.filter(~whole).withColumn("group", group).groupBy("doc_id", "text_hash", "template", "label", "base", "group", "n_pairs")
        .agg(F.bit_or("mask").alias("mask"), F.collect_list(F.struct("diagonal", "mask")).alias("votes"))
        .filter(F.bit_count("mask") / F.col("n_pairs") >= cover).withColumn("chain", longest_chain(F.col("votes"), F.col("n_pairs"), slack))
        .withColumn("start", F.col("chain.start")).withColumn("coverage", F.col("chain.n") / F.col("n_pairs")).filter(F.col("coverage") >= cover)
    )
    return exact.unionByName(merged.select(exact.columns))


def label_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = scan(docs, text=text, doc_id=doc_id, **options)
    named = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        named(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"), named(F.collect_set("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    t = F.col(f"`{text}`")
    n_words = F.size(words_of(t)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("_h"), n_words.alias("n_words"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_h"] == found["_hash"]), "left")
    none = F.lit("")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: license labels of every whole document."""
    return label_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
