"""A corpus from documents: each stage reads what the one before it kept.

Rejected toxic documents go, later similar lines go, one document of each near-duplicate group stays, sources are mixed
to their target weights, and what is left is encoded. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.llm import jaccard_join, line_dedup, mixing, pieces, toxicity
from lodeline.llm.shared import stored

#: The similarity joins and the boosted trees have no SQL form.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that resemble an earlier one; n_chars follows the text."""
    out = line_dedup.dedup(docs)
    fields = []
    for c in docs.columns:
        value = F.col(f"doc.`{c}`")
        if c == "text":
            value = F.col("kept_text")
        elif c == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(value).cast(docs.schema[c].dataType)
        fields.append(value.alias(c))
    return out.select(*fields)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document: counts, checksum, scores and the round trip."""
    return pieces.encode_documents(docs, pieces.default_model())


STAGES = [
    ("toxicity", toxic),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
