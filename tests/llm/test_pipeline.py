"""The pipeline's stages one after another, each against a brute-force version on its own input."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lodeline.llm import mixing, pieces, toxicity

from .test_llm import brute_all_lines, brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]


@pytest.fixture(scope="module")
def docs(spark, sf, tmp_path_factory):
    """Some documents, a toxic one, a null text, an empty one, a repeated row and a document with a line of another."""
    own = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 80").select(*COLUMNS)
    first = own.orderBy("doc_id").first()
    more = [(900, None, None, None, None), (901, "", "en", first.source, 0), (902, "one two three four", "en", "s", 18), (902, "one two three four", "en", "s", 18), (903, "Three four one two\nown words of its own here", None, "s", 44)]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    own.unionByName(spark.createDataFrame(more, own.schema)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_every_stage(spark, sf, docs):
    clean = stage("toxicity")(spark, docs, sf)
    assert clean.columns == COLUMNS and clean.count() <= docs.count()
    assert {900, 901, 902, 903} <= {r.doc_id for r in clean.collect()}  # nothing toxic about them
    scored = toxicity.with_score(docs, toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")), name="s")
    assert rows_of(clean, "doc_id") == rows_of(scored.filter(F.col("s") < toxicity.THRESHOLD), "doc_id")

    before = sorted({(r.doc_id, r.text) for r in clean.collect() if r.text is not None})
    gone = brute_all_lines(before)
    want = collections.Counter()
    for r in clean.collect():
        text = r.text
        if text is not None and r.doc_id in gone:
            text = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in gone[r.doc_id])
        want[r.doc_id, text, r.lang, r.source] += 1
    lined = stage("line dedup")(spark, clean, sf)
    assert lined.columns == COLUMNS and collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in lined.collect()) == want
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.doc_id in gone)

    lined = spark.createDataFrame(lined.collect(), lined.schema)
    order = sorted(lined.collect(), key=lambda r: (r.doc_id, r.text or ""))
    classes = brute_components([r.text for r in order])
    keep = [r for i, (r, (n, c)) in enumerate(zip(order, classes, strict=True)) if not n or i == c]
    near = stage("n-gram Jaccard join")(spark, lined, sf)
    assert near.columns == COLUMNS and sorted(r.doc_id for r in near.collect()) == sorted(r.doc_id for r in keep)

    near = spark.createDataFrame(near.collect(), near.schema)
    copies = collections.Counter()
    for r in mixing.mix(near).collect():
        copies[r["doc"].doc_id] += r.copies
    mixed = stage("mixing sources to target weights")(spark, near, sf)
    assert mixed.columns == COLUMNS and collections.Counter(r.doc_id for r in mixed.collect()) == +copies

    model = pieces.Pieces(pieces.default_model())
    encoded = stage("SentencePiece encoding and decoding")(spark, mixed, sf)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == sum(copies.values()) and all(r.round_trip for r in rows)
    assert all(r.n_pieces == len(model.encode(texts[r.doc_id])[0]) // 2 for r in rows)


def test_empty_and_further_columns(spark, sf, docs):
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, sf).count() == 0, name
    clashing = docs.filter("doc_id > 800").withColumn("size", F.lit("x")).withColumn("rate", F.lit(1)).withColumn("doc", F.lit("y"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, clashing, sf).columns == clashing.columns, name
