"""Toxicity: boosted trees over dense features, calibrated.

Features of a whole text: densities of a lexicon, how near its hits stand to second-person words, capitals,
punctuation and obfuscation rates. The lexicon has a short fixed list of insults and words and word beginnings
that are learned from the labelled training rows (documents of each class that hold them, with a confidence
bound). Trees and calibration are fitted on the driver from at most ``MAX_TRAIN`` labelled rows, the
least by hash of their id, so the sample's bound is a parameter; each document is scored by a map over Arrow
batches, with no shuffle. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have all rates 0 and get the score of such a text; a document with
several label rows counts as toxic if one says so; null labels don't count; with fewer than ``LEAST`` usable
labels or only one class, the score is the squashed density of the fixed list; repeated rows score alike, and of the
rows of one doc_id the text of least hash is learned from; a text of any length is looked at whole; an
empty table gives an empty result; further columns are kept by ``with_score`` and not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Calibrated
from .shared import held, lean, stored
from .words import parts_of

#: Labelled rows that are learned from, at most; entries of the learned lexicon, at most.
MAX_TRAIN, MAX_LEXICON = 40_000, 20_000
LEAST = 40
THRESHOLD = 0.3
#: General insults.
INSULTS = frozenset("idiot moron stupid loser dumb scum trash garbage pathetic worthless disgusting clown jerk fool creep freak coward vermin filth imbecile cretin bastard bitch asshole shit fuck fucking crap damn hate kill die ugly retard whore slut pig rat".split())
YOU = frozenset("you your yours yourself u ur youre you're ya du dich dir dein ihr euch tu te toi vous tes tus ti usted ustedes".split())
NEAR = 5
_LEET = str.maketrans("013457@$!|", "oieastasii")
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
_MARKS = bytes(b for b in range(256) if not (33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126))
_EDGE = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
_REPEAT = re.compile(r"(.)\1{2,}")
FEATURES = (
    "lex_max lex_sum lex_density lex_hits lex_distinct insult_hits insult_density near_you near_you_density caps_words caps_letters exclaims questions marks obfuscated obfuscated_rate repeats log_words word_length"
).split()
PREFIXES = (4, 5, 6)
CACHE = 300_000
#: Bytes of text that are scored at once.
PART = 4 << 20


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def unmasked(word: str) -> str:
    """The word with look-alike characters read as letters, other marks left out and long repeats cut to one."""
    return _REPEAT.sub(r"\1", "".join(c for c in word.lower().strip(".,;:").translate(_LEET) if c.isalpha()))


def spelled_out(words: list[str]) -> list[str]:
    """Words that are spelled with a space after each letter, four letters at least."""
    found, run = [], []
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            run.append(w)
        else:
            if len(run) >= 4:
                found.append("".join(run))
            run = []
    return found


def terms(words: list[str]) -> set[str]:
    """What the lexicon may learn from a text: its words and their beginnings, apart by a first character."""
    out: set[str] = set()
    for raw in set(words):
        w = plain(raw)
        if 2 < len(w) <= 30:
            out.add("=" + w)
            out.update("^" + w[:k] for k in PREFIXES if len(w) > k)
    return out


class Words(dict):
    """What is known of a raw word: (weight, entry, insult, you, obfuscated, capital, repeat); forgets all when full."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.shared: dict[tuple, tuple] = {}  # most words are alike in all of it

    def weigh(self, w: str) -> tuple[float, str]:
        found = [(self.lexicon[k], k) for k in ("=" + w, *("^" + w[:n] for n in PREFIXES if len(w) > n)) if k in self.lexicon]
        return max(found, default=(0.0, ""))

    def __missing__(self, raw: str):
        if len(self) >= CACHE:
            self.clear()
            self.shared.clear()
        w = plain(raw)
        weight, entry = self.weigh(w)
        insult, masked = w in INSULTS, False
        if not weight and not insult and w and not w.isalpha() or _REPEAT.search(w):
            u = unmasked(raw)
            if u != w and len(u) > 3:
                weight, entry = self.weigh(u)
                insult = u in INSULTS
                masked = bool(weight or insult)
        odd = not w.isalpha() and any(c.isalpha() for c in w) and any(c in "013457@$!*" for c in w)
        out = (weight, entry, insult, w in YOU, masked, odd, len(w) > 2 and raw.isupper(), bool(_REPEAT.search(w)))
        out = self[raw] = self.shared.setdefault(out, out)
        return out


def features(text: str | None, known: Words) -> list[float]:
    text = text or ""
    words = text.split()
    for w in spelled_out(words) if len(words) < len(text) / 2 + 1 and any(len(w) == 1 for w in words) else ():
        if w.lower() in INSULTS or known.weigh(w.lower())[0]:
            words.append(w)
    n, raw = max(len(words), 1), text.encode("utf-8", "replace")
    infos = list(map(known.__getitem__, words))
    hits = [(i, x) for i, x in enumerate(infos) if x[0] > 0 or x[2]]
    near = 0
    for i, _ in hits:
        near += any(x[3] for x in infos[max(0, i - NEAR) : i + NEAR + 1])
    weights = [x[0] for _, x in hits]
    insults = sum(x[2] for _, x in hits)
    masked = sum(x[4] for _, x in hits)
    letters = max(len(raw.translate(None, _LETTERS)), 1)
    chars = max(len(text), 1)
    return [
        max(weights, default=0.0), sum(weights), len(hits) / n, len(hits), len({x[1] or "!" for _, x in hits}), insults, insults / n, near, near / n,
        sum(x[6] for x in infos) / n, len(raw.translate(None, _UPPER)) / letters, text.count("!") / chars, text.count("?") / chars, len(raw.translate(None, _MARKS)) / chars,
        masked, sum(x[5] for x in infos) / n, sum(x[7] for x in infos) / n, math.log1p(len(words)), len(text) / n,
    ]


def training_row(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, mod 4, isn't 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


class Model:
    """Lexicon and trees; without trees the fixed list alone scores."""

    def __init__(self, lexicon: dict[str, float], trees: Calibrated | None):
        self.lexicon, self.trees = lexicon, trees

    def score(self, texts: list[str | None], known: Words) -> np.ndarray:
        x = np.array([features(t, known) for t in texts], dtype=float).reshape(-1, len(FEATURES))
        if self.trees is not None:
            return self.trees.predict(x)
        return 1 - np.exp(-40 * x[:, FEATURES.index("insult_density")])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learns lexicon, trees and calibration from a bounded sample of labelled training rows."""
    usable = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").alias("_y")).filter(training_row(F.col("_id")) & F.col("_y").isNotNull())
    # At most max_train rows by an order of their own, so that they may be broadcast at any size.
    sample = usable.groupBy("_id").agg(F.max("_y").cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    sample = stored(sample, "sample-ids")
    # One text of each sampled doc_id, the one of least hash: as many rows as the sample has, stored once for three passes.
    found = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(sample), "_id")
    rows = stored(found.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.first("_y").alias("_y")), "sample")

    def count(batches):
        held("toxicity", dict)
        for batch in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["_text"].to_pylist(), batch["_y"].to_pylist(), strict=True):
                seen[int(y > 0)].update(terms((t or "").split()))
            both = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_pydict({"term": both, "pos": [seen[1][k] for k in both], "neg": [seen[0][k] for k in both]}, schema=pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    totals = rows.agg(F.sum((F.col("_y") > 0).cast("long")).alias("p"), F.sum((F.col("_y") <= 0).cast("long")).alias("n")).first()
    pos, neg = totals.p or 0, totals.n or 0
    if pos + neg < LEAST or not pos or not neg:
        return Model({}, None)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    bound = odds - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    counted = rows.mapInArrow(lean(count), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 4")
    best = counted.select("term", bound.alias("bound")).filter("bound >= 1.5").orderBy(F.desc("bound"), "term").limit(MAX_LEXICON).collect()
    lexicon = {r.term: float(r.bound) for r in best}

    def feature_rows(batches):
        known = Words(lexicon)
        for batch in batches:
            x = [features(t, known) for t in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["_y"].cast(pa.int32())], names=["x", "y"])

    got = rows.mapInArrow(lean(feature_rows), "x array<double>, y int").toArrow()
    x, y = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)), (got["y"].to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # equal whatever order the rows came in
    order = order[np.random.default_rng(7).permutation(len(order))]
    return Model(lexicon, Calibrated().fit(x[order], y[order]))


def with_score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "toxicity_score") -> DataFrame:
    """``docs`` with one more column, the score."""
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    shape = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(lean(lambda batches: scored(batches, model, text, name)), shape)


def scored(batches: Iterator[pa.RecordBatch], model: Model, text: str, name: str) -> Iterator[pa.RecordBatch]:
    """Batches with the score, in parts of few bytes of text: a batch's texts don't stand in memory as Arrow's, Python's and the result's at once."""
    held("toxicity", dict)
    known = Words(model.lexicon)
    for batch in (part for whole in batches for part in parts_of(whole, text, size=PART)):
        found = model.score(batch[text].to_pylist(), known)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: toxicity of every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score at the threshold or above."""
    name = "_toxicity"
    while name in docs.columns:
        name = "_" + name
    return with_score(docs, train(docs, labels), name=name).filter(F.col(name) < threshold).drop(name)
