"""The training-data operators on small inputs, against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeline.llm import boosting, chat, components, fingerprints, jaccard_join, licenses, line_dedup, mixing, pieces, rans, registry, search_index, shared, token_files, toxicity

ODD = [(0, "a b c d e f"), (1, None), (2, ""), (3, "  \t\n"), (4, "one"), (5, "A B c d E f"), (5, "A B c d E f"), (None, "x y z w v u"), (7, "wörter " * 3000), (8, "日本 \n\n 語")]


def odd(spark, empty=False):
    """Nulls, repeated rows, empty and long texts, columns of clashing names."""
    rows = [(i, t, "en", None if (i or 0) % 2 else f"s{i}", 1, "x", 2) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, rate int")
    return df.limit(0) if empty else df.repartition(3)


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


# --- 1 mixing


def test_mix_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    got = sorted(tuple(r) for r in mixing.query(spark, sf).collect())
    assert got == want


def test_mix_targets(spark):
    sizes = [("b", 10), ("a", 1000), (None, 100), ("c", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    want, open_, left = {}, {"a": 1, "b": 2, "c": 3, None: 1}, 1110.0
    caps = {s: 3.0 * n for s, n in sizes}
    while True:  # the excess of those above their caps is shared anew
        total = sum(open_.values())
        over = {s for s, w in open_.items() if left * w / total > caps[s]}
        if not over:
            want |= {s: left * w / total for s, w in open_.items()}
            break
        for s in over:
            want[s], left = caps[s], left - caps[s]
            del open_[s]
    assert got == pytest.approx(want)


def test_mix_odd(spark):
    docs = odd(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD) and all(r.copies <= 3 for r in got) and {r["doc"].size for r in got} == {"x"}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(odd(spark, True)).count() == 0
    assert mixing.mix(docs.filter("doc_id between 1 and 3")).filter("target > 0").count() == 0


# --- 2 Jaccard join


def brute_components(texts):
    sets, inv, par = [], collections.defaultdict(list), list(range(len(texts)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
        for j, n in collections.Counter(j for g in s for j in inv[g]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                par[b] = a
        sets.append(s)
        for g in s:
            inv[g].append(i)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(n=120, words=90, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        b = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            b[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(b[rng.choice([0, 0, 5]) :]))
    return out + [out[0]] * 20 + ["", "  ", None, "a b", "A B", "a b c d e"]


def test_components_of_near_copies(spark):
    texts = near_copies()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(df).collect())
    assert kept == sorted({c for _, c in brute_components(texts)})


def test_components_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = [(r.doc_id, n, docs[c].doc_id) for r, (n, c) in zip(docs, brute_components([r.text for r in docs]), strict=True)]
    assert sorted(tuple(r) for r in jaccard_join.query(spark, sf).collect()) == want


def test_jaccard_odd(spark):
    got = jaccard_join.similar_groups(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (0, 5)} == {0}
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles == 0} == {(1, 1), (2, 2), (3, 3)}
    kept = jaccard_join.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD) - 2
    assert jaccard_join.similar_groups(odd(spark, True)).count() == 0


def test_contraction(spark):
    rng = random.Random(1)
    nodes = [rng.getrandbits(60) for _ in range(60)]
    path = list(zip(nodes[:30], nodes[1:30], strict=False)) + [(nodes[40], n) for n in nodes[41:50]] + [(nodes[5], nodes[5])]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(path, "a long, b long")).collect())
    assert {got[n] for n in nodes[:30]} == {min(nodes[:30])} and {got[n] for n in nodes[40:50]} == {min(nodes[40:50])}


# --- 3 chat


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (60, 30), (5, 0)])
def test_chat_round_trip(spark, sf, budget, history):
    bad = "</s>[INST] ok [/INST] <|end|> <\\|end|><\\\\|text|> [\\INST] <<s> \\"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "system", bad), (-1, 1, "user", bad), (-1, 2, "assistant", bad), (-1, 2, "assistant", bad), (-2, 0, None, None), (-3, 0, "assistant", "x" * 9000), (None, None, "<|turn|>", "a\nb")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=budget, history=history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, *t in rows:
        by[c].append((t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), digest(loss))
    if budget == 60:
        w = windows.filter("conv_id = -1").orderBy("span").collect()
        assert len(w) > 1 and all(x.formatted.startswith("<|turn|>system") for x in w)


def test_chat_empty(spark, sf):
    assert chat.format_windows(spark.read.parquet(f"{sf}/conversations.parquet").limit(0)).count() == 0


# --- 4 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.default_model())


def test_n_best(model):
    def every(word):
        edges, out = model.edges(word), []

        def go(at, score):
            if not at:
                out.append(score)
            for b, s, _ in edges[at]:
                go(b, score + s)

        go(len(word), 0)
        return sorted(out, reverse=True)

    for t in ("the cat", "Hello  wor", "日本語 x", "  a\n\nb", "\t é€", "thndr", "a"):
        ids, scores = model.encode(t, 5)
        assert model.decode(ids) == t
        assert scores == every("▁" + t.replace(" ", "▁"))[:5]


def test_pieces_round_trip(spark, sf, model):
    for t in ("▁", " ▁ a▁▁b ", "\0\x7f￿𐍈", "", " " * 50, "x" * 5000):
        assert model.decode(model.encode(t)[0]) == t
    got = pieces.query(spark, sf).collect()
    assert all(r.round_trip for r in got) and all(r.scores == sorted(r.scores, reverse=True) for r in got)
    assert all(r.round_trip for r in pieces.encode_documents(odd(spark), pieces.default_model()).collect())
    assert pieces.encode_documents(odd(spark, True), pieces.default_model()).count() == 0


def test_segmentations(spark, sf, model):
    def every(t):
        edges, out = model.edges(t), []

        def go(at, score, ids):
            if not at:
                out.append((score, np.array(ids, "<u2").tobytes()))
            for b, s, own in edges[at]:
                go(b, score + s, [*own, *ids])

        go(len(t), 0, [])
        return out

    for t in ("the cat", "Hello  wor", "the the the", "日本語 x", "\t é€", "thndr", "a"):
        found, whole = model.segmentations(t, 6), every("▁" + t.replace(" ", "▁"))
        assert [s for s, _ in found] == sorted((s for s, _ in whole), reverse=True)[:6]
        assert len(set(found)) == len(found) and set(found) <= set(whole)
        assert (found[0][1], [s for s, _ in found]) == model.encode(t, 6)
    value = {i: s for s, i in model.score.values()} | {i: model.fallback for i in model.bytes}
    for t in ("▁", " ▁ a cat▁▁bat ", "one▁two three"):
        found = model.segmentations(t, 5)
        assert len(found) == len(set(found)) and found[0][1] == model.encode(t)[0]
        for score, ids in found:
            assert model.decode(ids) == t and score == sum(value[i] for i in np.frombuffer(ids, "<u2").tolist())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for w in {w for d in docs for w in model.words(d.text or "") if len(w) <= 40}:
        assert model.two_best(w)[0] == model.n_best(w, 1)[0][1]  # Viterbi's best is that of the search
    rows = {r.doc_id: r for r in pieces.query(spark, sf).collect()}
    for d in docs:
        found, r = model.segmentations(d.text), rows[d.doc_id]
        assert r.best_ids_crc32 == [zlib.crc32(ids) for _, ids in found] and r.best_n_pieces == [len(ids) // 2 for _, ids in found]
        assert r.scores == [s for s, _ in found] and all(r.best_round_trips) and len(set(found)) == len(found)
        assert all(s == sum(value[i] for i in np.frombuffer(ids, "<u2").tolist()) for s, ids in found)


def test_pieces_learned_together(spark, sf, model, monkeypatch):
    """Words searched together have what each has alone, and texts coded together what each has alone."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", None, "▁", " a ▁ b ", "日本語 x\n\n", "\ud800 z", "x" * 300, "\0\x7f\uffff\U00010348 a", "   ", "thndr"]
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    one, many = pieces.Pieces(pieces.default_model()), pieces.Pieces(pieces.default_model())
    words = {w for t in texts for w in one.words(t or "")}
    many.learn_many(words)
    assert len(many.cache) > 0.9 * len(words)
    assert all(got == one.learn(w) for w, got in many.cache.items())
    for n in (1, 3):
        for cache in (pieces.CACHE, 100):
            monkeypatch.setattr(pieces, "CACHE", cache)
            assert list(pieces.Pieces(pieces.default_model()).segmentations_of(texts, n)) == [one.segmentations(t, n) for t in texts]
    assert list(one.segmentations_of([], 3)) == [] and list(one.segmentations_of([None, ""], 3)) == [[(0, b"")]] * 2


# --- 5 token files


def test_rans():
    rng = np.random.default_rng(1)
    for n in (1, 5, rans.LANES, rans.LANES + 1, 70_000):
        ids = np.minimum(rng.geometric(0.01, n), 49_000).astype(np.uint16)
        table = rans.Table.load(rans.Table.of(np.bincount(ids, minlength=1 << 16)).dump())
        raw = table.encode(ids)
        assert (table.decode(raw) == ids).all() and rans.block_size(raw, 0) == len(raw)
        with pytest.raises(ValueError):
            table.decode(raw[:12] + bytes([raw[12] ^ 1]) + raw[13:])


def test_word_ids_pass_over_new_words_only(monkeypatch):
    import public_tokenizers

    class Listed(dict):
        def __iter__(self):
            raise AssertionError("all remembered words were passed over")

    class Words(token_files.WordIds):
        __iter__ = Listed.__iter__

    path = public_tokenizers.path("word_bpe_49k.json")
    words, plain = Words(path), token_files.WordIds(path)
    words.old = Listed({w: x for w, x in plain.items()})
    for texts in (["one two, Three.", None, ""], ["two four TWO", "one"], [" ñandú,, 日本. ."]):
        got, want = words.ids(pa.array(texts, pa.string()), b"\2\0"), plain.ids(pa.array(texts, pa.string()), b"\2\0")
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
        words.old = Listed(words.old | {"one": words.get("one")}) if "one" in words else words.old
    monkeypatch.setattr(token_files, "CACHE", 3)
    small = token_files.WordIds(path)
    for texts in (["a b c"], ["d e a"], ["a d f g h i"], ["b e"]):
        assert small.ids(pa.array(texts), b"\2\0")[0].tolist() == plain.ids(pa.array(texts), b"\2\0")[0].tolist()


def test_token_files(spark, sf, monkeypatch, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = ["a\x1cb c", "A b c　d\x85e", "x<|endoftext|>y <|startoftext|>", "é ́a ΑΣ Σ", "don't  I'LL 12 34a\n\t!?.. 'S", "", None]
    ids, lengths = token_files.WordIds(path).ids(pa.array(texts), b"\2\0")
    for t, own in zip(texts, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
        assert own.tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
    at = 0
    got = token_files.query(spark, sf).orderBy("doc_id").collect()
    for r, d in zip(got, spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    root = f"file://{tmp_path}"
    files = token_files.write_tokens(odd(spark), path, root, files=3)
    back = token_files.read_tokens(spark, root, files).collect()
    assert len(back) == len(ODD) and {r.doc_id for r in back} == {i for i, _ in ODD} and min(back, key=lambda r: r.start).doc_id is None
    with token_files.get(root, files[-1][0]) as f, token_files.get(root, "table.bin") as t:
        blocks = list(token_files.read_blocks(f, rans.Table.load(t.read()), 0, 1))
    assert len(blocks[0]) == files[-1][1]
    empty = token_files.write_tokens(odd(spark, True), path, root + "/e", files=2)
    assert empty == [] and token_files.read_tokens(spark, root + "/e", empty).count() == 0


def test_token_ranges(spark, monkeypatch, tmp_path):
    """Documents that begin in any run of blocks are read whole from its checkpoint."""
    import public_tokenizers

    monkeypatch.setattr(rans, "BLOCK", 64)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bee", "sea", "42", "x1"]) for _ in range(n)) for n in (0, 3, 300, 1, 63, 64, 65, 0, 0, 500, 2)]
    ids, lengths = token_files.WordIds(public_tokenizers.path("word_bpe_49k.json")).ids(pa.array(texts), b"\2\0")
    table = rans.Table.of(np.bincount(ids, minlength=1 << 16))
    nulls = np.zeros(len(texts), "u1")
    (tmp_path / "f").write_bytes(b"".join(token_files.encoded_file(table, [(np.arange(len(texts)), nulls, lengths.astype("<u8"), ids)])))
    want = [zlib.crc32(x.astype("<u4").tobytes()) for x in np.split(ids, np.cumsum(lengths)[:-1])]
    n_blocks = -(-len(ids) // 64)
    for run in (1, 2, 5, n_blocks):
        got = []
        for first in range(0, n_blocks, run):
            with token_files.get(str(tmp_path), "f") as f:
                low, own, _, begins, n, crcs = token_files.read_documents(f, table, first, first + run)
            assert low == len(got) and begins.tolist() == (np.cumsum(lengths) - lengths)[low : low + len(own)].tolist()
            got += crcs.tolist()
        assert got == want
    with token_files.get(str(tmp_path), "f") as f:  # from the checkpoint in the middle
        assert np.concatenate(list(token_files.read_blocks(f, table, n_blocks // 2))).tolist() == ids[n_blocks // 2 * 64 :].tolist()


# --- 6 licenses


def brute_labels(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark, sf):
    own = [(10**6, "The MIT\nLicense, mit-LICENSE! cc-by CC BY"), (10**6 + 1, "GNU General Public x License"), (10**6 + 2, None), (10**6 + 3, "Permission is hereby granted, free of charge, to any person obtaining a very copy of this software and documentation files"), (10**6, "The MIT\nLicense, mit-LICENSE! cc-by CC BY")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    want = sorted(str((r.doc_id, *brute_labels(r.text))) for r in docs.collect())
    got = licenses.label_documents(docs).collect()
    assert sorted(str(tuple(r)[:6]) for r in got) == want and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert "mit-text" in next(r.labels for r in got if r.doc_id == 10**6 + 3)
    assert licenses.label_documents(odd(spark)).count() == len(ODD) and licenses.label_documents(odd(spark, True)).count() == 0


def test_license_spans(spark):
    long = next(t for t, label in licenses.TEMPLATES.items() if label == "bsd-text")
    w = long.split()
    texts = {
        "all rights of ours, rights reserved": "",
        "All rights reserved.": "all-rights-reserved",
        "x " + long: "bsd-text",
        " ".join(f"{w[t]} {w[t + 1]}" for t in reversed(range(len(w) - 1))): "",  # every pair, from the last to the first
        " ".join([*w[:6], "very", "much", *w[6:12], *w[13:]]): "bsd-text",
        " ".join([*w[:10], *["x"] * 9, *w[10:]]): "",
        (long + " ") * 40: "bsd-text",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.label_documents(docs).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    starts = {r.doc_id: r for r in licenses.scan(docs).filter("label = 'bsd-text' and doc_id in (2, 4)").collect()}
    assert (starts[2].start, starts[2].coverage) == (1, 1.0) and starts[4].start == 0 and starts[4].coverage == 1 - 3 / (len(w) - 1)


def test_lean_gives_back(monkeypatch):
    import gc

    given, usual = [], gc.get_threshold()
    monkeypatch.setattr(shared, "give_back", lambda: given.append(gc.get_threshold()))

    def fails(batches):
        assert gc.get_threshold()[0] > usual[0]
        yield next(batches)
        raise ValueError

    assert list(shared.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    with pytest.raises(ValueError):
        list(shared.lean(fails)(iter([1])))
    assert given == [usual, usual] and gc.get_threshold() == usual  # after a failure too
    monkeypatch.setattr(shared, "_held", {"a": 1})
    assert shared.held("b", lambda: len(given)) == 3 and shared.held("b", dict) == 3 and len(given) == 3  # another operator's words are given back before


# --- 7 toxicity


def test_isotonic():
    xs, ys = boosting.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0, 1, 0, 1, 1]))
    assert list(np.interp([1, 2, 3, 4], xs, ys)) == [0, 0.5, 0.5, 1]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.query(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    p, n = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (p[:, None] > n[None]).mean() > 0.95 and (p >= 0.3).mean() > 0.8 and (n >= 0.3).mean() < 0.05
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, None), (4, 0, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject(odd(spark), labels)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert toxicity.reject(odd(spark, True), labels).count() == 0
    model = toxicity.Model({}, None)
    words = toxicity.Words({})
    assert model.score(["you idiot, you m0r0n", "i d i o t !", "fine words here", None], words).tolist()[2:] == [0, 0]
    assert toxicity.features("m0r0n", words)[toxicity.FEATURES.index("obfuscated")] == 1


def test_toxicity_parts():
    texts = [None, "", *(f"you m0r0n number{i} " * 40_000 for i in range(9))]
    model, batch = toxicity.Model({}, None), pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "body": texts, "more": ["x"] * len(texts)})
    parts = list(toxicity.scored(iter([batch.slice(0, 0), batch]), model, "body", "s"))
    assert len(parts) > 1 and all(p.num_rows == 1 or sum(map(len, filter(None, p["body"].to_pylist()))) <= toxicity.PART for p in parts)
    whole = pa.Table.from_batches(parts)
    assert whole.drop(["s"]).to_pylist() == batch.to_pylist() and whole["s"].to_pylist() == model.score(texts, toxicity.Words({})).tolist()
    words = toxicity.Words({})
    assert words["one"] is words["two"]  # what is alike is kept once
    assert words["MORON"] != words["moron"]


def test_toxicity_sample_is_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = toxicity.train(docs, labels)
    many = toxicity.train(docs.select("*", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("doc_id", "text"), labels)
    assert many.lexicon == one.lexicon and (many.trees is None) == (one.trees is None)


# --- 8 line dedup


def brute_lines(docs):
    inv, sets, out = collections.defaultdict(list), [], {}
    for i, t in sorted(docs):
        gone = []
        for no, line in enumerate(t.split("\n")):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if len(s) < 5:
                continue
            if any(5 * k >= 4 * (len(s) + len(sets[j]) - k) for j, k in collections.Counter(j for w in s for j in inv[w]).items()):
                gone.append(no)
            for w in s:
                inv[w].append(len(sets))
            sets.append(s)
        if gone:
            out[i] = gone
    return out


def test_line_dedup(spark, sf):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(60)]
    base = [rng.sample(voc, rng.choice([5, 6, 8, 11, 12, 13, 20, 23, 24, 26, 40])) for _ in range(30)]

    def line():
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(voc)
        return " ".join(b[rng.choice([0, 0, 1]) :])

    made = spark.createDataFrame([(i, "\n".join(line() for _ in range(rng.randrange(1, 12)))) for i in range(120)], "doc_id long, text string").repartition(4)
    for df in (made, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        got = {r.doc_id: r.removed for r in line_dedup.later_lines(df).collect()}
        assert got == brute_lines([(r.doc_id, r.text) for r in df.collect()])


def brute_all_lines(docs):
    """Line numbers that go by (doc_id, text), lines of few words among them; ``docs`` in the order of places."""
    inv, sets, out = collections.defaultdict(list), [], {}
    for i, t in docs:
        gone = []
        for no, line in enumerate(t.split("\n")):
            s = {w for w in re.split(r"[\x20\x09-\x0D]+", line.lower()) if w}
            if any(5 * k >= 4 * (len(s) + len(sets[j]) - k) for j, k in collections.Counter(j for w in s for j in inv[w]).items()):
                gone.append(no)
            for w in s:
                inv[w].append(len(sets))
            sets.append(s)
        if gone:
            out[i] = gone
    return out


def test_line_dedup_short(spark, sf):
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(9)]
    made = [(i, "\n".join(" ".join(rng.choice(voc) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    made += [(90, "a b c d"), (91, "e d c b a"), (92, "p q r s t"), (93, "T  p r q"), (94, "q r s t t"), (95, "日本語の長い行"), (96, "日本語の長い行\n \n\n"), (97, "x"), (98, "x X\nx y\ny x x")]
    for df in (spark.createDataFrame(made, "doc_id long, text string").repartition(4), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        want = brute_all_lines(sorted((r.doc_id, r.text) for r in df.collect()))
        got = {r.doc_id: r.removed for r in line_dedup.later_lines(df, least_words=1).collect()}
        assert got == want
        lost = {r["doc"].doc_id: r.n_removed for r in line_dedup.dedup(df).collect() if r.n_removed}
        assert lost == {i: len(x) for i, x in want.items()}


def test_line_dedup_spares_pairs(spark, monkeypatch):
    """Copies of one line with edits of their own, two by two under the similarity: few of their pairs reach the sets, and with all lists long too."""
    rng = random.Random(3)
    base = [f"common{i}" for i in range(36)]
    docs = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(36), 4):
            words[k] = f"own{i}x{k}"
        docs.append((i, " ".join(words)))
    docs += [(60, " ".join(base)), (61, " ".join([*base[:35], "near"])), (62, " ".join(base[:33]))]
    counts, real = [], line_dedup.verified

    def counted(pairs, *args, **kwargs):
        counts.append(pairs.count())
        return real(pairs, *args, **kwargs)

    monkeypatch.setattr(line_dedup, "verified", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for small in (line_dedup.SMALL, 4):
        monkeypatch.setattr(line_dedup, "SMALL", small)
        counts.clear()
        assert {r.doc_id: r.removed for r in line_dedup.later_lines(df, least_words=1).collect()} == brute_all_lines(docs)
        assert sum(counts) < 150, counts


def test_line_dedup_spares_cpu(spark):
    """Array functions over words are not interpreted below a lambda function, keys are sorted as numbers, lists that can't be long are not counted."""
    df = spark.createDataFrame([(i, f"The the  cat\tsat on w{i} \n" + "x y " * i) for i in range(40)], "doc_id long, text string")
    classes, least = line_dedup.rarity_classes(df)
    keys = line_dedup.with_keys(line_dedup.numbered(df), classes)
    assert not keys.schema["keys"].dataType.containsNull
    for line in keys._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "lambda" not in line or not any(f in line for f in ("array_distinct", "array_remove", "sort_array"))
    got = {(r.place.doc_id, r.place.line_no): r["keys"] for r in keys.collect()}
    assert all(k == sorted(set(k)) for k in got.values()) and {len(got[i, 0]) for i in range(40)} == {5}
    assert [len(got[i, 1]) for i in range(3)] == [0, 2, 2] and got[0, 0][0] not in got[1, 0]  # its own word is the rarest
    words = line_dedup.prefix_words(line_dedup.distinct_lines(df, classes, 1), least)
    assert words.count() and not words.filter(line_dedup.may_be_long(least)).count()


def test_line_dedup_odd(spark):
    got = {(r["doc"].doc_id, r.kept_text) for r in line_dedup.dedup(odd(spark)).collect()}
    assert (1, None) in got and (2, "") in got and (5, "") in got and (0, "a b c d e f") in got
    assert line_dedup.dedup(odd(spark, True)).count() == 0


# --- 9 search


def test_search(spark, sf, monkeypatch):
    monkeypatch.setattr(search_index, "SHARD", 9000)  # several shards, so thresholds are carried over
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    terms = {r.doc_id: collections.Counter((r.text or "").encode().lower().split()) for r in docs}
    length = {i: sum(c.values()) for i, c in terms.items()}
    n, mean = len(docs), sum(length.values()) / len(docs)
    df = collections.Counter(w for c in terms.values() for w in c)
    got = collections.defaultdict(list)
    for r in search_index.query(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    k1, b = search_index.K1, search_index.B
    assert set(got) == {i for i in terms if i % 50 == 0}
    for q in got:
        score = collections.Counter()
        for w, qtf in terms[q].items():
            weight = qtf * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in terms.items():
                if w in c:
                    score[i] += weight * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * length[i] / mean))
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and [s for _, s in got[q]] == pytest.approx([s for _, s in want])


def test_search_pruned(monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        t = np.unique(rng.zipf(1.3, 60).astype(np.uint64) % np.uint64(5000) + np.uint64(5000 * (i % 4)))  # four languages
        rows.append((i, t, rng.integers(1, 5, len(t)).astype(np.uint32), 60))
    often = np.array([x for x, c in sorted(collections.Counter(x for r in rows for x in r[1].tolist()).items()) if c >= 3000 / search_index.OFTEN], np.uint64)
    raw = b"".join(search_index.Shard.build(rows).dump())
    for weak in (often, often[:0]):
        shard = search_index.Shard.load(raw, 60.0, weak)
        for q in (0, 7, 99):
            terms, weights = rows[q][1], rng.integers(1, 5000, len(rows[q][1])).astype(float)
            whole = np.zeros(3000)
            for i, t, tf, _ in rows:
                at = np.flatnonzero(np.isin(terms, t))
                x = tf[np.searchsorted(t, terms[at])].astype(float)
                whole[i] = (weights[at] * x * (search_index.K1 + 1) / (x + search_index.K1)).sum()
            monkeypatch.setattr(search_index, "MANY", 1 if q == 7 else 8)
            places, scores = shard.search(terms, weights, 10)
            best = np.lexsort((np.arange(3000), -np.round(whole, 6)))[:10]
            assert shard.doc_ids[places].tolist() == best.tolist() and scores == pytest.approx(whole[best])
            again, same = shard.search(terms, weights, 10, float(scores[-1]))
            assert again.tolist() == places.tolist() and same.tolist() == scores.tolist()
        if len(weak):
            assert 0 < shard.scored < 0.1 * 6 * 3000  # most documents are never scored whole


def test_search_together(monkeypatch):
    """Queries that share products find what each finds alone, in the same order and with the same scores."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        t = np.unique(rng.zipf(1.3, 40).astype(np.uint64) % np.uint64(900))
        rows.append((i, t, rng.integers(1, 5, len(t)).astype(np.uint32), 40))
    often = np.array([x for x, c in sorted(collections.Counter(x for r in rows for x in r[1].tolist()).items()) if c >= 900 / search_index.OFTEN], np.uint64)
    shard = search_index.Shard.load(b"".join(search_index.Shard.build(rows).dump()), 40.0, often)
    asked = [(rows[i][1], rng.integers(1, 5000, len(rows[i][1])).astype(float), 0.0) for i in range(0, 900, 30)] + [(np.zeros(0, np.uint64), np.zeros(0), 0.0)]
    alone = [shard.search(*a[:2], 10) for a in asked]
    asked = [(t, w, float(s[-1]) * (k % 3) / 2 if len(s) else 0.0) for k, ((t, w, _), (_, s)) in enumerate(zip(asked, alone, strict=True))]
    assert 0 < sum(len(shard.opening(*a)[-1]) > 900 // search_index.MANY for a in asked) < len(asked)  # both ways are taken
    for cells in (2_000_000, 4 * 900, 1):
        monkeypatch.setattr(search_index, "CELLS", cells)
        for (found, scores), (want, best) in zip(shard.search_all(asked, 10), alone, strict=True):
            assert found.tolist() == want.tolist() and scores.tolist() == best.tolist()


def test_search_odd(spark):
    docs = odd(spark)
    got = search_index.search(docs, docs.select(F.col("doc_id").alias("query_id"), "text").filter("doc_id in (1, 5)"), k=3).collect()
    assert {r.query_id for r in got} == {5} and got[0].score > 0
    none = odd(spark, True)
    assert search_index.search(none, none.select(F.col("doc_id").alias("query_id"), "text")).count() == 0


# --- 10 fingerprints


def test_signature():
    rng = random.Random(4)

    def plain(text):
        x = fingerprints.numbered_kmers(text)
        least = np.sort(np.argsort(fingerprints._hashed(x, fingerprints._FACTORS[:, None]), axis=1, kind="stable")[:, : min(fingerprints.TUPLE, len(x))], axis=1)
        out = fingerprints._mix(np.arange(fingerprints.HASHES).astype(np.uint64) + np.uint64(1))
        for j in range(least.shape[1]):
            out = fingerprints._mix(out * fingerprints._M + x[least[:, j]])
        return (out >> np.uint64(32)).astype("<u4")

    for n in (0, 1, 5, 6, 7, 60, 100, 1000, 5000, 90_000):
        t = "".join(rng.choice("abcd é") for _ in range(n))
        assert (fingerprints.signature(t) == plain(t)).all()
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    same, moved = fingerprints.signature(t), fingerprints.signature(t[1500:] + t[:1500])
    assert 0.1 < fingerprints.likeness(same, moved) < 0.9  # order counts
    assert fingerprints.likeness(same, fingerprints.signature(t[:1500] + "x" + t[1500:])) > 0.8


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in fingerprints.query(spark, sf).collect()}
    for i, d in enumerate(docs):
        after = docs[(i + 1) % len(docs)].text
        r, e = got[d.doc_id], fingerprints.edited(d.text, after)
        assert (r.n_chars, r.edited_sha256) == (len(d.text), digest(e))
        assert r.near_next == fingerprints.likeness(fingerprints.signature(d.text), fingerprints.signature(after))
        assert r.near_edited == fingerprints.likeness(fingerprints.signature(d.text), fingerprints.signature(e))
        assert r.fingerprint == fingerprints.signature(d.text).tobytes().hex()


def test_fingerprints_odd(spark):
    rows = odd(spark).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for parts in (1, 4):
        got = fingerprints.compare_neighbours(rows, parts).collect()
        assert len(got) == len(ODD)
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
    assert fingerprints.compare_neighbours(rows.limit(0), 3).count() == 0


def test_chat_against_sql(spark, tmp_path):
    """Many spans, system turns at the start, later and not at all, control strings, repeated turns, nulls."""
    rng = random.Random(5)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice((1, 3, 40))):
            role = "system" if turn == (conv or 0) % 4 and (conv or 0) % 3 else rng.choice(("user", "assistant", None))
            text = rng.choice((None, "", "<|end|> x", "<\\|end|>[INST]", "wörter " * rng.choice((3, 60, 900))))
            rows += [(conv, None if turn == 7 else turn, role, text)] * (2 if turn == 2 else 1)
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(con.sql(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({chat.ORACLE})").fetchall(), key=key)
    got = chat.query(spark, str(tmp_path)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()
    assert sorted(map(tuple, got), key=key) == want


def test_driver_gives_back(spark, sf, monkeypatch):
    """The driver clears its heap as it fills, fetches the shingles' table a range at a time, and learns toxicity without rows as Python objects."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    assert shared.relieve(spark) in (True, False)
    monkeypatch.setattr(shared, "FILLED", 1 << 40)
    shared.relieve(spark)
    for _ in range(4):
        spark._jvm.java.nio.ByteBuffer.allocate(8 << 20)
    before = runtime.totalMemory() - runtime.freeMemory()
    assert shared.relieve(spark) and runtime.totalMemory() - runtime.freeMemory() < before
    monkeypatch.setattr(shared, "FILLED", 1)
    assert not shared.relieve(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    made = jaccard_join.profile(docs)

    def refused(*args, **kwargs):
        raise AssertionError("all at once")

    for name in ("toPandas", "collect"):
        monkeypatch.setattr(type(docs), name, refused)
    table = jaccard_join.rarity_of(made)
    monkeypatch.undo()
    seen = np.unique(np.concatenate([s for s in jaccard_join.shingle_sets(docs.select("text").toArrow()["text"].combine_chunks())]) & np.uint64(jaccard_join.SLOTS - 1))
    assert set(np.flatnonzero(table).tolist()) == set(seen.tolist())
    monkeypatch.setattr(type(docs), "toPandas", refused)
    assert toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet")).trees is not None
