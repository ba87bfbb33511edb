"""SentencePiece encoding and decoding with n-best segmentation.

A text is segmented over the lattice of a model's pieces: forward Viterbi gives the best score of every prefix, and those
scores are the exact heuristic of a backward A* search from the end, which so yields segmentations in
order of score. No piece continues over the start of a word (a space after another character), which is
checked when the model is loaded, so the lattice of a text is a chain of the lattices of its words: each word is
searched once and remembered, and the n best of a text change only the words with the least gaps between their two best
scores, which the forward pass gives; those words alone are searched by A*, and each of the n best segmentations takes
their ids from what the search yields. Elsewhere all n are alike and have the forward pass's best: its back pointers
keep the longest last piece among equal scores, as the search does, so both give one best segmentation.

Scores are whole numbers, so sums are exact. A model of merge ranks (BPE) has no probabilities; its pieces get those
of Zipf's law by rank. A character without a piece is written as its UTF-8 bytes. A text is preceded by a space as the
model asks; the character that stands for a space is itself written as bytes, so decoding gives back any text.

A text is one row and needs no other: encoding is a map over Arrow batches, without a shuffle.

Defined results: null and empty texts have no pieces and decode to the empty text; equal texts have equal pieces;
among equal scores the segmentation found first (longer last pieces) wins, and between those of a text the one that changes
less in the words searched first (least gap, then place); a text with fewer than n segmentations has those; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held, lean
from .words import parts_of

SPACE = "▁"
UNIT = 1 << 16
BEST = 3
#: Below all scores; the score of what is no piece, which is below that with any score added.
LOW, NONE = -(1 << 60), -(1 << 61)
#: Words of a generation, and words whose n best are kept.
CACHE, MORE = 350_000, 100_000
LONG = 200
#: Bytes of text whose new words are learned at once; of those the ones of up to ``ALIKE`` characters, all among the ``COMMON`` that pieces have most,
#: are searched together, ``TOGETHER`` of one length at a time.
PART, ALIKE, COMMON, TOGETHER = 2 << 20, 32, 127, 4096


class Pieces:
    """A model's pieces with whole-number scores."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in plain]
        if all(s <= 0 and s == int(s) for s in scores):
            total = math.log(sum(1 / (1 - s) for s in set(scores)))
            scores = [-math.log(1 - s) - total for s in scores]
        self.score = {model.id_to_piece(i): (round(s * UNIT), i) for i, s in zip(plain, scores, strict=True)}
        self.fallback = min(s for s, _ in self.score.values()) - UNIT
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece continues over the start of a word")
        if n > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.text = [b""] * n
        for p, (_, i) in self.score.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        cut = "" if any("\n" in p and len(p) > 1 for p in self.score) else "\n"
        self.word = re.compile(f"{cut}|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: By character: (score or None, id, tree of the characters that follow or None).
        self.tree: dict[str, tuple] = {}
        starts = {p[:k] for p in self.score for k in range(1, len(p))}
        trees = {"": self.tree} | {p: {} for p in starts}
        for p in starts | self.score.keys():
            trees[p[:-1]][p[-1]] = (*self.score.get(p, (None, None)), trees.get(p))
        self._tabulate(starts)
        self.cache: dict[str, tuple[bytes, int, int]] = {}
        self.old: dict[str, tuple[bytes, int, int]] = {}
        self.more: dict[tuple[str, int], list[tuple[int, bytes]]] = {}

    def _tabulate(self, starts: set[str]) -> None:
        """The tree as tables for ``learn_many``: number 0 is nowhere, 1 the root, then come the beginnings of longer pieces, then all other pieces."""
        often = Counter(c for p in self.score for c in p if c in self.score)
        chars = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))[:COMMON]]
        self.of_char = np.zeros(1 << 16, np.uint8)  # the last stands for all characters above
        for k, c in enumerate(chars):
            self.of_char[min(ord(c), 0xFFFF)] = k + 1
        self.of_char[0xFFFF] = 0
        inner = sorted(starts)
        number = {p: k for k, p in enumerate(["", *inner, *sorted(self.score.keys() - starts)], 1)}
        self.n_inner = len(inner) + 1
        self.after = np.zeros((self.n_inner + 1, COMMON + 1), np.int32)
        self.value, self.id_of = np.full(len(number) + 1, NONE), np.zeros(len(number) + 1, np.uint16)
        for p, k in number.items():
            if p and (c := self.of_char[min(ord(p[-1]), 0xFFFF)]):
                self.after[number[p[:-1]], c] = k
            if p in self.score:
                self.value[k], self.id_of[k] = self.score[p]

    def edges(self, word: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end the pieces that end there: (begin, score, ids)."""
        out: list[list[tuple[int, int, tuple[int, ...]]]] = [[] for _ in range(len(word) + 1)]
        get, longest, n = self.score.get, self.longest, len(word)
        for begin in range(n):
            for end in range(begin + 1, min(n, begin + longest) + 1):
                if (found := get(word[begin:end])) is not None:
                    out[end].append((begin, found[0], (found[1],)))
            c = word[begin]
            if c not in self.score:
                raw = c.encode("utf-8", "surrogatepass")
                out[begin + 1].append((begin, self.fallback * len(raw), tuple(self.bytes[b] for b in raw)))
        return out

    def n_best(self, word: str, n: int) -> list[tuple[int, list[int]]]:
        """The n best segmentations of a word, (score, ids) from the best on."""
        edges = self.edges(word)
        best = [0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = max((best[b] + s for b, s, _ in edges[end]), default=None)
        heap = [(-best[-1], len(word), 0, 0, None)]  # among equal scores the path that has come farthest goes on
        found, made = [], 0
        while heap and len(found) < n:
            cost, at, _, tail, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found.append((-cost, ids))
                continue
            for b, s, ids in edges[at]:
                made += 1
                heapq.heappush(heap, (-(best[b] + s + tail), b, made, tail + s, (ids, path)))
        return found

    def two_best(self, word: str) -> tuple[list[int], int, int]:
        """(ids of the best segmentation, its score, score of the second or -1 below the best's range) by Viterbi with two scores a place.

        The pieces from a place on are met by a walk down the tree of their characters."""
        tree, n, low = self.tree, len(word), LOW
        best, second = [low] * (n + 1), [low] * (n + 1)
        back: list[tuple[int, int | tuple[int, ...]] | None] = [None] * (n + 1)
        best[0] = 0
        for begin in range(n):
            first, other, end = best[begin], second[begin], begin
            node = tree.get(word[begin])
            if node is None or node[0] is None:
                raw = word[begin].encode("utf-8", "surrogatepass")
                node = (self.fallback * len(raw), tuple(self.bytes[b] for b in raw), node and node[2])
            while node is not None:
                end += 1
                s, ids, after = node
                if s is not None:
                    x = first + s
                    if x > best[end]:
                        y = best[end]
                        second[end] = y if y > other + s else other + s
                        best[end], back[end] = x, (begin, ids)
                    elif x > second[end]:
                        second[end] = x
                if after is None or end == n:
                    break
                node = after.get(word[end])
        ids, at = [], n
        while at:
            at, own = back[at]
            ids.append(own)
        ids.reverse()
        if tuple in map(type, ids):
            ids = [i for own in ids for i in (own if isinstance(own, tuple) else (own,))]
        return ids, best[n], second[n]

    def learn(self, word: str) -> tuple[bytes, int, int]:
        """(ids, best score, gap to the second best or -1) of a word. Words met lately are kept in two generations."""
        out = self.old.get(word)
        if out is None:
            ids, score, second = self.two_best(word)
            out = (struct.pack(f"<{len(ids)}H", *ids), score, score - second if second > LOW // 2 else -1)
        if len(word) <= LONG:
            if len(self.cache) >= CACHE:
                self.old, self.cache = self.cache, {}
            self.cache[word] = out
        return out

    def learn_many(self, words: set[str]) -> None:
        """``learn`` for all of ``words`` that are not remembered: by the same search, a step of which is made for many words of one length at once."""
        new = words.difference(self.cache)
        new.difference_update(self.old)
        if len(self.cache) + len(new) > CACHE:
            self.old, self.cache = self.cache, {}
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        for n, own in by_length.items():
            if n > ALIKE:
                continue  # met one by one
            for k in range(0, len(own), TOGETHER):
                part = own[k : k + TOGETHER]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                codes = self.of_char[np.minimum(codes, 0xFFFF)]
                known = codes.all(axis=1)
                if known.any():
                    self._together([w for w, x in zip(part, known.tolist(), strict=True) if x], codes[known].T.astype(np.intp))

    def _together(self, words: list[str], codes: np.ndarray) -> None:
        """``two_best`` of words of one length, given their characters' numbers, a row for each place."""
        n, many = codes.shape
        best, second = np.full((n + 1, many), LOW), np.full((n + 1, many), LOW)
        back, piece = np.zeros((n + 1, many), np.int8), np.zeros((n + 1, many), np.uint16)
        best[0] = 0
        for begin in range(n):
            at, node = slice(None), self.after[1][codes[begin]]
            for end in range(begin + 1, n + 1):
                s = self.value[node]
                x, y, z = best[begin, at] + s, best[end, at], second[end, at]
                better = x > y
                second[end, at] = np.where(better, np.maximum(y, second[begin, at] + s), np.maximum(x, z))
                best[end, at] = np.where(better, x, y)
                back[end, at] = np.where(better, begin, back[end, at])
                piece[end, at] = np.where(better, self.id_of[node], piece[end, at])
                if end == n:
                    break
                node = self.after[np.where(node <= self.n_inner, node, 0), codes[end, at]]
                if not (on := np.flatnonzero(node)).size:
                    break
                at, node = on if isinstance(at, slice) else at[on], node[on]
        ids, length, at, all_ = np.zeros((many, n), "<u2"), np.zeros(many, np.intp), np.full(many, n), np.arange(many)
        while all_.size:
            length[all_] += 1
            ids[all_, n - length[all_]] = piece[at, all_]
            at = back[at, all_]
            all_, at = all_[at > 0], at[at > 0]
        raw, ends, gaps = ids.tobytes(), 2 * n * np.arange(1, many + 1), np.where(second[n] > LOW // 2, best[n] - second[n], -1)
        for w, begin, end, score, gap in zip(words, (ends - 2 * length).tolist(), ends.tolist(), best[n].tolist(), gaps.tolist(), strict=True):
            self.cache[w] = (raw[begin:end], score, gap)

    @classmethod
    def of(cls, path: str) -> Pieces:
        """This process's own; Spark's Python workers serve many tasks."""
        return held(("pieces", path), lambda: cls(path))

    def words(self, text: str) -> list[str]:
        return self.word.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, text: str | None, n: int = BEST) -> tuple[bytes, list[int]]:
        """The best segmentation as bytes of little-endian unsigned 16-bit ids, and the scores of the n best."""
        found = self.segmentations(text, n)
        return found[0][1], [score for score, _ in found]

    def segmentations(self, text: str | None, n: int = BEST) -> list[tuple[int, bytes]]:
        """The n best segmentations, (score, ids as bytes of little-endian unsigned 16-bit integers) from the best on."""
        if not text:
            return [(0, b"")]
        if SPACE in text:
            return self._with_marks(text, n)
        return self._chain(self.words(text), n)

    def segmentations_of(self, texts: list[str | None], n: int = BEST) -> Iterator[list[tuple[int, bytes]]]:
        """``segmentations`` of each text. Each distinct word of theirs is looked up once, and what stands in all places is gathered at once."""
        words = [self.words(t) if t and SPACE not in t else None for t in texts]
        flat = list(chain.from_iterable(filter(None, words)))
        number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
        infos = self._infos(number)
        codes = np.fromiter(map(number.__getitem__, flat), np.intp, len(flat))
        many = np.fromiter((len(x[0]) // 2 for x in infos), np.intp, len(infos))
        begin, own = np.cumsum(many) - many, many[codes]
        ends = np.cumsum(own)
        ids = np.frombuffer(b"".join([x[0] for x in infos]), "<u2")[np.repeat(begin[codes] - ends + own, own) + np.arange(own.sum())]
        bounds = np.concatenate([[0], ends])
        sums = np.concatenate([[0], np.cumsum(np.array([x[1] for x in infos], np.int64)[codes])])
        gaps, at = np.array([x[2] for x in infos], np.int64)[codes], 0
        for t, mine in zip(texts, words, strict=True):
            if mine is None:
                yield self.segmentations(t, n)
                continue
            end = at + len(mine)
            yield self._changed(mine, int(sums[end] - sums[at]), ids[bounds[at] : bounds[end]].tobytes(), 2 * (bounds[at : end + 1] - bounds[at]), gaps[at:end], n)
            at = end

    def _infos(self, words: Iterable[str]) -> list[tuple[bytes, int, int]]:
        self.learn_many(set(words))
        cache, learn = self.cache, self.learn
        return [cache.get(w) or learn(w) for w in words]  # a cache that is full goes on to serve this text

    def _chain(self, words: list[str], n: int) -> list[tuple[int, bytes]]:
        cache, learn = self.cache, self.learn
        infos = [cache.get(w) or learn(w) for w in words]
        bounds = np.cumsum([0, *(len(x[0]) for x in infos)])
        return self._changed(words, sum([x[1] for x in infos]), b"".join([x[0] for x in infos]), bounds, np.array([x[2] for x in infos]), n)

    def _changed(self, words: list[str], total: int, raw: bytes, bounds: np.ndarray, gaps: np.ndarray, n: int) -> list[tuple[int, bytes]]:
        """The n best of a text, of which the best is given: its score, ids as bytes, where each word's begin, and each word's gap."""
        if n < 2:
            return [(total, raw)]
        open_ = np.flatnonzero(gaps >= 0)
        # A text's n best change at most those words whose gaps are among the n - 1 least.
        at = open_[np.argsort(gaps[open_], kind="stable")[: n - 1]].tolist()
        others = [self._alternatives(words[k], n) for k in at]
        chosen: list[tuple[int, tuple[int, ...]]] = [(0, ())]
        for own in others:
            chosen = heapq.nsmallest(n, [(loss + more, (*path, i)) for loss, path in chosen for i, (more, _) in enumerate(own)])
        order = sorted(range(len(at)), key=at.__getitem__)
        between, begin = [], 0
        for x in order:
            between.append(raw[begin : bounds[at[x]]])
            begin = bounds[at[x] + 1]
        rest = raw[begin:]
        return [(total - loss, b"".join([y for x, same in zip(order, between, strict=True) for y in (same, others[x][path[x]][1])]) + rest) for loss, path in chosen]

    def _alternatives(self, word: str, n: int) -> list[tuple[int, bytes]]:
        """The n best segmentations of a word by A*: (loss against the best, ids)."""
        if (word, n) not in self.more:
            if len(self.more) >= MORE:
                self.more.clear()
            found = self.n_best(word, n)
            self.more[word, n] = [(found[0][0] - s, np.array(ids, "<u2").tobytes()) for s, ids in found]
        return self.more[word, n]

    def _with_marks(self, text: str, n: int) -> list[tuple[int, bytes]]:
        """A text that holds the mark of a space: the mark goes as bytes, what stands between is segmented."""
        raw = SPACE.encode()
        mark = np.array([self.bytes[b] for b in raw], "<u2").tobytes()
        # Only the choices are kept while parts are added, so ids are put together once.
        marks, chains = 0, []
        chosen: list[tuple[int, tuple | None]] = [(0, None)]
        for k, part in enumerate(text.split(SPACE)):
            words = self.words(part) if not k else self.word.findall(part.replace(" ", SPACE))
            marks += k > 0
            chains.append(self._chain(words, n) if words else [(0, b"")])
            ways = [(score + more, (i, path)) for score, path in chosen for i, (more, _) in enumerate(chains[-1])]
            chosen = heapq.nlargest(n, ways, key=lambda x: x[0])
        out = []
        for score, path in chosen:
            picked = []
            for chain in reversed(chains):
                i, path = path
                picked.append(chain[i][1])
            out.append((score + marks * self.fallback * len(raw), mark.join(reversed(picked))))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the space in front."""
        table = self.text
        text = b"".join(map(table.__getitem__, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id", best: int = BEST) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 16-bit integers), scores of the ``best`` best, decoded_sha256, round_trip,
    and of each of the ``best`` best in the order of ``scores``: best_n_pieces, best_ids_crc32, best_round_trips."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("scores", pa.list_(pa.int64())), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
         ("best_n_pieces", pa.list_(pa.int64())), ("best_ids_crc32", pa.list_(pa.int64())), ("best_round_trips", pa.list_(pa.bool_()))]
    )

    def run(batches):
        pieces = Pieces.of(model)
        for batch in (part for whole in batches for part in parts_of(whole, size=PART)):
            rows, texts = [], batch["text"].to_pylist()
            for t, found in zip(texts, pieces.segmentations_of(texts, best), strict=True):
                back = [pieces.decode(ids) for _, ids in found]
                n, crc, same = [len(ids) // 2 for _, ids in found], [zlib.crc32(ids) for _, ids in found], [b == (t or "") for b in back]
                rows.append((n[0], crc[0], [s for s, _ in found], hashlib.sha256(back[0].encode("utf-8", "surrogatepass")).hexdigest(), same[0], n, crc, same))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, scores array<long>, decoded_sha256 string, round_trip boolean, best_n_pieces array<long>, best_ids_crc32 array<long>, best_round_trips array<boolean>")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """op4: every document encoded and decoded."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model or default_model())
