"""Words of whole batches of texts at once, by Arrow's kernels; Python meets each distinct word of a batch once.

Null texts have no words; an empty batch has none; a text of any length is one list of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows of a part of a batch, and bytes of text in it (but for a single longer text).
ROWS, BYTES = 20_000, 8 << 20


def parts_of(batch: pa.RecordBatch, column: str = "text", rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in smaller ones, so that what is made of it stays small."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(lengths), 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, min(begin + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, distinct words): words are parted by ASCII white space, text i has codes[offsets[i]:offsets[i + 1]]; A-Z are lower-cased."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    offsets = offsets - offsets[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if empty >= 0:  # beside white space at a text's ends
        real = codes != empty
        before = np.concatenate([[0], np.cumsum(real)])
        codes, offsets = codes[real], before[offsets]
    return codes, offsets, words


def strings_of(words: pa.Array) -> list[str]:
    """``to_pylist`` of a whole string array of 32-bit offsets, in a fraction of its time."""
    if not len(words):
        return []
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    raw = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[at - at[0]].tolist()  # characters before each byte
    text = raw.tobytes().decode()
    return [text[i:j] for i, j in zip(before, before[1:], strict=False)]


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words (a whole array of 32-bit offsets, as of ``coded_words``)."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset).tolist() if len(words) else [0]
    raw, digest = data.to_pybytes() if data else b"", xxhash.xxh3_64_intdigest
    return np.array([digest(raw[i:j]) for i, j in zip(at, at[1:], strict=False)], np.uint64)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the lower-cased words of texts."""
    codes, offsets, words = coded_words(texts)
    return (hashes_of(words)[codes] if len(words) else np.zeros(0, np.uint64)), offsets
