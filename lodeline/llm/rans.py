"""Static range asymmetric numeral system over token ids, with interleaved lanes, in numpy.

All blocks share one frequency table. A block holds up to ``BLOCK`` ids in ``LANES`` interleaved states of 64
bits; step t codes ids t * LANES ... so that each step is a vector operation. A block needs nothing of another,
so blocks may be decoded in parallel.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, BLOCK = 4096, 1 << 20
LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
#: Ids of a block, its 32-bit words, lanes, CRC-32 of the ids as little-endian unsigned 32-bit integers.
_HEAD = struct.Struct("<IIII")


def shares(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to 2**bits, at least 1 for each id that occurs."""
    total, size = int(counts.sum()), 1 << bits
    used = np.flatnonzero(counts)
    if len(used) > size:
        raise ValueError(f"{len(used)} ids do not fit {bits} bits")
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    out[used] = np.maximum(1, (counts[used].astype(np.float64) * size / total).astype(np.int64))
    over = int(out.sum()) - size
    while over:
        order = used[np.argsort(-out[used], kind="stable")]
        if over < 0:
            out[order[0]] -= over
            break
        for k in order:
            cut = min(over, max(0, int(out[k]) // 2), int(out[k]) - 1)
            out[k] -= cut
            over -= cut
            if not over:
                break
    return out


class Table:
    """Frequencies, their prefix sums and the id of each slot."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    @classmethod
    def of(cls, counts: np.ndarray, bits: int = 18) -> Table:
        return cls(shares(counts, bits), bits)

    def dump(self) -> bytes:
        body = struct.pack("<II", self.bits, len(self.freq)) + zlib.compress(self.freq.astype("<u4").tobytes())
        return b"LTAB" + struct.pack("<I", zlib.crc32(body)) + body

    @classmethod
    def load(cls, raw: bytes) -> Table:
        if raw[:4] != b"LTAB" or struct.unpack("<I", raw[4:8])[0] != zlib.crc32(raw[8:]):
            raise ValueError("not a frequency table, or damaged")
        bits, n = struct.unpack("<II", raw[8:16])
        freq = np.frombuffer(zlib.decompress(raw[16:]), "<u4").astype(np.int64)
        if len(freq) != n:
            raise ValueError("frequency table has another length")
        return cls(freq, bits)

    def encode(self, ids: np.ndarray) -> bytes:
        """One block."""
        n = len(ids)
        lanes = max(1, min(LANES, n))
        state = np.full(lanes, LOW, np.uint64)
        bits, full = np.uint64(self.bits), np.uint64(63 - self.bits)
        words: list[np.ndarray] = []
        for at in range((max(n, 1) - 1) // lanes * lanes, -1, -lanes):
            s = ids[at : at + lanes]
            f, c, x = self.freq[s], self.start[s], state[: len(s)]
            if len(f) and not f.all():
                raise ValueError("an id is not in the frequency table")
            put = x >= (f << full)
            if put.any():
                words.append((x[put] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x = np.where(put, x >> _U32, x)
            q = x // f
            state[: len(s)] = (q << bits) + (x - q * f) + c
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = _HEAD.pack(n, len(stream), lanes, zlib.crc32(ids.astype("<u4").tobytes()))
        return head + state.astype("<u8").tobytes() + stream.tobytes()

    def decode(self, raw: bytes, at: int = 0) -> np.ndarray:
        """The ids of the block that begins at a byte, checked against its checksum."""
        n, n_words, lanes, crc = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        state = np.frombuffer(raw, "<u8", lanes, at).astype(np.uint64)
        stream = np.frombuffer(raw, "<u4", n_words, at + 8 * lanes)
        out = np.empty(n, np.uint32)
        bits, mask, read = np.uint64(self.bits), np.uint64((1 << self.bits) - 1), 0
        for k in range(0, n, lanes):
            x = state[: min(lanes, n - k)]
            slot = x & mask
            s = self.slot[slot]
            out[k : k + len(s)] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            get = np.flatnonzero(x < LOW)
            if len(get):
                x[get] = (x[get] << _U32) | stream[read : read + len(get)].astype(np.uint64)
                read += len(get)
            state[: len(s)] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        return out


def block_size(raw: bytes, at: int) -> int:
    _, n_words, lanes, _ = _HEAD.unpack_from(raw, at)
    return _HEAD.size + 8 * lanes + 4 * n_words
