"""Texts of an Arrow batch as byte arrays: words, shingles and their hashes, in numpy.

Hashes are 64 bits wide, the same in every process, and made of whole words; nothing here
depends on how rows fall into batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once; longer texts form a piece of their own.
PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z is lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Words of more bytes are hashed one by one.
LONG = 64
#: By a number of bytes, the bits that hold them.
_HELD = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Told apart from hashes of whole words.
_STEM = np.uint64(0x5851F42D4C957F2D)

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), or those of its inverse, modulo 2 ** 64."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mixed(z: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text starts and ends; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first text, end, bytes, offsets."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


class Words:
    """The words of a run of texts: hash, text number, first byte, end, and words per text.

    Where hashes stand for the words themselves, key is a number that nobody can know before
    the call, so that no words can be made up that share a hash.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray, key: int = 0):
        n, texts = len(data), len(at) - 1
        low = LOWER[data]
        inside = kind[low]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = at[1:] > at[:-1]
        first[at[:-1][full]] = inside[at[:-1][full]]
        last[at[1:][full] - 1] = inside[at[1:][full] - 1]
        self.bytes = low
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.text = np.searchsorted(at, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=texts)
        padded = np.concatenate([low, np.zeros(8, dtype=np.uint8)])
        self._eights = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
        self.key = np.uint64(key)
        self.hash = self._hashed(self.start, self.end)

    def _hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes, eight bytes a round; equal sizes of up to eight never collide."""
        size = end - start
        out = mixed(mixed(size.astype(np.uint64) + np.uint64(_BASE)) ^ self.key) if self.key else mixed(size.astype(np.uint64) + np.uint64(_BASE))
        going = np.flatnonzero((size <= LONG) & (size > 0))
        done = 0
        while len(going):
            left = size[going] - done
            bits = self._eights[start[going] + done] & _HELD[np.minimum(left, 8)]
            out[going] = mixed(out[going] ^ bits)
            done += 8
            going = going[left > 8]
        for i in np.flatnonzero(size > LONG).tolist():
            secret = int(self.key).to_bytes(8, "little") if self.key else b""
            out[i] = int.from_bytes(hashlib.blake2b(self.bytes[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
        return out

    def __len__(self) -> int:
        return len(self.hash)

    def prefix(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words' first k bytes, and which words are longer than that."""
        longer = self.end - self.start > k
        start = self.start[longer]
        out = np.zeros(len(self), dtype=np.uint64)
        out[longer] = self._hashed(start, start + k) ^ _STEM
        return out, longer


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbouring values, order counting."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + n])
    return out


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole sequence as the one shingle, one without words none.
    """
    every = chained(words.hash, k)
    ends = np.cumsum(words.count)
    out = []
    for end, n in zip(ends.tolist(), words.count.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(every[end - n : end - k + 1]))
        else:
            out.append(chained(words.hash[end - n : end], n) if n else every[:0])
    return out
