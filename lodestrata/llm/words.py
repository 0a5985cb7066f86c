"""Words of many texts at once as arrays: places and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: The white space that parts words (space, tab to carriage return).
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
#: Bytes up to which words are hashed side by side; longer ones are hashed one by one.
LONG = 128
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Stafford's 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words in the order of the texts: byte places [start, end), text number, hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    n_docs: int
    at: np.ndarray  # lanes of the data

    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def hash_spans(data: np.ndarray, at: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever it stands; `at` are the lanes of `data`.

    Eight bytes at a time go through the finaliser; no sum of powers, which repetitive words could make equal.
    """
    out = mix((at[start] & _MASKS[np.minimum(length, 8)]) + length.astype(_U) * _U(_RADIX))
    some, done = np.arange(len(start)), 8
    while len(some := some[length[some] > done]) and done < LONG:
        lane = at[start[some] + done] & _MASKS[np.minimum(length[some] - done, 8)]
        out[some] = mix(out[some] * _U(_RADIX) + lane)
        done += 8
    for i in some.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts that lie between `offsets` in `data`."""
    data = LOWER[data] if lower else data
    n = len(data)
    solid = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    at = lanes(data)
    return Words(data, start, end, doc, hash_spans(data, at, start, end - start), len(offsets) - 1, at)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n words within one text."""
    m = len(words.start) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    total = np.zeros(len(at), _U)
    for k in range(n):
        total = total * _U(_RADIX) + words.hash[at + k]
    return at, mix(total)
