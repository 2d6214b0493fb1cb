"""Word shingles and MinHash signatures of whole texts, computed on Arrow batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z are lower-cased (every other byte,
non-ASCII letters included, is left alone).  A shingle is ``width`` consecutive words; a text with at least one word
but fewer than ``width`` has one shingle, its whole word sequence; a text without words (null, empty, blank) has none.
Shingles are represented by 64-bit hashes: words are hashed with xxhash64 and the hashes of a shingle are combined
with per-position odd multipliers and a finaliser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_U64 = np.uint64


def _odd_constants(count: int, salt: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(salt + str(i).encode()) | 1 for i in range(count)], dtype=_U64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h ^= h >> _U64(29)
    h *= _U64(0xC4CEB9FE1A85EC53)
    h ^= h >> _U64(32)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """xxhash64 of each word; every distinct word is hashed once."""
    if not words:
        return np.zeros(0, dtype=_U64)
    coded = pa.array(words, type=pa.large_binary()).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=_U64)
    return table[coded.indices.to_numpy()]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a batch."""
    multipliers = _odd_constants(width, b"shingle")
    words, ends = [], []
    for text in texts:
        if text:
            words += text.encode("utf-8", "surrogatepass").lower().split()
        ends.append(len(words))
    hashes = word_hashes(words)
    rolled = np.zeros(max(len(hashes) - width + 1, 0), dtype=_U64)
    for j in range(width):
        rolled += hashes[j : j + len(rolled)] * multipliers[j]
    rolled = _mix(rolled)
    out, start = [], 0
    for end in ends:
        n = end - start
        if n >= width:
            out.append(np.unique(rolled[start : end - width + 1]))
        elif n:
            short = (hashes[start:end] * multipliers[:n]).sum(dtype=_U64) + _U64(n)
            out.append(_mix(np.array([short], dtype=_U64)))
        else:
            out.append(np.zeros(0, dtype=_U64))
        start = end
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """A (documents, coordinates) array of 32-bit MinHash values; rows of empty sets are zero."""
    out = np.zeros((len(sets), coordinates), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    xors, multipliers = _odd_constants(coordinates, b"xor"), _odd_constants(coordinates, b"multiply")
    work = np.empty_like(flat)
    for c in range(coordinates):
        np.bitwise_xor(flat, xors[c], out=work)
        np.multiply(work, multipliers[c], out=work)
        least = np.minimum.reduceat(work, starts)
        out[full, c] = (_mix(least) >> _U64(32)).astype(np.uint32)
    return out
