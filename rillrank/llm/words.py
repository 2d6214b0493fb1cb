"""Words of a batch of texts and a bounded cache of their ids, for encoders that take texts word by word."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def strings(texts: pa.Array | list[str | None]) -> pa.Array:
    """Texts as an Arrow array whose offsets hold whatever becomes of them."""
    return texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())


def distinct(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of words: the distinct words, which of them every word is, and how many words there are up to each list's end.

    Empty words and null lists count for nothing.
    """
    ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    # By way of NumPy, Python strings are made seven times as fast as by to_pylist.
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:
        blank = words.index("")
        full = codes != blank
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(full)])[ends]
        codes = codes[full]
        codes = codes - (codes > blank)
        del words[blank]
    return words, codes, ends


class WordIds:
    """Ids of words.  Beyond ``limit`` bytes only the most used words stay, half as many bytes."""

    def __init__(self, limit: int, entry: int, width: int):
        """``entry``: bytes that a word takes beside its characters and ids; ``width``: bytes of a character, about."""
        self.limit, self.entry, self.width = limit, entry, width
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.uint32)
        self.used = np.zeros(0, dtype=np.int64)
        self.held = 0

    def _sizes(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        return self.entry + self.width * np.fromiter(map(len, words), np.int64, len(words)) + 4 * lengths

    def _thin(self) -> None:
        words, lengths = list(self.known), np.diff(self.starts)
        sizes = self._sizes(words, lengths)
        order = np.lexsort((sizes, -self.used))
        kept = np.sort(order[np.cumsum(sizes[order]) <= self.limit // 2])
        self.store = self.store[np.repeat(np.isin(np.arange(len(words)), kept), lengths)]
        self.starts = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths[kept])])
        self.used = self.used[kept] >> 1
        self.held = int(sizes[kept].sum())
        self.known = {words[k]: i for i, k in enumerate(kept.tolist())}

    def ids(
        self, words: list[str], codes: np.ndarray, ends: np.ndarray, learn: Callable[[list[str]], list[list[int]]]
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each list, of what ``distinct`` gives; ``learn`` finds new words' ids."""
        if self.held > self.limit:
            self._thin()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            found = learn(new)
            at[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, at[missing].tolist(), strict=True))
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.store = np.concatenate([self.store, flat])
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
            self.held += int(self._sizes(new, lengths).sum())
        self.used[at] += np.bincount(codes, minlength=len(words))
        index = at[codes]
        first = self.starts[index]
        lengths = self.starts[index + 1] - first
        total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths)])
        ids = self.store[np.repeat(first - total[:-1], lengths) + np.arange(total[-1])]
        return ids, np.diff(total[ends], prepend=0)
