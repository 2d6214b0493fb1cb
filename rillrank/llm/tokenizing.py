"""Exact tokenisation of whole texts with the ``tokenizers`` library, each distinct piece encoded once.

Both encoders cut texts only at boundaries that no token of their tokenizer can cross, so that joining the pieces'
tokens gives what the library gives for the whole text (special strings inside texts included):

* byte-level BPE: before a single space, and around a single line feed, that stands between two other non-space
  characters;
* word BPE that drops white space: at every run of ASCII white space.

Pieces are kept in a cache of the Python worker that is emptied, or thinned to the most used words, once it holds more
than a fixed number of bytes, so it takes at most these and one slice's pieces.  A piece made of Latin letters and
trailing punctuation goes straight to the library's BPE model (its pre-tokenizer would give just these two parts);
every other piece goes through the library's whole ``encode_batch``.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from rillrank.llm.common import kept
from rillrank.llm.words import WordIds, distinct, strings

#: Bytes of a worker's piece cache before it is emptied, pieces counted with what Python needs to hold them.
CACHE_BYTES = 60 << 20
#: Bytes that a piece of the cache takes beside its characters, about.
ENTRY_BYTES = 140
#: Bytes of pieces given to one encode_batch call.
ENCODE_BYTES = 1 << 18

#: Latin letters, then any ASCII marks but the apostrophe (contractions) and "<" (special strings).
_LETTERS_THEN_STOPS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]*)")
_SAFE_LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
_SAFE_SPACE = re.compile(r" (?<=\S )(?=\S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


def _stand_ins(text: str) -> str:
    return text if text.isascii() and " " not in text else text.encode().decode("latin-1").translate(_BYTE_LETTERS)


class _Pieces:
    """Ids of pieces by text, with a bounded cache."""

    def __init__(self, serialised: str, lower: bool, keep_words: bool):
        self.keep_words = keep_words
        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.lower = lower
        self.parts: dict[str, list[int]] = {}
        self.held = 0

    def _part(self, text: str) -> list[int]:
        ids = self.parts.get(text)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(_stand_ins(text))]
            if self.keep_words or len(text) <= 4:
                self.parts[text] = ids
                self.held += len(text) + 32 * len(ids) + ENTRY_BYTES
        return ids

    def ids(self, pieces: list[str], prefix: str = "") -> list[list[int]]:
        """The ids of every piece, each with ``prefix`` before it."""
        out: list = [None] * len(pieces)
        slow: list[int] = []
        for i, piece in enumerate(pieces):
            plain = _LETTERS_THEN_STOPS.fullmatch(piece)
            if plain is None:
                slow.append(i)
                continue
            word, stops = plain.groups()
            ids = self._part(prefix + (word.lower() if self.lower else word))
            out[i] = ids + self._part(stops) if stops else ids
        start = 0
        while start < len(slow):
            end, held = start, 0
            while end < len(slow) and (end == start or held < ENCODE_BYTES):
                held += len(pieces[slow[end]])
                end += 1
            found = self.tokenizer.encode_batch([prefix + pieces[i] for i in slow[start:end]], add_special_tokens=False)
            for i, encoding in zip(slow[start:end], found, strict=True):
                out[i] = encoding.ids
            start = end
        if self.held >= CACHE_BYTES // 2:
            self.parts.clear()
            self.held = 0
        return out


class ByteBpeCounter:
    """Counts the tokens of whole texts under a byte-level BPE (GPT-2 style) tokenizer."""

    def __init__(self, serialised: str):
        self.pieces = _Pieces(serialised, lower=False, keep_words=True)
        self.known: dict[str, dict[str, int]] = {"": {}, " ": {}}
        self.held = {"": 0, " ": 0}
        self.line = len(self.pieces.ids(["\n"])[0])

    def _learn(self, prefix: str, pieces: set[str]) -> None:
        known = self.known[prefix]
        if self.held[prefix] > CACHE_BYTES:
            known.clear()
            self.held[prefix] = 0
        new = [p for p in pieces if p not in known]
        self.held[prefix] += sum(map(len, new)) + ENTRY_BYTES * len(new)
        known.update(zip(new, map(len, self.pieces.ids(new, prefix)), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty."""
        cut = []
        for text in texts:
            bare, spaced, lines = [], [], 0
            if text:
                for line in _SAFE_LINE.split(text):
                    first, *rest = _SAFE_SPACE.split(line)
                    bare.append(first)
                    spaced += rest
                    lines += 1
            cut.append((bare, spaced, max(lines - 1, 0)))
        self._learn("", {p for bare, _, _ in cut for p in bare})
        self._learn(" ", {p for _, spaced, _ in cut for p in spaced})
        first, later = self.known[""].__getitem__, self.known[" "].__getitem__
        return [sum(map(first, bare)) + sum(map(later, spaced)) + self.line * lines for bare, spaced, lines in cut]


class WordBpeEncoder:
    """Encodes whole texts with a BPE tokenizer that lower-cases and drops white space."""

    #: Its words are cached once, without a second cache of parts, so there is room for more of them.
    CACHE_BYTES = 120 << 20

    def __init__(self, serialised: str):
        self.pieces = _Pieces(serialised, lower=True, keep_words=False)
        self.words = WordIds(self.CACHE_BYTES, ENTRY_BYTES, 1)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text; null counts as empty."""
        # Cut at ASCII white space only: other white space stays inside a word, which the whole pipeline encodes.
        return self.words.ids(*distinct(pc.ascii_split_whitespace(strings(texts))), self.pieces.ids)


def instance(kind: type, serialised: str) -> ByteBpeCounter | WordBpeEncoder:
    """This worker's counter or encoder, kept between tasks with its cache; any other operator replaces it.

    Tasks must call this function instead of holding the cache in a closure, which would be unpickled anew each time.
    """
    return kept(f"{kind.__name__}:{zlib.crc32(serialised.encode())}", lambda: kind(serialised))
