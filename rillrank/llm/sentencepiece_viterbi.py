"""SentencePiece encoding and decoding (3): shared-prefix Viterbi over a trie of distinct marked words.

Spaces become the mark U+2581 and a text is cut before every run of marks and around characters that no piece holds; no piece
crosses such a cut, so the words between are encoded alone.  The distinct words of a batch are sorted, which lays
them out as a trie in depth-first order: a word resumes at the forward states of the prefix it shares with the word
before it, and only its own characters are computed.

* Unigram models: the forward state of a prefix is its best score and last piece (largest sum of piece scores).
* BPE models: the best segmentation isn't the largest sum of scores but what the merges give, so the forward state
  of a prefix is the last piece of its merge segmentation.  A sequence of pieces is what the merges give exactly if
  every two neighbours are what the merges give for the two together, so one piece alone fits each prefix, and the
  state again depends on the prefix only.  Whether two pieces may be neighbours is computed once a pair.

Characters that no piece holds fall back to bytes, or to the unknown piece where the model has no byte pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import kept, slices
from rillrank.llm.words import WordIds, distinct, strings

MARK = "▁"
#: Bytes of a worker's word cache before it is thinned to the most used words, words counted with what Python needs to hold them.
CACHE_BYTES = 50 << 20
#: Bytes that a word takes beside its characters (two bytes each, for the mark) and ids, about.
ENTRY_BYTES = 180
#: Entries of the cache of neighbours, each of fixed size: about 40 MB.
NEIGHBOUR_ENTRIES = 400_000
#: Bytes of text in a slice: words, ids and decoded texts of a slice are Python objects for a moment.
SLICE_BYTES = 1 << 20

_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protocol buffer message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    at = 0
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a SentencePiece model file with identity normalisation."""

    def __init__(self, serialised: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix = _UNIGRAM, True
        for number, value in _fields(serialised):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                self.dummy_prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("only identity normalisation that keeps and marks spaces is supported")
        if self.kind not in (_UNIGRAM, _BPE) or {_USER, _UNUSED} & set(self.kinds):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _NORMAL}
        self.unknown = self.kinds.index(_UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.characters = {c for p in self.ids for c in p}
        self.longest: dict[str, int] = {}  # by last character
        for p in self.ids:
            self.longest[p[-1]] = max(self.longest.get(p[-1], 0), len(p))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a mark after another character")


class Viterbi:
    """Encodes and decodes whole texts with a model."""

    def __init__(self, serialised: bytes):
        self.model = Model(serialised)
        self.words = WordIds(CACHE_BYTES, ENTRY_BYTES, 2)
        self.neighbours: dict[int, bool] = {}
        foreign = "" if "\n" in self.model.characters else "\n"
        self.foreign = foreign
        self._word = re.compile(f"{MARK}*[^{MARK}{foreign}]+|{MARK}+" + (f"|{foreign}" if foreign else ""))
        self._texts = [self._text_of(i) for i in range(len(self.model.pieces))]

    def _text_of(self, piece: int) -> bytes:
        kind, text = self.model.kinds[piece], self.model.pieces[piece]
        if kind == _BYTE:
            return bytes([int(text[3:5], 16)])
        return text.replace(MARK, " ").encode() if kind == _NORMAL else " ⁇ ".encode() if kind == _UNKNOWN else b""

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the neighbours whose union scores highest, the leftmost first."""
        symbols = list(text)
        ids, scores = self.model.ids, self.model.scores
        while True:
            best, where = -np.inf, -1
            for i in range(len(symbols) - 1):
                piece = ids.get(symbols[i] + symbols[i + 1])
                if piece is not None and scores[piece] > best:
                    best, where = scores[piece], i
            if where < 0:
                return symbols
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges give these two pieces for their joined text (left may be -1: nothing, or a foreign one)."""
        pieces = self.model.pieces
        text = [pieces[right]] if left < 0 else [pieces[left], pieces[right]]
        return self.merged("".join(text)) == text

    def _fallback(self, character: str) -> list[int]:
        if not self.model.bytes:
            return [self.model.unknown]
        return [self.model.bytes[b] for b in character.encode("utf-8", "surrogatepass")]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words, depth first over the trie that they make when sorted."""
        walk = self._merge_states if self.model.kind == _BPE else self._best_states
        # State of the prefix of i characters: last piece (-1: none or foreign), where that piece starts, best score.
        last, start, best = [-1], [0], [0.0]
        before, found = "", {}
        for word in sorted(words):
            shared, limit = 0, min(len(word), len(before))
            while shared < limit and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], start[shared + 1 :], best[shared + 1 :]
            walk(word, shared, last, start, best)
            path, end = [], len(word)
            while end:
                piece, begin = last[end], start[end]
                if piece >= 0:
                    path.append(piece)
                else:
                    path += reversed(self._fallback(word[begin:end]))
                end = begin
            path.reverse()
            found[word] = path
            before = word
        if len(self.neighbours) > NEIGHBOUR_ENTRIES:
            self.neighbours.clear()
        return [found[word] for word in words]

    def _merge_states(self, word: str, shared: int, last: list[int], start: list[int], best: list[float]) -> None:
        """BPE: the states of a word's prefixes longer than ``shared``."""
        get, reach, fits = self.model.ids.get, self.model.longest.get, self.neighbours
        known = fits.get
        for end in range(shared + 1, len(word) + 1):
            piece_last, piece_start = -1, end - 1
            # The last piece is mostly short: the nearest begin comes first.
            for begin in range(end - 1, max(end - reach(word[end - 1], 0), 0) - 1, -1):
                piece = get(word[begin:end])
                if piece is None:
                    continue
                pair = last[begin] << 32 | piece
                fit = known(pair)
                if fit is None:
                    fit = fits[pair] = self._fit(last[begin], piece)
                if fit:
                    piece_last, piece_start = piece, begin
                    break
            last.append(piece_last)
            start.append(piece_start)

    def _best_states(self, word: str, shared: int, last: list[int], start: list[int], best: list[float]) -> None:
        """Unigram: the states of a word's prefixes longer than ``shared``."""
        get, reach, scores = self.model.ids.get, self.model.longest.get, self.model.scores
        low = min(scores, default=0.0) - 10.0
        for end in range(shared + 1, len(word) + 1):
            piece_last, piece_start, score = -1, end - 1, best[end - 1] + low
            for begin in range(end - 1, max(end - reach(word[end - 1], 0), 0) - 1, -1):
                piece = get(word[begin:end])
                if piece is not None and best[begin] + scores[piece] > score:
                    piece_last, piece_start, score = piece, begin, best[begin] + scores[piece]
            last.append(piece_last)
            start.append(piece_start)
            best.append(score)

    def _cut(self, texts: pa.Array) -> pa.Array:
        """The words of every text, which concatenated are the text with marks for spaces."""
        prefix = MARK if self.model.dummy_prefix else ""
        # Single spaces and lines are cut in Arrow: once all spaces are marks, a space can stand for a cut.
        odd = pc.or_(pc.match_substring_regex(texts, f"  |^ |{MARK}"), pc.equal(pc.binary_length(texts), 0))
        marked = pc.replace_substring(texts, " ", f" {MARK}")
        if self.foreign:
            marked = pc.replace_substring(marked, self.foreign, f" {self.foreign} ")
        marked = pc.binary_join_element_wise(pa.scalar(prefix, texts.type), marked, pa.scalar("", texts.type))
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.fill_null(False).to_numpy(zero_copy_only=False))
            others = [t and " ".join(self._word.findall(prefix + t.replace(" ", MARK))) for t in texts.take(pa.array(rows)).to_pylist()]
            marked = pc.replace_with_mask(marked, odd.fill_null(False), pa.array(others, texts.type))
        return pc.split_pattern(marked, " ")

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of ids of each text; null counts as empty."""
        flat, counts = self.words.ids(*distinct(self._cut(strings(texts))), self.encode_words)
        return flat.view(np.int32), counts

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that aren't valid UTF-8 become U+FFFD, control pieces vanish, marks become spaces."""
        text = b"".join(map(self._texts.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _viterbi(serialised: bytes) -> Viterbi:
    """This worker's encoder, kept between tasks with its caches."""
    return kept(f"Viterbi:{zlib.crc32(serialised)}", lambda: Viterbi(serialised))


def encode_decode(
    docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """``id_col, n_pieces, piece_ids, ids_crc32, round_trip`` (and ``decoded``) per row of whole texts.

    ``ids_crc32`` is the CRC of the ids as little-endian 32-bit integers; ``round_trip`` says that decoding the ids
    gives the text back (marks U+2581 inside a text come back as spaces, so such a text doesn't).  Map-only.

    Edge cases: null and empty texts have no pieces and decode to the empty text (a null one counts as a round trip of
    empty); texts with any character are encoded through byte pieces; repeated rows repeat their result; null ids stay
    null; an empty table gives an empty result; other columns are ignored.
    """
    with open(model_path, "rb") as file:
        serialised = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = _viterbi(serialised.value)
        for batch in slices(batches, "text", SLICE_BYTES, keep=True):
            texts = batch.column("text").to_pylist()
            flat, counts = viterbi.encode(batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(counts)])
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            listed = flat.tolist()
            decoded = [viterbi.decode(listed[s:e]) for s, e in spans]
            words = flat.astype("<u4")
            columns = [
                batch.column("id"),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                pa.array([zlib.crc32(words[s:e]) for s, e in spans], pa.int64()),
                pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(decoded, pa.string())] * with_text, names)

    names = ["id", "n_pieces", "piece_ids", "ids_crc32", "round_trip"] + ["decoded"] * with_text
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_pieces long, piece_ids array<int>, ids_crc32 long, round_trip boolean"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = rows.mapInArrow(encode, schema + ", decoded string" * with_text)
    return out.select(F.col("id").alias(id_col), *names[1:])
