"""Benchmark decontamination (10): an FM-index of each training shard, searched backwards for benchmark phrases.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A window is ``width`` consecutive words
of a benchmark item, or all words of a shorter item.  A shard is a slice of whole documents inside one task.  Its text
is first reduced without loss: a run of document words that all occur in the benchmark and that is at least as long as
the shortest window is kept, everything else becomes one separator, because no window can touch it.  Over the reduced
text the shard's suffix array, Burrows-Wheeler transform and wavelet matrix are built; all distinct windows are
searched backwards together through the matrix's ranks; occurrences are located by walking to sampled suffix
positions and merged into removal spans.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import slices, written

#: Benchmark bytes searched in one pass; a larger benchmark is searched in as many passes as it takes.
BLOCK_BYTES = 8 << 20
#: Text bytes of a shard.
SHARD_BYTES = 12 << 20
#: Every so many positions of a reduced text keep their suffix position.
SAMPLE = 8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Separator bytes become spaces, A-Z lower case, digits, a-z and bytes of non-ASCII characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The folded words of a text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _by_name(name: str | None) -> tuple[bool, str]:
    """Order of item ids: as strings, a null one last."""
    return name is None, name or ""


class Phrases:
    """The distinct windows of a block of benchmark items (ids and words), as symbols of the block's vocabulary."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        self.symbols: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items}, key=_by_name)
        number = {name: i for i, name in enumerate(self.names)}
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            coded = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words]
            for start in range(max(len(coded) - width, 0) + 1 if coded else 0):
                owners.setdefault(tuple(coded[start : start + width]), set()).add(number[name])
        windows = list(owners)
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        self.words = np.zeros((len(windows), width), dtype=np.int64)
        for i, window in enumerate(windows):
            self.words[i, : len(window)] = window
        self.owners = np.array([o for w in windows for o in sorted(owners[w])], dtype=np.int64)
        self.owner_starts = np.cumsum([0] + [len(owners[w]) for w in windows])


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per bit of the alphabet, packed into 64-bit words with a count of
    the ones before each word (12 bytes for 64 symbols and bit)."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        for bit in reversed(range(max(int(symbols - 1).bit_length(), 1))):
            ones = ((sequence >> bit) & 1).astype(bool)
            packed = np.zeros(len(sequence) // 64 + 1, dtype="<u8")
            bits = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(bits)] = bits
            before = np.zeros(len(packed), dtype=np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((bit, packed, before, len(sequence) - int(ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def ranks(self, symbols: np.ndarray, ends: list[np.ndarray]) -> list[np.ndarray]:
        """For each array of ``ends``: how often ``symbols[i]`` occurs before position ``ends[i]``."""
        tracked = [np.zeros_like(symbols), *ends]
        for bit, packed, before, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            moved = []
            for t in tracked:
                word = t >> 6
                below = (np.uint64(1) << (t & 63).astype(np.uint64)) - np.uint64(1)
                counts = before[word] + np.bitwise_count(packed[word] & below).astype(np.int64)
                moved.append(np.where(one, zeros + counts, t - counts))
            tracked = moved
        return [t - tracked[0] for t in tracked[1:]]


class FmIndex:
    """An FM-index of runs of symbols (1 and up), every run followed by a separator (0)."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        separators = text == 0
        # Separators sort by position, so repeats end with their run and doubling needs log2(longest run) rounds.
        rank = np.where(separators, np.cumsum(separators) - 1, int(separators.sum()) + text)
        step = 1
        while True:
            after = np.zeros(n, dtype=np.int64)
            after[: max(n - step, 0)] = rank[step:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        self.transform = text[order - 1]
        self.before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(np.bincount(text, minlength=symbols))])
        self.matrix = WaveletMatrix(self.transform, symbols)
        run_starts = np.concatenate([np.ones(1, dtype=bool), separators[:-1]])
        kept = (order % SAMPLE == 0) | run_starts[order]
        self.sampled = np.where(kept, order, -1)

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all windows together: windows that occur, and their ranges of suffixes."""
        window = np.arange(len(lengths))
        low, high = np.zeros(len(lengths), dtype=np.int64), np.full(len(lengths), len(self.transform), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = lengths.copy()
        while len(window):
            symbols = words[window, left - 1]
            low, high = self.matrix.ranks(symbols, [low, high])
            low, high, left = self.before[symbols] + low, self.before[symbols] + high, left - 1
            found, alive = (left == 0) & (high > low), (left > 0) & (high > low)
            done.append((window[found], low[found], high[found]))
            window, low, high, left = window[alive], low[alive], high[alive], left[alive]
        if not done:
            return (np.zeros(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in the ranges, in order of the ranges."""
        counts = high - low
        first = np.cumsum(counts) - counts
        rows = np.arange(int(counts.sum())) - np.repeat(first - low, counts)
        positions, steps = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = self.sampled[rows[open_]]
            ends = at >= 0
            positions[open_[ends]] = at[ends] + steps[open_[ends]]
            open_ = open_[~ends]
            symbols = self.transform[rows[open_]]
            rows[open_] = self.before[symbols] + self.matrix.ranks(symbols, [rows[open_]])[0]
            steps[open_] += 1
        return positions


def _shard_hits(
    texts: list[str | None], phrases: Phrases
) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
    """Words of each document, and by document with hits its merged word spans and its items."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    runs, homes, places = [], [], []
    get = phrases.symbols.get
    for i, text in enumerate(texts):
        words = words_of(text)
        n_words[i] = len(words)
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        coded = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], coded != 0, [0]]).astype(np.int8)))
        for start, end in edges.reshape(-1, 2):
            if end - start >= phrases.shortest:
                runs += [coded[start:end], [0]]
                homes += [i] * (end - start + 1)
                places += range(start, end + 1)
    if not runs:
        return n_words, {}, {}
    text_, home, place = np.concatenate(runs).astype(np.int64), np.array(homes), np.array(places)
    index = FmIndex(text_, len(phrases.symbols) + 1)
    window, low, high = index.search(phrases.words, phrases.lengths)
    if not len(window):
        return n_words, {}, {}
    position = index.locate(low, high)
    window = np.repeat(window, high - low)
    change = np.zeros(len(text_) + 1, dtype=np.int64)
    np.add.at(change, position, 1)
    np.add.at(change, position + phrases.lengths[window], -1)
    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    spans: dict[int, list[tuple[int, int]]] = {}
    for start, end in np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2).tolist():
        spans.setdefault(int(home[start]), []).append((int(place[start]), int(place[start]) + end - start))
    pairs = np.unique(home[position] * len(phrases.lengths) + window)
    docs, windows = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    counts = phrases.owner_starts[windows + 1] - phrases.owner_starts[windows]
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts - phrases.owner_starts[windows], counts)
    items: dict[int, list[int]] = {}
    for pair in np.unique(np.repeat(docs, counts) * len(phrases.names) + phrases.owners[at]).tolist():
        items.setdefault(pair // len(phrases.names), []).append(pair % len(phrases.names))
    return n_words, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _structs(spans: list[list[tuple[int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))
    return pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], kind)


def _character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    ends = {e - 1 for _, e in spans}
    begins = {s for s, _ in spans}
    starts_at, ends_at = [], []
    for number, match in enumerate(_WORD.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))):
        if number in begins:
            starts_at.append(match.start())
        if number in ends:
            ends_at.append(match.end())
    return list(zip(starts_at, ends_at, strict=True))


def _blocks(
    benchmark: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int
) -> Iterator[tuple[bool, list[tuple[str | None, list[bytes]]]]]:
    """Whether it is the last, and the items' words, of each block of about ``block_bytes`` of words.

    One block is on the driver at a time.  An item beyond that is cut before it gets there, into parts that share
    ``width - 1`` words, so that each window of it lies in one part.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("id"), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                start = 0
                while start < len(words):
                    end, held = start, 0
                    while end < len(words) and (end - start < width or held < block_bytes):
                        held += len(words[end]) + 1
                        end += 1
                    part = b" ".join(words[start:end])
                    yield pa.RecordBatch.from_pydict(
                        {"id": pa.array([name.as_py()], pa.string()), "at": pa.array([start], pa.int64()), "words": pa.array([part], pa.binary())}
                    )
                    start = len(words) if end == len(words) else end - width + 1

    items = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[text_col].alias("text"))
    parts = written(items.mapInArrow(cut, "id string, at long, words binary"), "items")
    n = -(-(parts.select(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes) or 1
    for block in range(n):
        rows = parts.where(F.pmod(F.xxhash64("id", "at", "words"), F.lit(n)) == block) if n > 1 else parts
        yield block == n - 1, [(r["id"], bytes(r["words"]).split()) for r in rows.toLocalIterator()]


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    block_bytes: int = BLOCK_BYTES,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: ``id_col, n_words, n_hit, items, spans`` and the columns of ``keep`` (renamed ``keep_*``).

    ``items`` are the sorted ids of benchmark items with a window in the document; ``n_hit`` counts document words
    inside any occurrence; ``spans`` are the merged removal spans as code points (end exclusive).  The operator is
    map-only: no shuffle, and a hot source or passage changes nothing.  A benchmark beyond ``block_bytes`` is searched
    block after block, the results of a row being merged as it passes.

    Edge cases: null, empty and wordless texts have no words and no hits; wordless benchmark items have no windows; an
    empty benchmark gives no hits; an empty table an empty result; repeated rows repeat their result; item ids that
    repeat count once; null item ids are one item, last in the order, null in ``items`` and so absent from joined ids;
    null document ids stay null; very long texts and items are read whole.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    kept = [docs[c].alias(f"keep_{c}") for c in keep]
    kept_schema = "".join(f", `keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    table = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *kept)
    for column, empty in (
        ("n_words", "cast(0 as bigint)"),
        ("items", "cast(array() as array<string>)"),
        ("words", "cast(array() as array<struct<start:int,end:int>>)"),
    ):
        table = table.withColumn(column, F.expr(empty))
    out_schema = f"id {id_type}, text string{kept_schema}, n_words long, items array<string>, words array<struct<start:int,end:int>>"
    placed_schema = f"id {id_type}{kept_schema}, n_words long, items array<string>, n_hit long, spans array<struct<start:int,end:int>>"
    for last, items in _blocks(benchmark, item_col, item_text_col, width, block_bytes):
        block = spark.sparkContext.broadcast(pickle.dumps(Phrases(items, width)))

        def search(batches: Iterator[pa.RecordBatch], block=block, last=last) -> Iterator[pa.RecordBatch]:
            phrases: Phrases = pickle.loads(block.value)
            for batch in slices(batches, "text", SHARD_BYTES):
                texts = batch.column("text").to_pylist()
                n_words, spans, found = _shard_hits(texts, phrases)
                names, words = batch.column("items").to_pylist(), batch.column("words").to_pylist()
                words = [[(w["start"], w["end"]) for w in ws] for ws in words]
                for i in spans:
                    words[i] = _merged(words[i] + spans[i])
                    names[i] = sorted({*names[i], *(phrases.names[k] for k in found[i])}, key=_by_name)
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns["n_words"] = pa.array(n_words)
                columns["items"] = pa.array(names, pa.list_(pa.string()))
                del columns["words"]
                if last:  # word spans become code points, and texts stay behind
                    del columns["text"]
                    columns["n_hit"] = pa.array([sum(e - s for s, e in ws) for ws in words], pa.int64())
                    columns["spans"] = _structs([_character_spans(t, ws) if ws else [] for t, ws in zip(texts, words, strict=True)])
                else:
                    columns["words"] = _structs(words)
                yield pa.RecordBatch.from_pydict(columns)

        table = table.mapInArrow(search, placed_schema if last else out_schema)
    return table.select(
        F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans", *(f"keep_{c}" for c in keep)
    )


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """The text with its (sorted, disjoint) removal spans cut out."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("done"),
            s["end"].alias("at"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(cut["done"], F.substring(text, cut["at"] + 1, F.length(text)))
    )
