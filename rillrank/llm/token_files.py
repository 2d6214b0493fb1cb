"""Token-ID / binary output (5): token ids in patched frame-of-reference blocks, written as files and read back.

File format (little endian).  A file holds segments, one row each: ``part, segment`` (their order is document order),
``n_docs, n_tokens`` and a binary ``payload``.  Whole documents make up a segment.  Payload::

    magic "PFR1" | u32 n_docs | u64 n_tokens | u32 n_blocks | u32 n_exceptions
    u8  present[n_docs]        0 where the id is null     | i64 ids[n_docs] | u64 lengths[n_docs]
    u32 minima[n_blocks]       the block's minimum        | u8  widths[n_blocks]
    u64 starts[n_blocks + 1]   the index of block starts, in 64-bit words of the packed area
    u64 patches[n_blocks + 1]  the index of exception lists
    u8  places[n_exceptions]   position in the block      | u32 excess[n_exceptions]
    u64 packed[]               per block 128 values less the minimum, ``width`` bits each

A block holds 128 ids (the last one is padded).  Its width is what the 90th percentile of its values needs; values
that need more are exceptions, stored whole in the block's exception list.  Spark's own writer commits the files, so
a lost executor's half-written file is never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillrank.llm.common import new_folder, slices, small_batches
from rillrank.llm.tokenizing import WordBpeEncoder, instance

BLOCK = 128
#: Ids of a segment, at least; the segment ends with the document that reaches it.
SEGMENT_IDS = 1 << 18
PERCENTILE = 0.9
_HEADER = struct.Struct("<4sIQII")


def pack(values: np.ndarray, percentile: float = PERCENTILE) -> list[np.ndarray]:
    """Minima, widths, starts, patches, places, excess and packed words of ids below 2^32."""
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint32)
    padded[: len(values)] = values
    if len(values):
        padded[len(values) :] = values[-1]
    padded = padded.reshape(blocks, BLOCK)
    minima = padded.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    above = padded - minima[:, None]
    at = min(int(np.ceil(percentile * BLOCK)), BLOCK) - 1
    chosen = np.partition(above, at, axis=1)[:, at] if blocks else minima
    widths = np.frexp(chosen.astype(np.float64))[1].astype(np.uint8)
    fits = above >> np.minimum(widths, 31)[:, None].astype(np.uint32) == 0
    fits |= (widths == 32)[:, None]
    rows, places = np.nonzero(~fits)
    excess = above[rows, places]
    above[rows, places] = 0
    patches = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=blocks))]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.uint64) * (BLOCK // 64))]).astype(np.uint64)
    packed = np.zeros(int(starts[-1]), dtype=np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        chosen_rows = np.flatnonzero(widths == width)
        part = np.ascontiguousarray(above[chosen_rows].T).astype(np.uint64)
        words = np.zeros((width * BLOCK // 64, len(chosen_rows)), dtype=np.uint64)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            words[word] |= part[i] << np.uint64(shift)
            if shift + width > 64:
                words[word + 1] |= part[i] >> np.uint64(64 - shift)
        packed[starts[chosen_rows].astype(np.int64)[:, None] + np.arange(len(words))] = words.T
    return [minima, widths, starts, patches, places.astype(np.uint8), excess.astype(np.uint32), packed]


def unpack(
    minima: np.ndarray, widths: np.ndarray, starts: np.ndarray, patches: np.ndarray, places: np.ndarray,
    excess: np.ndarray, packed: np.ndarray, first: int = 0, last: int | None = None,
) -> np.ndarray:
    """The ids of blocks ``first`` to ``last`` (exclusive): the index lets any block be read without the others."""
    last = len(minima) if last is None else last
    out = np.zeros((last - first, BLOCK), dtype=np.uint32)
    for width in np.unique(widths[first:last]).tolist():
        if not width:
            continue
        rows = np.flatnonzero(widths[first:last] == width)
        at = starts[first + rows].astype(np.int64)
        words = np.ascontiguousarray(packed[at[:, None] + np.arange(width * BLOCK // 64)].T)
        values = np.empty((BLOCK, len(rows)), dtype=np.uint32)
        mask = np.uint64((1 << width) - 1)
        for i in range(BLOCK):
            word, shift = divmod(i * width, 64)
            value = words[word] >> np.uint64(shift)
            if shift + width > 64:
                value = value | (words[word + 1] << np.uint64(64 - shift))
            values[i] = value & mask
        out[rows] = values.T
    of = np.repeat(np.arange(last - first), np.diff(patches[first : last + 1].astype(np.int64)))
    listed = slice(int(patches[first]), int(patches[last]))
    out[of, places[listed]] = excess[listed]
    return (out + minima[first:last, None]).reshape(-1)


def encode_segment(ids: list[int | None], lengths: np.ndarray, values: np.ndarray) -> bytes:
    """The payload of whole documents."""
    arrays = pack(values)
    present = np.array([i is not None for i in ids], dtype=np.uint8)
    numbers = np.array([i or 0 for i in ids], dtype=np.int64)
    header = _HEADER.pack(b"PFR1", len(ids), len(values), len(arrays[0]), len(arrays[5]))
    return b"".join([header, *(a.tobytes() for a in (present, numbers, lengths.astype(np.uint64), *arrays))])


def decode_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids of a payload."""
    magic, n_docs, n_tokens, n_blocks, n_exceptions = _HEADER.unpack_from(payload)
    if magic != b"PFR1":
        raise ValueError("not a token segment")
    at = _HEADER.size

    def take(kind: type, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    present, numbers, lengths = take(np.uint8, n_docs), take(np.int64, n_docs), take(np.uint64, n_docs)
    minima, widths = take(np.uint32, n_blocks), take(np.uint8, n_blocks)
    starts, patches = take(np.uint64, n_blocks + 1), take(np.uint64, n_blocks + 1)
    places, excess = take(np.uint8, n_exceptions), take(np.uint32, n_exceptions)
    packed = take(np.uint64, int(starts[-1]))
    values = unpack(minima, widths, starts, patches, places, excess, packed)[:n_tokens]
    ids = [int(i) if p else None for i, p in zip(numbers, present, strict=True)]
    return ids, lengths.astype(np.int64), values


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1
) -> None:
    """Tokenise whole texts and write their ids, each document followed by ``end_id``, in ascending id order.

    Null and empty texts are just the end id.  Null ids come first; rows with the same id follow in order of their
    texts.  Range partitioning on the id deals the documents out; nothing but a segment is held at a time.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        serialised = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = instance(WordBpeEncoder, serialised.value)
        part, segment = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        values: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(values)
            row = [part, segment, len(ids), len(tokens), encode_segment(ids, np.concatenate(lengths), tokens)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in slices(batches, "text", keep=True):
            found, counts = encoder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            values.append(np.insert(found, ends, end_id))
            lengths.append(counts + 1)
            ids += batch.column("id").to_pylist()
            held += len(values[-1])
            if held >= SEGMENT_IDS:
                yield flush()
                segment += 1
                ids, lengths, values, held = [], [], [], 0
        if ids:
            yield flush()

    names = ["part", "segment", "n_docs", "n_tokens", "payload"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    files = ordered.mapInArrow(encode, "part int, segment int, n_docs long, n_tokens long, payload binary")
    with small_batches(docs.sparkSession):
        files.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, *, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` (and ``token_ids``) of every document, decoded from the files."""
    stored = spark.read.parquet(path)
    sizes = stored.select("part", "segment", "n_tokens")
    in_part = Window.partitionBy("part").orderBy("segment")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row per file: the number of files, not of documents, bounds what this window sees.
    parts = parts.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    bases = sizes.select(
        F.col("part").alias("p"), F.col("segment").alias("s"),
        (F.sum("n_tokens").over(in_part) - F.col("n_tokens")).alias("inside"),
    ).join(parts, "p").select("p", "s", (F.col("inside") + F.col("before")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, segment, payload in zip(*(batch.column(c) for c in ("part", "segment", "payload")), strict=True):
                ids, lengths, values = decode_segment(payload.as_py())
                ends = np.cumsum(lengths)
                spans = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                words = values.astype("<u4")
                columns = [
                    pa.array(np.full(len(ids), part.as_py(), dtype=np.int32)),
                    pa.array(np.full(len(ids), segment.as_py(), dtype=np.int32)),
                    pa.array(ids, pa.int64()),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(words[s:e]) for s, e in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([words[s:e] for s, e in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["part", "segment", "id", "offset", "n_tokens", "ids_crc32"] + ["token_ids"] * with_ids
    schema = "part int, segment int, id long, offset long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    decoded = stored.select("part", "segment", "payload").mapInArrow(decode, schema)
    joined = decoded.join(bases, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))
    out = [F.col("id").alias(id_col), (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return joined.select(*out, *["token_ids"] * with_ids)


def token_files(docs: DataFrame, tokenizer_path: str, **options: object) -> DataFrame:
    """Write the files into a fresh folder of the shared folder and return what they hold.

    An empty table writes no segment and gives an empty result.
    """
    path = new_folder(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(docs.sparkSession, path, id_col=options.get("id_col", "doc_id"))
