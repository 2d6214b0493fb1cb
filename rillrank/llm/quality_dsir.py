"""Quality classifier (7): importance resampling with hashed n-gram generative models and Gumbel top-k.

Two bag-of-n-gram models over hashed unigrams and bigrams are estimated: one of target text (labelled good documents)
and one of raw text (all documents).  A document's log weight is the log of the ratio of its likelihoods under the two,
tempered to at most ``evidence`` n-grams, and the ``k`` documents with the largest weights after a standard Gumbel draw
each are the resample without replacement.  ``k`` is a target share of the documents or, by default, the number of
documents whose weight reaches the threshold that separates held-out labelled documents best.
"""

from __future__ import annotations

import pickle
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import least_hashes, slices, written

#: Runs of letters, of digits, and of other marks: "word!!" gives two tokens.
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: Stands for every bigram of a token and itself.
_AGAIN = np.uint64(0xD6E8FEB86659FD93)
#: Cost of a held-out good document lost, in bad ones kept: a filter must keep clean documents.
_LOST = 20.0


def _ngrams(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hashed bucket of every unigram and bigram of whole texts."""
    tokens: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = _TOKEN.findall(text.encode("utf-8", "surrogatepass"))
            counts[i] = len(found)
            tokens += found
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    hashes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(tokens) else np.zeros(0, dtype=np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    same = row[1:] == row[:-1]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    # A token that follows itself is one bigram, whichever token it is.
    pairs = np.where(hashes[1:] == hashes[:-1], _AGAIN, pairs)[same]
    shift = np.uint64(64 - bits)
    return np.concatenate([row, row[1:][same]]), np.concatenate([hashes, pairs]) >> shift


def _sample(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of good documents to learn from, and of held-out good and bad ones, at most ``per_class`` each, by id hash.

    A quarter of the good documents is held out; bad ones are never learned from.
    """
    rated = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
    rated = rated.groupBy(rated[id_col].cast("long").alias("id")).agg(F.min(rated[label_col].cast("int")).alias("label"))
    rated = rated.withColumn("hash", F.xxhash64("id"))

    def ids(kind: F.Column) -> np.ndarray:
        own = rated.where(kind)
        # Only ids that may be among the first reach the driver, however many tasks read the table.
        bound = least_hashes(per_class, own.count())
        rows = own.where(F.col("hash") <= bound).orderBy("hash", "id").limit(per_class).collect()
        return np.sort(np.array([r["id"] for r in rows], dtype=np.int64))

    held_out = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0
    good, bad = F.col("label") > 0, F.col("label") <= 0
    return ids(good & ~held_out), ids(good & held_out), ids(bad)


def log_ratios(docs: DataFrame, good_ids: np.ndarray, *, id_col: str, text_col: str, bits: int) -> np.ndarray:
    """log p_target - log p_raw of every bucket; the raw model counts every n-gram of every document."""
    good = docs.sparkSession.sparkContext.broadcast(good_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in slices(batches, "text"):
            ids = batch.column("id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            row, bucket = _ngrams(batch.column("text").to_pylist(), bits)
            totals[0] += np.bincount(bucket.astype(np.int64), minlength=1 << bits)
            target = np.isin(ids, good.value)
            if target.any() and len(row):
                totals[1] += np.bincount(bucket[target[row]].astype(np.int64), minlength=1 << bits)
        seen = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(totals[0, seen]), pa.array(totals[1, seen])], ["bucket", "raw", "target"]
        )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    counted = rows.mapInArrow(count, "bucket long, raw long, target long")
    totals = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << bits), np.ones(1 << bits)
    for r in totals.collect():  # at most 2 ** bits rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def importance_weights(
    docs: DataFrame, ratios: np.ndarray, *, id_col: str, text_col: str, bits: int, evidence: float
) -> DataFrame:
    """``id, n_grams, weight``: the log ratio summed over a whole text's n-grams, times evidence / (evidence + n_grams).

    A text of few n-grams weighs its plain log likelihood ratio; a long one, whose n-grams repeat each other's evidence,
    at most what ``evidence`` of its n-grams weigh on the average.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(ratios))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = pickle.loads(model.value)
        for batch in slices(batches, "text"):
            row, bucket = _ngrams(batch.column("text").to_pylist(), bits)
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.bincount(row, ratios[bucket.astype(np.int64)], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(total * evidence / (evidence + n))],
                ["id", "n_grams", "weight"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(weigh, "id long, n_grams long, weight double")


def separating(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight of least cost between two labelled classes; among cuts of equal cost the middle one."""
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([values[:1] - 1, (values[1:] + values[:-1]) / 2, values[-1:] + 1])
    lost = np.searchsorted(np.sort(good), cuts) / len(good)
    kept = 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    cost = _LOST * lost + kept
    return float(cuts[cost <= cost.min() + 1e-12].mean())


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 1024, rows: int = 2048) -> float:
    """The k-th largest value of a column, by narrowing histograms: each round sends ``bins`` counts to the driver."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return np.inf
    if k >= n:
        return -np.inf
    above = 0
    while True:
        inside = keys.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if low >= high:
            return low
        counts = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        for r in sorted(
            counts.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(),
            reverse=True,
        ):
            if above + r["n"] >= k:
                low, high, held = r["low"], r["high"], r["n"]
                break
            above += r["n"]
        if held <= rows:
            rest = keys.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()
            return sorted((r[0] for r in rest), reverse=True)[k - above - 1]


def quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_class: int = 10_000, bits: int = 14, evidence: float = 256.0, temperature: float = 1.0, share: float | None = None,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: ``id_col, n_grams, log_weight, key, kept``.

    ``key`` is ``log_weight / temperature`` plus a standard Gumbel draw that depends on the id and ``seed`` only; the
    ``k`` largest keys are kept.  ``k`` is ``share`` of the rows or, where that is None, the number of rows whose weight
    reaches the threshold between held-out good and bad labelled documents.  The labelled sample is bounded by
    ``per_class`` ids a class; counts and weights cover every whole text.

    Edge cases: null, empty and blank texts weigh 0 (no evidence either way); rows that repeat an id draw the same
    Gumbel value; where keys tie at the k-th place all tied rows stay; a null id draws like any other value; without
    held-out labels of both classes and without ``share`` nothing is rejected, and a warning says so; an empty table
    gives an empty result; other columns are ignored.
    """
    fit_ids, good_ids, bad_ids = _sample(labels, id_col, label_col, per_class)
    ratios = log_ratios(docs, fit_ids, id_col=id_col, text_col=text_col, bits=bits)
    weights = written(
        importance_weights(docs, ratios, id_col=id_col, text_col=text_col, bits=bits, evidence=evidence), "weights"
    )
    # Uniform in (0, 1) from 52 bits of a hash of the id.
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 12).cast("double") + 0.5) / float(2**52)
    key = F.col("weight") / temperature - F.log(-F.log(uniform))
    k = _target_size(weights, good_ids, bad_ids) if share is None else round(share * weights.count())
    kept = F.lit(True) if k is None else F.col("key") >= kth_largest(weights.select(key.alias("key")), "key", k)
    return weights.withColumn("key", key).select(
        F.col("id").alias(id_col), "n_grams", F.col("weight").alias("log_weight"), "key", kept.alias("kept")
    )


def _target_size(weights: DataFrame, good_ids: np.ndarray, bad_ids: np.ndarray) -> int | None:
    """How many rows reach the threshold of the held-out labels; None, with a warning, without both classes."""
    if not len(good_ids) or not len(bad_ids):
        warnings.warn("no held-out labels of both classes: the quality classifier keeps every document", stacklevel=3)
        return None
    # At most 2 * per_class ids: bounded whatever the tables' size.
    rated = weights.sparkSession.createDataFrame(
        [(int(i), 1) for i in good_ids] + [(int(i), 0) for i in bad_ids], "id long, label int"
    )
    pairs = weights.join(F.broadcast(rated), "id").groupBy("id", "label").agg(F.min("weight").alias("weight"))
    both = {0: [], 1: []}
    for r in pairs.collect():
        both[r["label"]].append(r["weight"])
    good, bad = np.array(both[1]), np.array(both[0])
    if not len(good) or not len(bad):
        warnings.warn("no labelled documents of both classes: the quality classifier keeps every document", stacklevel=3)
        return None
    if good.mean() <= bad.mean():
        warnings.warn("held-out good documents weigh no more than bad ones: the quality classifier can't tell them apart", stacklevel=3)
    return weights.where(F.col("weight") >= separating(good, bad)).count()
