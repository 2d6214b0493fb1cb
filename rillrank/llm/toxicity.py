"""Toxicity (2): a factorization machine over hashed terms.

Terms are the distinct words of a text (runs of letters and digits, lower case) and their prefixes of four and five
characters, hashed into ``2 ** bits`` buckets.  Screening keeps the buckets that tell the labels apart most; over
these a second-order factorization machine learns a weight per term and a factor vector per term, so that a pair of
terms (an insult and the mention of a group) can count for more, or less, than the two alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.llm.common import least_hashes, slices, written

#: Bytes that aren't part of a word become spaces.
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _hash(term: str, bits: int) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def terms_of(word: str, bits: int) -> list[int]:
    """Hashed terms of a word: itself and its marked prefixes."""
    return [_hash(word, bits), *(_hash(f"{word[:n]}*", bits) for n in (4, 5) if len(word) > n)]


def _coded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Document number and distinct-word number of every word, and the distinct words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()
            counts[i] = len(found)
            words += found
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    distinct = [w.decode("utf-8", "replace") for w in coded.dictionary.to_pylist()]
    return np.repeat(np.arange(len(texts)), counts), coded.indices.to_numpy(zero_copy_only=False), distinct


@dataclass
class FactorizationMachine:
    """Bias, linear weights and factors over the kept buckets."""

    bits: int
    kept: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, documents: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Log-odds of documents whose present terms are the pairs (rows, columns), each pair once."""
        linear = np.bincount(rows, self.weights[columns], documents)
        pairs = np.zeros(documents)
        for k in range(self.factors.shape[1]):
            v = self.factors[columns, k]
            pairs += np.bincount(rows, v, documents) ** 2 - np.bincount(rows, v * v, documents)
        return self.bias + linear + pairs / 2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of the label for whole texts."""
        row, word, distinct = _coded_words(texts)
        of_word = [[self.kept[t] for t in terms_of(w, self.bits) if t in self.kept] for w in distinct]
        size = np.fromiter(map(len, of_word), dtype=np.int64, count=len(of_word))
        flat = np.fromiter((t for terms in of_word for t in terms), dtype=np.int64, count=int(size.sum()))
        told = size[word] > 0 if len(word) else np.zeros(0, dtype=bool)
        row, word = row[told], word[told]
        counts = size[word]
        at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        columns = flat[np.repeat((np.cumsum(size) - size)[word], counts) + at]
        pairs = np.unique(np.repeat(row, counts) * max(len(self.weights), 1) + columns)
        margins = self.margins(len(texts), pairs // max(len(self.weights), 1), pairs % max(len(self.weights), 1))
        return 1 / (1 + np.exp(-np.clip(margins, -40, 40)))


def told_apart(with_1: np.ndarray, with_0: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """How far a term's presence tells the labels apart, in standard errors; 0 for terms of fewer than three rows."""
    p1, p0 = (with_1 + 0.5) / (positives + 1), (with_0 + 0.5) / (negatives + 1)
    told = np.abs(np.log(p1 / p0)) / np.sqrt(1 / (with_1 + 0.5) + 1 / (with_0 + 0.5))
    return np.where(with_1 + with_0 < 3, 0, told)


def bias_only(bits: int, rank: int, share: float) -> FactorizationMachine:
    """A machine without terms: every text scores the share of the label."""
    share = min(max(share, 1e-6), 1 - 1e-6)
    return FactorizationMachine(bits, {}, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, rank)))


def fit(
    documents: list[np.ndarray], labels: np.ndarray, positive_share: float, chosen: np.ndarray, *, bits: int, rank: int,
    rounds: int = 200, rate: float = 0.05, penalty: float = 2e-3, seed: int = 0,
) -> FactorizationMachine:
    """Fit on the term numbers (places in ``chosen``, sorted buckets) of a sample; the bias is set back to the share in
    all training rows."""
    share = min(max(positive_share, 1e-6), 1 - 1e-6)
    row = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    column = np.concatenate(documents).astype(np.int64)
    random = np.random.default_rng(seed)
    weights, factors, bias = np.zeros(len(chosen)), random.normal(0, 0.01, (len(chosen), rank)), 0.0
    sample_odds = np.log(labels.sum() / (1 - labels).sum())
    n = len(labels)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), weights, factors)]
    for step in range(1, rounds + 1):
        machine = FactorizationMachine(bits, {}, bias, weights, factors)
        error = 1 / (1 + np.exp(-np.clip(machine.margins(n, row, column), -40, 40))) - labels
        sums = np.stack([np.bincount(row, factors[column, k], n) for k in range(rank)], axis=1)
        pull = error[row]
        gradients = [
            np.array([error.sum()]),
            np.bincount(column, pull, len(chosen)) + penalty * n * weights,
            np.stack(
                [np.bincount(column, pull * (sums[row, k] - factors[column, k]), len(chosen)) for k in range(rank)],
                axis=1,
            )
            + penalty * n * factors,
        ]
        moves = []
        for (first, second), gradient in zip(moments, gradients, strict=True):
            gradient = gradient / n
            first += 0.1 * (gradient - first)
            second += 0.001 * (gradient**2 - second)
            moves.append(rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
        bias, weights, factors = bias - float(moves[0][0]), weights - moves[1], factors - moves[2]
    bias += float(np.log(share / (1 - share)) - sample_odds)
    return FactorizationMachine(bits, {int(b): i for i, b in enumerate(chosen)}, bias, weights, factors)


def sampled_rows(
    docs: DataFrame, rated: DataFrame, sizes: tuple[int, int], *, id_col: str, text_col: str, per_class: int, bits: int
) -> DataFrame:
    """``id, label, terms``: term sets of at most ``per_class`` rows a class, the first by hash; equal rows count once.

    ``sizes`` are the numbers of rated ids of both classes.  First ids are chosen, then rows of these ids, so that an id that many rows carry doesn't add to the sample.
    """

    def first(rows: DataFrame, *order: str | F.Column) -> DataFrame:
        parts = [rows.where(kind).orderBy(*order).limit(per_class) for kind in ("label > 0", "label <= 0")]
        return parts[0].union(parts[1])

    # At most 2 * per_class ids: bounded whatever the tables' size.
    hashed = rated.withColumn("hash", F.xxhash64("id"))
    # Only ids that may be among the first of their class are sorted, however many tasks read the table.
    bound = F.when(F.col("label") > 0, least_hashes(per_class, sizes[1])).otherwise(least_hashes(per_class, sizes[0]))
    chosen = first(hashed.where(F.col("hash") <= bound), "hash", "id").drop("hash")
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text in batch.column("text").to_pylist():
                distinct = _coded_words([text])[2]
                hashed = np.unique(np.array([t for w in distinct for t in terms_of(w, bits)], dtype=np.int32))
                found.append(hashed.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], ["id", "label", "terms"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    found = written(sample.mapInArrow(terms, f"id {kind}, label int, terms binary"), "terms")
    keyed = found.withColumn("key", F.xxhash64("id", "terms"))
    # Keys of at most 2 * per_class rows.
    keys = first(keyed.select("id", "label", "key").distinct(), "key", "id")
    return keyed.join(F.broadcast(keys), ["id", "label", "key"]).drop("key").distinct()


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, per_class: int, bits: int,
    keep: int, rank: int,
) -> FactorizationMachine:
    """Fit on at most ``per_class`` labelled rows of each class, chosen by hash.

    The driver gets the ``keep`` best buckets and, of each sampled row, the numbers of those it holds: at most
    ``4 * per_class * keep`` bytes, however long the texts are.
    """
    rated = labels.where(labels[id_col].isNotNull() & labels[label_col].isNotNull())
    rated = rated.groupBy(rated[id_col].alias("id")).agg(F.max(rated[label_col].cast("int")).alias("label"))
    total, positive = rated.agg(F.count(F.lit(1)), F.count(F.when(F.col("label") > 0, 1))).first()
    share = positive / max(total, 1)
    rows = written(sampled_rows(docs, rated, (total - positive, positive), id_col=id_col, text_col=text_col, per_class=per_class, bits=bits), "sample")
    n, positives = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("label") > 0, 1))).first()
    if not positives or positives == n:
        return bias_only(bits, rank, share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << bits), dtype=np.int32)
        for batch in batches:
            for label, terms in zip(batch.column("label").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                totals[int(label > 0), np.frombuffer(terms, dtype=np.int32)] += 1
        seen = np.flatnonzero(totals.any(axis=0))
        columns = [pa.array(seen.astype(np.int32)), pa.array(totals[1, seen]), pa.array(totals[0, seen])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "with_1", "with_0"])

    counts = rows.select("label", "terms").mapInArrow(count, "bucket int, with_1 int, with_0 int").groupBy("bucket").agg(
        F.sum("with_1").alias("with_1"), F.sum("with_0").alias("with_0")
    )

    @F.pandas_udf("double")
    def told(with_1: pd.Series, with_0: pd.Series) -> pd.Series:
        return pd.Series(told_apart(with_1.to_numpy(float), with_0.to_numpy(float), positives, n - positives))

    best = counts.withColumn("told", told("with_1", "with_0")).where("told > 2").orderBy(F.desc("told"), "bucket").limit(keep)
    chosen = np.sort(np.array([r["bucket"] for r in best.select("bucket").collect()], dtype=np.int32))
    if not len(chosen):
        return bias_only(bits, rank, share)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.searchsorted(chosen, np.intersect1d(np.frombuffer(t, dtype=np.int32), chosen, assume_unique=True)) for t in batch.column("terms").to_pylist()]
            columns = [batch.column("id").cast(pa.string()), batch.column("label"), pa.array([h.astype(np.uint16).tobytes() for h in held], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "terms"])

    sample = sorted(rows.mapInArrow(narrow, "id string, label int, terms binary").collect())
    return fit(
        [np.frombuffer(r["terms"], dtype=np.uint16) for r in sample], np.array([float(r["label"] > 0) for r in sample]), share,
        chosen, bits=bits, rank=rank,
    )


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = 4000, bits: int = 20, keep: int = 4096, rank: int = 8,
) -> DataFrame:
    """``id_col, score`` per row: the probability that the whole text is toxic.

    ``labels`` (ids and 0/1 labels) are what may be learned from; only these rows' texts train the model: at most
    ``per_class`` rows a class, the first by hash.  The scoring pass is map-only; the model (at most ``keep`` terms, below
    65,536) is broadcast.

    Edge cases: null, empty and wordless texts get the score of the bias alone; a document labelled twice counts as
    toxic if any label says so; null labels are left out; rows that repeat an id with other texts are rows of their own
    within ``per_class``, and a score of exactly 0.5 counts as predicted; without labels of both classes every score is the share of
    toxic ones; an empty table gives an empty result; other columns are ignored.
    """
    machine = train(
        docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, per_class=per_class, bits=bits,
        keep=keep, rank=rank,
    )
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(model.value)
        for batch in slices(batches, "text"):
            scores = pa.array(machine.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), scores], ["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, score double"
    return rows.mapInArrow(score, schema).select(F.col("id").alias(id_col), "score")
