"""Language ID (6): a linear-chain conditional random field over the words of a text.

Words are runs of letters, lower case.  A word's features are the character 2-, 3- and 4-grams of the word between
boundary marks (those at a mark are its affixes), hashed, and its membership in a lexicon of frequent training words.
With learned transitions between languages, forward-backward gives every word a distribution over languages, so
code-switched passages keep their own labels; a document gets the language with the largest mean posterior.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillrank.llm.common import least_hashes, slices

_LETTERS = re.compile(r"[^\W\d_]+")
#: Words of a block of the blocked forward-backward pass.
BLOCK = 64
#: Chains up to this length aren't cut into blocks.
WHOLE = 256
#: Words x labels that a forward-backward pass holds at once (about 50 MB), one chain at least.
CELLS = 1 << 20
#: Distinct training words whose n-grams are hashed and summed at once.
WORD_BLOCK = 16_384
UNDETERMINED = "und"


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of each text, distinct-word number of every word, and the distinct words."""
    words: list[str] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            found = _LETTERS.findall(text.lower())
            counts[i] = len(found)
            words += found
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return counts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)


def affix_features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hashed bucket of every n-gram of the marked words."""
    marked = "".join(f"^{w}$" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))
    rows, buckets = [], []
    for n in (2, 3, 4):
        size = max(len(points) - n + 1, 0)
        h = np.full(size, n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:size] == owner[n - 1 : n - 1 + size]
        rows.append(owner[:size][inside])
        buckets.append((h[inside] >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def forward_backward(
    emissions: np.ndarray, transitions: np.ndarray, counts: np.ndarray, expected: np.ndarray | None = None
) -> np.ndarray:
    """Posteriors of every word: exact, in blocks of words so that a long text takes few sequential steps.

    Each block's product of transition-emission matrices is formed for all blocks at once; a scan over the blocks of
    each text gives what enters a block from the left and the right; then all blocks run forward and backward at once.
    ``expected``, if given, is a matrix to which the marginals of all pairs of neighbouring words are added.
    """
    labels = emissions.shape[1]
    # Short chains run as a block each, which needs no products; longer ones are cut.
    longest = int(counts.max(initial=0))
    length = longest if longest <= WHOLE else BLOCK
    n_blocks = -(-counts // max(length, 1))
    total = int(n_blocks.sum())
    if not total:
        return np.zeros((0, labels))
    doc = np.repeat(np.arange(len(counts)), n_blocks)
    within = np.arange(total) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    first = (np.cumsum(counts) - counts)[doc] + within * length
    size = np.minimum(counts[doc] - within * length, length)
    # Labels come before chains, so that sums over the few labels run along the many chains.
    potentials = np.exp(emissions.T - emissions.max(axis=1))
    step = np.exp(transitions - transitions.max())
    present = np.arange(length)[:, None] < size
    at = np.minimum(first + np.arange(length)[:, None], len(emissions) - 1)
    padded = np.empty((length, labels, total))
    for t in range(length):
        padded[t] = potentials[:, at[t]]
        padded[t][:, ~present[t]] = 1.0

    # Entering from the left (before the block's own transition) and from the right.
    left, right = np.ones((labels, total)), np.ones((labels, total))
    if total > len(counts):
        product = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
        for t in range(length):
            live = np.flatnonzero(present[t])
            moved = product[live] @ step
            if t == 0:  # nothing stands before a text's first word
                moved = np.where(within[live, None, None] == 0, product[live], moved)
            moved = moved * padded[t][:, live].T[:, None, :]
            product[live] = moved / moved.sum(axis=(1, 2), keepdims=True)
        ends = np.cumsum(n_blocks)
        for b in range(1, int(n_blocks.max())):
            now = (ends - n_blocks + b)[n_blocks > b]
            left[:, now] = np.einsum("id,dij->jd", left[:, now - 1], product[now - 1])
            left[:, now] /= left[:, now].sum(axis=0)
            back = (ends - 1 - b)[n_blocks > b]
            right[:, back] = np.einsum("dij,jd->id", product[back + 1], right[:, back + 1])
            right[:, back] /= right[:, back].sum(axis=0)
    alpha, carried = np.empty_like(padded), left
    for t in range(length):
        moved = step.T @ carried
        if t == 0:
            moved = np.where(within == 0, carried, moved)
        moved *= padded[t]
        moved /= moved.sum(axis=0)
        carried = np.where(present[t], moved, carried)
        alpha[t] = carried
    carried = right
    for t in reversed(range(length)):
        after = padded[t] * carried
        if expected is not None:
            pair = present[t] & ((within > 0) | (t > 0))
            before, behind = (alpha[t - 1] if t else left)[:, pair], after[:, pair]
            mass = ((step.T @ before) * behind).sum(axis=0)
            expected += step * ((before / mass) @ behind.T)
        alpha[t] *= carried
        alpha[t] /= alpha[t].sum(axis=0)
        moved = step @ after
        moved /= moved.sum(axis=0)
        carried = np.where(present[t], moved, carried)
    out = np.empty((len(emissions), labels))
    for t in range(length):
        out[at[t][present[t]]] = alpha[t][:, present[t]].T
    return out


@dataclass
class LanguageField:
    """A trained field: languages, hashed weights, lexicon and transitions."""

    bits: int
    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    transitions: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of distinct words."""
        owner, bucket = affix_features(words, self.bits)
        out = np.stack([np.bincount(owner, w, len(words)) for w in self.weights.T[:, bucket]], axis=1)
        hashes = word_hashes(words)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[at] == hashes
            out[known] += self.lexicon_weights[at[known]]
        return out

    def label_words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text and the posteriors of all words."""
        counts, index, distinct = words_of(texts)
        if not distinct or not self.languages:
            return counts, np.zeros((0, len(self.languages)))
        scores = self.word_scores(distinct)
        parts = [
            forward_backward(scores[index[first:last]], self.transitions, counts[i:j])
            for i, j, first, last in chains_at_once(counts, len(self.languages))
        ]
        return counts, np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and mean posterior of whole texts."""
        counts, posteriors = self.label_words(texts)
        doc = np.repeat(np.arange(len(texts)), counts)
        means = np.stack([np.bincount(doc, p, len(texts)) for p in posteriors.T], axis=1).astype(float) if self.languages else None
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if means is not None:
            means /= np.maximum(counts, 1)[:, None]
            best = means.argmax(axis=1)
            for i in np.flatnonzero(counts):
                names[i], scores[i] = self.languages[best[i]], means[i, best[i]]
        return names, np.clip(scores, 0, 1)


def chains_at_once(counts: np.ndarray, labels: int, cells: int = CELLS) -> Iterator[tuple[int, int, int, int]]:
    """Runs of chains (first and last chain, first and last word) of at most ``cells`` words x labels, one at least."""
    ends = np.cumsum(counts)
    i = first = 0
    while i < len(counts):
        j = max(int(np.searchsorted(ends, first + max(cells // max(labels, 1), 1), side="right")), i + 1)
        yield i, j, first, int(ends[j - 1])
        i, first = j, int(ends[j - 1])


class _Words:
    """Distinct words of a training sample: their features in blocks, so that no array spans all n-grams of all words."""

    def __init__(self, texts: list[str], bits: int):
        number: dict[str, int] = {}
        coded = []
        for text in texts:
            found = _LETTERS.findall(text.lower())
            coded.append(np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int32, count=len(found)))
        self.counts = np.array([len(c) for c in coded], dtype=np.int64)
        self.index = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int32)
        self.words = list(number)
        self.blocks = []
        for at in range(0, len(self.words), WORD_BLOCK):
            part = self.words[at : at + WORD_BLOCK]
            owner, bucket = affix_features(part, bits)
            self.blocks.append((at, len(part), owner.astype(np.int32), bucket.astype(np.int32)))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.words), weights.shape[1]), dtype=np.float32)
        for at, size, owner, bucket in self.blocks:
            for label, column in enumerate(weights.T):
                out[at : at + size, label] = np.bincount(owner, column[bucket], size)
        return out

    def slope(self, error: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros((buckets, error.shape[1]))
        for at, _, owner, bucket in self.blocks:
            for label in range(error.shape[1]):
                out[:, label] += np.bincount(bucket, error[at + owner, label], buckets)
        return out


def fit(
    texts: list[str], languages: list[str], *, bits: int, rounds: int = 40, rate: float = 0.1, penalty: float = 1e-6,
    segment: int = 256, min_count: int = 3, cells: int = CELLS,
) -> LanguageField:
    """Maximum likelihood by Adam; every word of a training text carries the text's label.

    A round's slope is summed over runs of segments of at most ``cells`` words x labels, so memory is that of the coded
    sample (four bytes a word and an n-gram of a distinct word) and of one run, whatever the sample's size.
    """
    names = sorted(set(languages))
    n_labels = len(names)
    sample = _Words(texts, bits)
    field = LanguageField(
        bits, names, np.zeros((1 << bits, n_labels)), np.zeros(0, np.uint64), np.zeros((0, n_labels)),
        np.zeros((n_labels, n_labels)),
    )
    if not sample.words:
        return field
    distinct, index = sample.words, sample.index
    target = np.repeat(np.array([names.index(x) for x in languages], dtype=np.int16), sample.counts)
    frequent = np.flatnonzero(np.bincount(index, minlength=len(distinct)) >= min_count)
    hashes = word_hashes([distinct[i] for i in frequent])
    order = np.argsort(hashes)
    frequent = frequent[order]
    field.lexicon, field.lexicon_weights = hashes[order], np.zeros((len(frequent), n_labels))
    # Training runs over segments of long texts, so that their words are as many chains of bounded length.
    pieces = np.array([min(segment, c - s) for c in sample.counts.tolist() for s in range(0, c, segment)], dtype=np.int64)
    inside = np.ones(len(index), dtype=bool)
    inside[np.cumsum(pieces) - pieces] = False
    inner = np.flatnonzero(inside)
    gold = np.bincount(target[inner - 1].astype(np.int64) * n_labels + target[inner], minlength=n_labels**2).reshape(n_labels, n_labels)
    told = np.bincount(index.astype(np.int64) * n_labels + target, minlength=len(distinct) * n_labels).reshape(-1, n_labels)
    parameters = [field.weights, field.lexicon_weights, field.transitions]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    n = len(index)
    for step in range(1, rounds + 1):
        emissions = sample.scores(field.weights)
        emissions[frequent] += field.lexicon_weights
        expected = np.zeros((n_labels, n_labels))
        error = -told.astype(np.float64)
        for i, j, first, last in chains_at_once(pieces, n_labels, cells):
            own = index[first:last]
            posterior = forward_backward(emissions[own].astype(np.float64), field.transitions, pieces[i:j], expected)
            for label in range(n_labels):
                error[:, label] += np.bincount(own, posterior[:, label], len(distinct))
        gradients = [sample.slope(error, 1 << bits), error[frequent], expected - gold]
        for p, (first_, second), g in zip(parameters, moments, gradients, strict=True):
            g = g / n + penalty * p
            first_ += 0.1 * (g - first_)
            second += 0.01 * (g * g - second)
            p -= rate * first_ / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return field


def cut_at(sizes: list[int], budget: int) -> int:
    """The largest length that texts can be cut at so that together they fit the budget (the shorter ones whole)."""
    left, n = budget, len(sizes)
    for size in sorted(sizes):
        if size * n > left:
            return left // n
        left, n = left - size, n - 1
    return max(sizes, default=0)


def train(
    docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows: int, max_bytes: int, bits: int
) -> LanguageField:
    """Fit on a sample of every language, chosen by the hash of ids and texts: equal shares of ``rows`` and ``max_bytes``.

    A language has at least one document in the sample.  Where its documents exceed its bytes, the longest ones are
    cut at the largest common length that fits, so no document shuts out another.  Rows are sampled, not ids: rows of one
    id with many texts count each, within the same bounds.
    """
    labelled = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    labelled = labelled.where("text is not null and lang is not null and id is not null")
    # A row is known by its id, language and text; rows that repeat all three count once.
    labelled = labelled.withColumn("size", F.octet_length("text")).withColumn("key", F.xxhash64("id", "text"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    # One language alone has nothing to be told from; from two on, a share of 2,000 is within Spark's limit per window.
    share = max(rows // max(len(counts), 2), 1)
    # Only keys that may be among a language's first are dealt, however many tasks read the table; a row per language.
    bounds = docs.sparkSession.createDataFrame(
        [(lang, least_hashes(share, n)) for lang, n in counts.items()], "lang string, bound long"
    )
    labelled = labelled.join(F.broadcast(bounds), "lang").where("key <= bound").drop("bound")
    order = Window.partitionBy("lang").orderBy("key", "id", "size")
    sizes: dict[str, set] = {}
    for r in (
        labelled.select("id", "lang", "key", "size").withColumn("at", F.row_number().over(order)).where(F.col("at") <= share).collect()
    ):
        sizes.setdefault(r["lang"], set()).add((r["id"], r["key"], r["size"]))
    chosen = []
    for lang, held in sizes.items():
        cut = max(cut_at([size for _, _, size in held], max_bytes // len(sizes)), 1)
        chosen += sorted((i, lang, key, size, min(size, cut)) for i, key, size in held)
    spark = docs.sparkSession
    # At most ``rows`` rows (one a language at least): bounded whatever the table's size.
    keys = spark.createDataFrame(
        chosen, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, key long, size int, cut int"
    )
    found = labelled.join(F.broadcast(keys), ["id", "lang", "key", "size"]).select(
        "id", "lang", "key", F.expr("substring(cast(text as binary), 1, cut)").alias("head")
    ).dropDuplicates(["id", "lang", "key"])
    sample = sorted((r["id"], r["lang"], bytes(r["head"]).decode("utf-8", "ignore")) for r in found.collect())
    return fit([r[2] for r in sample], [r[1] for r in sample], bits=bits)


def language(
    docs: DataFrame, train_docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: int = 2000, max_bytes: int = 8 << 20, bits: int = 16,
) -> DataFrame:
    """``id_col, lang_pred, score`` per row of ``docs``; only ``train_docs`` are learned from.

    The prediction pass is map-only over whole texts; the model's size is fixed by ``bits`` and the sample's bounds.

    Edge cases: null texts and texts without a letter are ``und`` with score 0; a tie goes to the first language in
    alphabetical order; without training rows every text is ``und``; repeated rows repeat their result; null ids stay
    null; an empty table gives an empty result; other columns are ignored.
    """
    field = train(train_docs, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows, max_bytes=max_bytes, bits=bits)
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: LanguageField = pickle.loads(model.value)
        for batch in slices(batches, "text"):
            names, scores = field.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
            )

    table = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return table.mapInArrow(predict, schema).select(F.col("id").alias(id_col), "lang_pred", "score")
