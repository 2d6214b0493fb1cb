"""Corpus pipeline: quality filter, exact dedup, near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the last return the
columns of ``documents``.  Decisions are joined back by anti-joins on a key of each row's own, so only keys move to
decide, and rows with a null or repeated id are dropped for their own content only.

What runs in Python is written inside the stage, in small Arrow batches: whole texts in batches of Spark's 10,000 rows fill
an executor's memory outside its heap, on both sides.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillrank.llm.common import small_batches, written
from rillrank.llm.decontam_fm import benchmark_hits, without_spans
from rillrank.llm.exact_dedup import exact_groups
from rillrank.llm.minhash import near_duplicates
from rillrank.llm.quality_dsir import quality
from rillrank.llm.sentencepiece_viterbi import encode_decode


#: Keys of rows that can't go by their id start here, above the ids in use.
_EXTRA = 1 << 62


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a ``row_key`` that only rows of one id and text share, and whether any id is null or repeated.

    The key is the id; rows with a null id, and all texts but one of a repeated id, get a 61-bit hash of id and text.
    """
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if counts.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("row_key", F.col("doc_id")), False
    firsts = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("first_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("text")).alias("first")
    ).where("n > 1").drop("n")
    extra = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_EXTRA // 2 - 1)) + F.lit(_EXTRA)
    own = F.col("doc_id").isNotNull() & (F.col("first").isNull() | (F.col("first") == F.xxhash64("text")))
    joined = docs.join(firsts, docs["doc_id"] == firsts["first_id"], "left")
    return joined.select(*(docs[c] for c in docs.columns), F.when(own, docs["doc_id"]).otherwise(extra).alias("row_key")), True


def _without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key isn't in ``dropped``, without the key."""
    return keyed.join(dropped.select("row_key").distinct(), "row_key", "left_anti").drop("row_key")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    keyed, _ = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "row_key")
    with small_batches(spark):
        judged = quality(keyed, labels, id_col="row_key")
    return _without(keyed, judged.where(~F.col("kept")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content stays; of rows that repeat an id and a text one stays."""
    keyed, repeats = _keyed(docs)
    kept = _without(keyed, exact_groups(keyed, id_col="row_key").where(~F.col("kept")))
    return kept.dropDuplicates(["doc_id", "text"]) if repeats else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more) stays."""
    keyed, _ = _keyed(docs)
    with small_batches(spark):
        near = near_duplicates(keyed, percent=80, id_col="row_key")
        dropped = written(near.where(~F.col("kept")).select("row_key"), "dropped")
    return _without(keyed, dropped)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; other hits are cut out of the text they stand in.

    A text that consists of hits only goes as well.  ``n_chars`` follows the text.
    """
    columns = docs.columns
    with small_batches(spark):
        hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(columns))
    clean = hits.where((F.size("items") < 2) & ((F.col("n_hit") == 0) | (F.col("n_hit") < F.col("n_words"))))
    text = without_spans(F.col("keep_text"), F.col("spans"))
    out = clean.select(*(text.alias(c) if c == "text" else F.col(f"keep_{c}").alias(c) for c in columns), "n_hit")
    if "n_chars" in columns:
        length = F.when(F.col("n_hit") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", length.otherwise(F.col("n_chars")))
    with small_batches(spark):
        return written(out.select(*columns), "clean")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text that is left, checked by decoding them."""
    with small_batches(spark):
        return written(encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")), "encoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL can't express the resampling, MinHash and encoding stages; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
