"""The registered queries of the text operators and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from rillrank.llm.decontam_fm import benchmark_hits
from rillrank.llm.exact_dedup import exact_groups
from rillrank.llm.langid_crf import language
from rillrank.llm.minhash import near_duplicates
from rillrank.llm.pii import BASE_KINDS, KINDS, personal_data, span_text
from rillrank.llm.quality_dsir import quality
from rillrank.llm.sentencepiece_viterbi import encode_decode
from rillrank.llm.token_count import token_counts
from rillrank.llm.token_files import token_files
from rillrank.llm.toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir))


def _remainder(n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_remainder(5) == 0, F.lit(True))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity(_documents(spark, sf_dir), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_remainder(3) == 1, F.lit(True))
    docs = _documents(spark, sf_dir)
    found = language(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def counted(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(counted, BASE_KINDS), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
        *map(counted, KINDS[len(BASE_KINDS) :]),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_minhash": op4_minhash,
        "op5_token_files": op5_token_files,
        "op6_language": op6_language,
        "op7_quality": op7_quality,
        "op8_token_counts": op8_token_counts,
        "op9_pii": op9_pii,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_minhash": OP4_SQL, "op10_decontamination": OP10_SQL}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

# All pairs that share a shingle, confirmed on whole sets; components by reachability.
OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2), lambda i: md5(array_to_string(w[i : i + 4], ' '))))) AS shingles
  FROM d WHERE len(w) > 0
), classes AS (
  SELECT min(doc_id) AS head, shingles, len(shingles) AS n FROM shingled GROUP BY shingles
), posted AS (
  SELECT head, n, unnest(shingles) AS shingle FROM classes
), links AS (
  SELECT a.head AS x, b.head AS y FROM posted a JOIN posted b USING (shingle) WHERE a.head <> b.head
  GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT head AS x, head AS y FROM classes
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), component AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN shingled USING (doc_id) LEFT JOIN classes USING (shingles) LEFT JOIN component ON head = x
"""

# Every window of every document against the benchmark's, by equality.
OP10_SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, win FROM (
    SELECT item_id, least(len(w), 8) AS k,
           unnest(list_transform(range(1, greatest(len(w) - 8, 0) + 2), lambda i: array_to_string(w[i : i + 7], ' '))) AS win
    FROM b WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), dw AS (
  SELECT r, k, generate_subscripts(wins, 1) AS s, unnest(wins) AS win FROM (
    SELECT r, k, list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' ')) AS wins
    FROM d CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT r, s, k, item_id FROM dw JOIN bw USING (k, win)
), spots AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, coalesce(string_agg(item_id, ',' ORDER BY item_id), '') AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN items USING (r)
"""
