"""Click logs as Parquet with array columns: articles, behaviors (in-view and clicked ids) and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillrank.functions.columns import micros


def _strings(array: str) -> F.Column:
    return F.col(array).cast("array<string>")


def articles(spark: SparkSession, path: str, *, dataset: str) -> DataFrame:
    """Subtitle is the abstract; the readable category wins over the code; unreadable dates are null."""
    raw = spark.read.parquet(path)
    have = set(raw.columns)
    column = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    return raw.select(
        F.col("article_id").cast("string").alias("article_id"), F.lit(dataset).alias("dataset"), column("title").alias("title"),
        column("subtitle").alias("abstract"), column("body").alias("body"),
        F.coalesce(column("category_str"), column("category")).alias("category"), column("subcategory").alias("subcategory"),
        column("ner_clusters").alias("entities"), micros(F.try_to_timestamp(column("published_time"))).alias("published_us"),
        column("url").alias("url"),
    )


def impressions(behaviors: DataFrame, *, dataset: str) -> DataFrame:
    """One row per in-view article; a null in-view list gives none, a null clicked list no click."""
    hit = F.coalesce(F.array_contains(_strings("article_ids_clicked"), F.col("article_id")), F.lit(False))
    return behaviors.select("*", F.posexplode(_strings("article_ids_inview")).alias("position", "article_id")).select(
        F.concat_ws(":", F.lit(dataset), F.col("impression_id").cast("string")).alias("impression_id"), F.lit(dataset).alias("dataset"),
        F.col("user_id").cast("string").alias("user_id"), "article_id", micros(F.col("impression_time")).alias("us"),
        hit.cast("int").alias("clicked"), "position", F.col("session_id").cast("string").alias("session_id"),
        F.col("read_time").cast("double").alias("read_time"),
    )


def history(raw: DataFrame, *, dataset: str) -> DataFrame:
    """One row per past click; the longer of the two arrays is cut to the shorter."""
    n = F.least(F.size("article_id_fixed"), F.size("impression_time_fixed"))
    pairs = F.arrays_zip(
        F.slice(_strings("article_id_fixed"), F.lit(1), n).alias("article_id"), F.slice("impression_time_fixed", F.lit(1), n).alias("time")
    )
    return raw.where(n > 0).select(F.col("user_id").cast("string").alias("user_id"), F.posexplode(pairs).alias("hist_pos", "p")).select(
        "user_id", F.lit(dataset).alias("dataset"), F.col("p.article_id").alias("article_id"), micros(F.col("p.time")).alias("us"),
        F.lit(0).cast("bigint").alias("source_row"), "hist_pos",
    )


def load(spark: SparkSession, articles_path: str, behaviors_path: str, history_path: str, *, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, impressions and history in the domain schema."""
    return (
        articles(spark, articles_path, dataset=dataset),
        impressions(spark.read.parquet(behaviors_path), dataset=dataset),
        history(spark.read.parquet(history_path), dataset=dataset),
    )
