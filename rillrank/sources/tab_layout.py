"""Click logs as headerless tab-separated files: a news file of 8 columns and a behaviors file of 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillrank.functions.columns import micros
from rillrank.operators.store import first_by_key

# Fixed layouts.
NEWS = "news_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS = "impression_id string, user_id string, time string, history string, impressions string"
TIME = "M/d/yyyy h:mm:ss a"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", quote="", escape="")


def news(spark: SparkSession, path: str, *, dataset: str, source: int = 0) -> DataFrame:
    """Articles of one file; entities are the title's and abstract's joined by a bar."""
    return _read(spark, path, NEWS).select(
        F.col("news_id").alias("article_id"), F.lit(dataset).alias("dataset"), "title", "abstract",
        F.lit(None).cast("string").alias("body"), "category", "subcategory",
        F.concat(F.coalesce("title_entities", F.lit("")), F.lit("|"), F.coalesce("abstract_entities", F.lit(""))).alias("entities"),
        F.lit(None).cast("bigint").alias("published_us"), "url", F.lit(source).alias("source"),
    )


def candidates(behaviors: DataFrame) -> DataFrame:
    """One row per ``id-0`` or ``id-1`` token, positions from 0; other tokens are dropped, positions kept."""
    tokens = behaviors.select("*", F.posexplode(F.split(F.coalesce("impressions", F.lit("")), " ")).alias("position", "token"))
    parsed = r"^(.*)-([01])$"
    return tokens.where(F.col("token").rlike(parsed)).select(
        "*", F.regexp_extract("token", parsed, 1).alias("article_id"), F.regexp_extract("token", parsed, 2).cast("int").alias("clicked")
    ).drop("token", "impressions")


def malformed(behaviors: DataFrame) -> DataFrame:
    """How many candidate tokens were dropped."""
    tokens = behaviors.select(F.explode(F.split(F.coalesce("impressions", F.lit("")), " ")).alias("token"))
    return tokens.where("token != ''").agg(F.count(F.when(~F.col("token").rlike(r"^(.*)-([01])$"), 1)).alias("malformed"))


def behaviors(spark: SparkSession, path: str, *, dataset: str, source: int = 0) -> tuple[DataFrame, DataFrame]:
    """Impressions and history of one file.

    An impression is known by its source and id, as ids repeat across files.  Each impression's history list takes the
    impression's own time, so it counts for the user's later impressions.
    """
    raw = _read(spark, path, BEHAVIORS).withColumn("us", micros(F.try_to_timestamp("time", F.lit(TIME))))
    keyed = raw.withColumn("impression_id", F.concat_ws(":", F.lit(dataset), F.lit(source), "impression_id"))
    shown = candidates(keyed).select(
        "impression_id", F.lit(dataset).alias("dataset"), "user_id", "article_id", "us", "clicked", "position",
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("double").alias("read_time"),
    )
    past = keyed.where("history is not null and history != ''").select(
        "user_id", F.lit(dataset).alias("dataset"), F.posexplode(F.split("history", " ")).alias("hist_pos", "article_id"), "us",
        F.xxhash64("impression_id").alias("source_row"),
    ).where("article_id != ''")
    return shown, past


def load(spark: SparkSession, parts: list[tuple[str, str]], *, dataset: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles, impressions and history of several (news, behaviors) files; the first file's article wins."""
    all_news = shown = past = None
    for source, (news_path, behaviors_path) in enumerate(parts):
        n = news(spark, news_path, dataset=dataset, source=source)
        s, p = behaviors(spark, behaviors_path, dataset=dataset, source=source)
        all_news, shown, past = (n, s, p) if all_news is None else (all_news.unionByName(n), shown.unionByName(s), past.unionByName(p))
    one = first_by_key(all_news, ["dataset", "article_id"], ["source", "title", "category", "url"]).drop("source")
    return one, shown, past
