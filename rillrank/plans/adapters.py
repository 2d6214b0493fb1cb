"""The test tables in the domain schema: impressions, history, articles, corpus and vectors.

Column names and types are those of the domain relations; ids are strings, ``us`` is a timestamp in microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillrank.functions.columns import micros

#: A total order of an order's lines: line numbers repeat, so every other column breaks the tie.
_LINES = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: an order is an impression, its lines are the candidates, a returned line is a click."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    at = Window.partitionBy("l_orderkey").orderBy(*_LINES)
    placed = lines.select(
        F.col("l_orderkey"),
        F.col("l_partkey"),
        (F.col("l_returnflag") == "R").cast("int").alias("clicked"),
        (F.row_number().over(at) - 1).alias("position"),
    )
    odd = F.col("o_custkey") % 2 == 1
    return placed.join(orders, placed.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("impression_id"),
        F.when(odd, "odd").otherwise("even").alias("dataset"),
        F.col("o_custkey").cast("string").alias("user_id"),
        F.col("l_partkey").cast("string").alias("article_id"),
        micros(F.col("o_orderdate")).alias("us"),
        "clicked",
        "position",
        F.lit(None).cast("string").alias("session_id"),
        F.when(odd, F.col("o_totalprice")).alias("read_time"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per past click; (us, source_row, hist_pos) orders a user's clicks totally."""
    return clicks_of(impressions(spark, sf_dir))


def clicks_of(shown: DataFrame) -> DataFrame:
    """The clicked candidates of an impressions table as its history."""
    return shown.where("clicked = 1").select(
        "dataset", "user_id", "article_id", "us", F.col("impression_id").cast("long").alias("source_row"), F.col("position").alias("hist_pos")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article and dataset; published is the first ship date, which may follow an impression."""
    parts = table(spark, sf_dir, "part")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("first"))
    one = parts.join(shipped, parts.p_partkey == shipped.l_partkey, "left").select(
        F.col("p_partkey").cast("string").alias("article_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("abstract"),
        F.lit(None).cast("string").alias("body"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("entities"),
        micros(F.col("first")).alias("published_us"),
    )
    return one.withColumn("dataset", F.explode(F.array(F.lit("even"), F.lit("odd"))))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a text collection."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article vectors; articles beyond the table have none."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("article_id"), F.col("embedding").alias("vec")
    )
