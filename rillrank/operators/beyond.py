"""Beyond-accuracy metrics: diversity, novelty and coverage of recommended lists (keys, article_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train_popularity(impressions: DataFrame, *, clicked_only: bool = True) -> DataFrame:
    """Train clicks per article; ``clicked_only=False`` keeps shown articles without a click."""
    train = impressions.where("split = 'train'")
    counts = train.groupBy("article_id").agg(F.sum("clicked").alias("clicks"))
    return counts.where("clicks > 0") if clicked_only else counts


def diversity(lists: DataFrame, vectors: DataFrame, *, key: str = "impression_id") -> DataFrame:
    """One minus the mean pairwise cosine of a list's known unit vectors; null below two.

    Closed form: the sum over pairs is (|sum v|^2 - sum |v|^2) / 2, so a list is summed, not paired with itself.
    """
    spread = lists.join(vectors, "article_id").select(key, F.posexplode("vec").alias("d", "x"))
    by_slot = spread.groupBy(key, "d").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"),
        F.count(F.lit(1)).alias("n"),
    )
    totals = by_slot.groupBy(key).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    value = 1 - (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))
    return lists.select(key).distinct().join(totals, key, "left").select(key, F.when(F.col("n") >= 2, value).alias("diversity"))


def novelty(lists: DataFrame, popularity: DataFrame, *, key: str = "impression_id") -> DataFrame:
    """Mean of -log2((clicks + 1) / (all clicks + known articles + 1)) over a list."""
    totals = popularity.agg(F.coalesce(F.sum("clicks"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("known"))
    joined = lists.join(popularity, "article_id", "left").crossJoin(F.broadcast(totals))
    share = (F.coalesce("clicks", F.lit(0)) + 1) / (F.col("total") + F.col("known") + 1)
    return joined.groupBy(key).agg(F.avg(-F.log2(share)).alias("novelty"))


def coverage(lists: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct recommended articles over the catalog's size; 0 for an empty catalog."""
    seen = lists.agg(F.count_distinct("article_id").alias("seen"))
    size = catalog.agg(F.count_distinct("article_id").alias("size"))
    return seen.crossJoin(size).select(
        "seen", "size", F.coalesce(F.col("seen") / F.nullif(F.col("size"), F.lit(0)), F.lit(0.0)).alias("coverage")
    )


def head_articles(popularity: DataFrame, percentile: float) -> DataFrame:
    """Articles at or above the clicks percentile."""
    cutoff = popularity.agg(F.percentile("clicks", percentile).alias("cutoff"))
    return popularity.crossJoin(F.broadcast(cutoff)).select("article_id", (F.col("clicks") >= F.col("cutoff")).alias("head"))
