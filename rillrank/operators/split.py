"""Temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillrank.config import DAY_US
from rillrank.functions.columns import few

#: (test days, validation days) by dataset.
SPLIT_DAYS = {"even": (60, 60), "odd": (120, 120)}


def temporal_split(impressions: DataFrame, days: dict[str, tuple[int, int]], default: tuple[int, int] = (1, 1)) -> DataFrame:
    """Adds ``split``: test within the last test days of its dataset, val within the days before, else train.

    A null time is train.  The latest times are one row per dataset, broadcast behind a check of their number, so that
    impressions don't move.
    """
    latest = impressions.groupBy("dataset").agg(F.max("us").alias("latest_us"))
    test, val = F.lit(default[0]), F.lit(default[1])
    for name, (t, v) in days.items():
        test = F.when(F.col("dataset") == name, t).otherwise(test)
        val = F.when(F.col("dataset") == name, v).otherwise(val)
    latest = latest.withColumn("test_us", F.col("latest_us") - test * DAY_US).withColumn(
        "val_us", F.col("test_us") - val * DAY_US
    )
    split = F.when(F.col("us") >= F.col("test_us"), "test").when(F.col("us") >= F.col("val_us"), "val").otherwise("train")
    return impressions.join(few(latest), "dataset", "left").withColumn("split", split).drop("latest_us", "test_us", "val_us")


def split_counts(impressions: DataFrame) -> DataFrame:
    """Candidates by dataset, one column per split."""
    return impressions.groupBy("dataset").pivot("split", ["train", "val", "test"]).count().fillna(0)
