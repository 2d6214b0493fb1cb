"""Table sinks and guarded reads, reports, and sampling of impressions."""

from __future__ import annotations

import shutil
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillrank.config import SEED


def save(df: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> None:
    """Parquet, partitioned by columns such as dataset and split so that reads of one prune the rest."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def save_report(metrics: DataFrame, path: str) -> None:
    """A long metrics table as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def load_if_there(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """The table at a path, or None where nothing was written."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def save_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("article_id", F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors saved at a path, or None where there are none."""
    return load_if_there(spark, path)


def cached_vectors(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The vectors saved at a path; made and saved first where there are none."""
    if load_vectors(spark, path) is None:
        save_vectors(make(), path)
    return spark.read.parquet(path)


def unzip(archive: str, folder: str) -> None:
    """Unpack unless the folder already holds something; a single nested folder is hoisted."""
    target = Path(folder)
    if target.exists() and any(target.iterdir()):
        return
    target.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as packed:
        packed.extractall(target)
    inner = list(target.iterdir())
    if len(inner) == 1 and inner[0].is_dir():
        for path in inner[0].iterdir():
            shutil.move(str(path), target)
        inner[0].rmdir()


def sample_impressions(impressions: DataFrame, n: int, *, by: tuple[str, ...] = ("split",), seed: int = SEED) -> DataFrame:
    """All candidates of ``n`` impressions a group, chosen by hash order of a two-column projection, then a semi-join."""
    from pyspark.sql.window import Window

    ids = impressions.select(*by, "impression_id").distinct()
    at = Window.partitionBy(*by).orderBy(F.xxhash64("impression_id", F.lit(seed)), "impression_id")
    chosen = ids.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= n).select("impression_id")
    return impressions.join(chosen, "impression_id", "left_semi")


def read_columns(spark: SparkSession, path: str, columns: tuple[str, ...], **equal: str) -> DataFrame:
    """Pruned, filtered Parquet read: columns and equality filters reach the scan."""
    df = spark.read.parquet(path)
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df.select(*columns)
