"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster, whose executors don't share one,
    gets a ValueError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillrank-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, label: str = "table", *, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet and read back; the table is deleted when the driver ends."""
    path = f"{folder(df.sparkSession)}/rillrank-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, df.sparkSession, path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table; a session that has ended leaves it to the cluster's own cleaning."""
    if spark.sparkContext._jsc is None:
        return
    with suppress(Py4JError, OSError):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
