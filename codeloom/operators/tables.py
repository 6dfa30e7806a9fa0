"""What operators share about physical tables: checked broadcasts and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that may be sent to every executor.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; counting stops just beyond. A larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has no more than half as many partitions, as a small table in one row group does. Larger tables
    stay as they are, so nothing of them is shuffled."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if 2 * df.rdd.getNumPartitions() <= wanted else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session that has none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once however often it is read, and safe from lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
