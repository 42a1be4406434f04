"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has made and not given back.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Without the setting one under /tmp, as in tests, where all is one machine;
    a cluster is refused, as its machines don't share that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    MADE.append(f"{base.rstrip('/')}/tileframe-{uuid.uuid4().hex}")
    return MADE[-1]


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Deletes all folders that this process has made, and tells how many: for the time when the results that read them have
    been written, as a result is a plan over such tables until then."""
    n = len(MADE)
    while MADE:
        dropped(spark, MADE.pop())
    return n
