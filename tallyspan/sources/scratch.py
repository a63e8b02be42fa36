"""The shared folder for tables and streams that outlive a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only in local mode and where none is named."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _own(spark)


def _own(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, where a result is read more than once and must not be made anew."""
    path = f"{scratch_dir(df.sparkSession)}/tallyspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """stored(), in buckets of key: joins, groups and windows by it, alone or with more columns, need no exchange. The table's name
    goes at once; its folder stays, as those of stored() do."""
    spark, name = df.sparkSession, f"tallyspan_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out
