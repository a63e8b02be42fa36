"""Intake of files and job events; stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.sources import snapshots

# Fixed values of intake.
MOST_BYTES, MAGIC, METRICS = 104_857_600, "%PDF", ("Adjusted EBITDA", "EBITDA", "Net Income", "Free Cash Flow")


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, head) of files; only the head of the content leaves the scan.

    Spark's file sources do not list empty files: these are turned away by not appearing, and the
    gate's first rule serves listings that come as tables.
    """
    return spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 4).alias("head"))


def intake_gate(files: DataFrame) -> DataFrame:
    """+ reason: the first check that fails, cheap ones first; null where the file is accepted.

    files: length in bytes, head (the first characters) and, where the request names one, target_metric.
    """
    reason = F.when(F.col("length") == 0, "file is empty").when(F.col("length") > MOST_BYTES, "file is too large").when(F.col("head") != MAGIC, "file is not a PDF")
    if "target_metric" in files.columns:
        reason = reason.when(~F.coalesce(F.col("target_metric").isin(*METRICS), F.lit(False)), "metric is not supported")
    return files.withColumn("reason", reason)


def intake_split(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): gated files, the rejected with their reason."""
    gated = intake_gate(files)
    return gated.where("reason is null").drop("reason"), gated.where("reason is not null")


def jobs_status(events: DataFrame) -> DataFrame:
    """(job_id, status, model_ready): the latest status wins; model_ready keeps its last given value."""
    ready = F.when(F.col("model_ready").isNotNull(), F.col("seq"))
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("model_ready", ready).alias("model_ready"))


def stage_sink(df: DataFrame, root: str, stage: str, key: str = "job_id") -> int:
    """Replace the rows of the jobs that df holds in the stage's table, all of them or none; other jobs stay. The number of the commit."""
    return snapshots.replace_keys(df, root, stage, key)
