"""Ground truth and decision logs from files, and the drift tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.operators.drift import KEYS
from tallyspan.sources import snapshots

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
GT_ITEM = f"struct<value:string,label:string,normalized_label:string,page:int,bbox:{BOX},source_file:string,is_optional:boolean,section:string>"
GT_META = "struct<filing_id:string,company_name:string,ticker:string,fiscal_year:int,filing_type:string,page_count:int,target_metric:string>"
GT = f"metadata {GT_META}, ground_truth_items array<{GT_ITEM}>, expected_reconciliation_total double"
LOG = "job_id string, record_index int, timestamp string, taxonomy_status string, resulting_state string, error_detail string, _corrupt_record string"


def gt_corpus_scan(spark: SparkSession, root: str, manifest: str | None = None, name: str = "ground_truth.json") -> tuple[DataFrame, DataFrame]:
    """(filings, items) of root/<folder>/name: those the manifest names, in its order, else all by name. Of a folder key=value, as
    a partitioned table has them, the value is the name.

    A folder that the manifest names and root lacks is a filing with is_known false and nothing else.
    """
    raw = spark.read.schema(GT).option("multiLine", True).json(f"{root}/*/{name}")
    raw = raw.withColumn("folder", F.url_decode(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2), "^[^=]*=", "")))
    if manifest:
        named = spark.read.schema("filing_ids array<string>").option("multiLine", True).json(manifest)
        raw = named.select(F.posexplode("filing_ids").alias("position", "folder")).join(raw.withColumn("is_known", F.lit(True)), "folder", "left")
        order = F.format_string("%09d", "position")
    else:
        order = F.col("folder")
    known = F.coalesce("is_known", F.lit(False)) if manifest else F.lit(True)
    raw = raw.withColumn("order_key", order)
    filings = raw.select("order_key", "folder", known.alias("is_known"), "metadata.*", F.col("expected_reconciliation_total").alias("expected_total"))
    items = raw.select(F.col("metadata.filing_id").alias("job_id"), F.posexplode("ground_truth_items").alias("item_pos", "i")).select("job_id", "item_pos", "i.*")
    return filings, items


def decision_log_sink(log: DataFrame, path: str) -> None:
    """One line of JSON a decision, in record order within each file; a rerun replaces."""
    log.repartition("job_id").sortWithinPartitions("job_id", "record_index").write.mode("overwrite").json(path)


def decision_log_scan(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of the log; blank lines are skipped, a malformed line keeps its text in _corrupt_record."""
    return spark.read.schema(LOG).json(path)


def drift_store(nodes: DataFrame, edges: DataFrame, root: str, keys: tuple = KEYS) -> int:
    """Replace nodes, edges and the latest node of each history, all three or none; the number of the commit."""
    last = nodes.groupBy(*keys).agg(F.max_by("node", "eval_seq").alias("node"))
    return snapshots.commit(nodes.sparkSession, root, {"nodes": nodes, "edges": edges, "latest": last})


def drift_load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, latest node of each history) of one commit, the last."""
    version = snapshots.latest(spark, root)
    return tuple(snapshots.read(spark, root, n, version) for n in ("nodes", "edges", "latest"))
