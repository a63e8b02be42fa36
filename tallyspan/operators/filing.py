"""Filings from parsed cells to normalized records in one plan; rows that fail go aside, with stage and reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.operators import cells as c
from tallyspan.operators import scoring, taxonomy

#: Why a row is in the error table, by the stage that it failed in.
NO_CELL, NO_PAGE = "cell could not be parsed", "page has no size"
RECORD = ("job_id", "source_file", "table_idx", "cell_idx", "record_index", "value", "label", "page", *c.BOX, "table_name", "is_candidate", "score", "band", "flags", "status", "normalized_label", "taxonomy_status")


def filing_rows(cells: DataFrame, dims: DataFrame, terms: DataFrame, classifier: Callable[[Column], Column] = taxonomy.dictionary_answer, tables: DataFrame | None = None, metric: str = "", candidates_only: bool = False) -> DataFrame:
    """Every record of the filings, with outcome (item or error), stage and reason.

    cells (job_id, source_file, table_idx, cell_idx, text, start_row, start_col, is_row_header, is_col_header, page_cell, page_table,
    bbox_cell, bbox_prov, bbox_table); dims (source_file, page, width, height); terms, the taxonomy; tables, captions
    for table_title(). Labels come from headers, noise is dropped, a malformed cell or a page without size makes an error row and
    stops nothing else; cells are read once, in one exchange by table; a classifier's error sends a record aside, too. Errors keep their place in the filing's order.
    """
    spots = ["page_cell", "page_table", "bbox_cell", "bbox_prov", "bbox_table"]
    rows = c.cell_error_rows(c.titled_cells(c.cell_location(cells).drop(*spots), tables, metric))
    rows = rows.where(F.col("is_error") | ~c.is_noise(F.col("text"))).withColumnRenamed("is_error", "bad_cell")
    rows = c.item_order(rows)
    rows = c.bbox_normalize(rows, dims).withColumnRenamed("is_error", "bad_page")
    rows = rows.withColumns({"is_error": F.col("bad_cell") | F.col("bad_page"), "value": F.coalesce("text", F.lit(""))} | {b: F.when(F.col("bad_cell"), 0.0).otherwise(F.col(b)) for b in c.BOX})
    scored = scoring.score_with_context(rows).withColumn("is_candidate", F.coalesce("named", F.lit(False)))
    done = taxonomy.normalize_answered(taxonomy.with_answers(scored, classifier, candidates_only), terms)
    stage = F.when(F.col("bad_cell"), "cells").when(F.col("bad_page"), "boxes").when(F.col("bad_answer").isNotNull(), "classification")
    reason = F.when(F.col("bad_cell"), NO_CELL).when(F.col("bad_page"), NO_PAGE).otherwise(F.col("bad_answer"))
    return done.select(*RECORD, F.when(stage.isNull(), "item").otherwise("error").alias("outcome"), stage.alias("stage"), reason.alias("reason"))


def write_filing_rows(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, errors): rows written once, by outcome, and read back; a rerun replaces."""
    rows.write.mode("overwrite").partitionBy("outcome").parquet(path)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    back = rows.sparkSession.read.schema(kinds).parquet(path)
    return back.where("outcome = 'item'"), back.where("outcome = 'error'")


def filing_states(jobs: DataFrame, rows: DataFrame) -> DataFrame:
    """(job_id, status, reason, items, errors) of jobs (job_id): done with one usable row, else failed."""
    per = rows.groupBy("job_id").agg(F.count_if(F.col("outcome") == "item").alias("items"), F.count_if(F.col("outcome") == "error").alias("errors"), F.min_by("reason", F.when(F.col("outcome") == "error", F.col("record_index"))).alias("first"))
    out = jobs.select("job_id").join(per, "job_id", "left").fillna(0, ["items", "errors"])
    reason = F.when((F.col("items") + F.col("errors")) == 0, "no records").when(F.col("items") == 0, F.col("first"))
    return out.select("job_id", F.when(reason.isNull(), "done").otherwise("failed").alias("status"), reason.alias("reason"), "items", "errors")
