"""Review state: first items, actions folded per item, protection of what people locked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.exprs import is_blank


def review_items_init(scored: DataFrame) -> DataFrame:
    """Candidates with their first status."""
    by_band = F.when(F.col("band") == "auto_accepted", "auto_accepted").when(F.col("band") == "needs_review", "needs_review").otherwise("manual_required")
    status = F.when(F.col("status") == "extraction_error", "extraction_error").when(F.coalesce(F.col("taxonomy_status") == "pending", F.lit(False)), "pending_taxonomy").otherwise(by_band)
    ident = F.concat("job_id", F.lit("_"), F.col("record_index").cast("string"))
    return scored.where("is_candidate").select(ident.alias("id"), "job_id", "record_index", "value", "label", "page", "score", "band", "table_name", "normalized_label", "taxonomy_status", "x0", "y0", "x1", "y1", "is_candidate", status.alias("status"))


def review_sources(scored: DataFrame, classified: DataFrame, saved: DataFrame) -> DataFrame:
    """Review items of each job from the best source that has the job: saved items, else classified records, else scored ones.

    scored and classified are records; scored ones have neither a normalized label nor a taxonomy status.
    """
    none = F.lit(None).cast("string")
    plain = scored.withColumns({"normalized_label": none, "taxonomy_status": none})
    from_classified = review_items_init(classified.join(saved.select("job_id").distinct(), "job_id", "left_anti"))
    taken = saved.select("job_id").union(classified.select("job_id")).distinct()
    from_scored = review_items_init(plain.join(taken, "job_id", "left_anti"))
    mark = lambda df, name: df.select(*from_scored.columns, F.lit(name).alias("source"))
    return mark(saved, "saved").unionByName(mark(from_classified, "classified")).unionByName(mark(from_scored, "scored"))


def long_logs(actions: DataFrame, least: int) -> DataFrame:
    """(item_id, n): items with more than least actions."""
    return actions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def batch_confirm(items: DataFrame, ids: DataFrame | None = None, candidates_only: bool = True, auto_add: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, terms, locked_ids) after a confirmation of many items at once.

    Those in ids are confirmed; without ids all candidates, or all items where candidates_only is
    off. Extraction errors stay. With auto_add a pending label counts as matched and joins terms
    (term), the input of taxonomy_append(). locked_ids (id) holds earlier locks too.
    """
    if ids is not None:
        chosen = items.join(ids.select("id").distinct().withColumn("_in", F.lit(True)), "id", "left")
    else:
        chosen = items.withColumn("_in", F.col("is_candidate") if candidates_only else F.lit(True))
    lock = F.coalesce("_in", F.lit(False)) & (F.col("status") != "extraction_error")
    pending = (F.col("status") == "pending_taxonomy") | F.coalesce(F.col("taxonomy_status") == "pending", F.lit(False))
    chosen = chosen.withColumns({"_lock": lock, "_add": lock & pending & F.lit(auto_add)})
    terms = chosen.where("_add").select(F.coalesce(F.nullif("normalized_label", F.lit("")), "label").alias("term")).distinct()
    out = chosen.withColumns(
        {
            "status": F.when(F.col("_lock"), "locked").otherwise(F.col("status")),
            "taxonomy_status": F.when(F.col("_add"), "matched").otherwise(F.col("taxonomy_status")),
            "normalized_label": F.when(F.col("_add"), F.coalesce("normalized_label", "label")).otherwise(F.col("normalized_label")),
        }
    ).drop("_in", "_lock", "_add")
    return out, terms, out.where("status = 'locked'").select("id")


def protect_locked(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rerun's rows, but a row that was locked stays as it was; rows that the rerun lacks go."""
    kept = old.where("status = 'locked'").select("id", F.struct(*[F.col(c) for c in new.columns]).alias("_old"))
    out = new.select("id", F.struct(*[F.col(c) for c in new.columns]).alias("_new")).join(kept, "id", "left")
    return out.select(F.coalesce("_old", "_new").alias("r")).select("r.*")


def review_flagged_view(items: DataFrame) -> DataFrame:
    return items.where(F.col("status").isin("needs_review", "manual_required", "extraction_error", "pending_taxonomy", "flagged") | (F.col("score") < 0.95))


def review_counts(items: DataFrame) -> DataFrame:
    """(job_id, total, locked, flagged): flagged are those of review_flagged_view()."""
    seen = F.col("status").isin("needs_review", "manual_required", "extraction_error", "pending_taxonomy", "flagged") | (F.col("score") < 0.95)
    return items.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "locked").alias("locked"), F.count_if(F.coalesce(seen, F.lit(False))).alias("flagged"))


def table_runs(items: DataFrame) -> DataFrame:
    """(job_id, run, table_name, first_index, n): stretches of one table name in item order."""
    w = Window.partitionBy("job_id").orderBy("record_index")
    new = ~F.col("table_name").eqNullSafe(F.lag("table_name").over(w)) | (F.row_number().over(w) == 1)
    rows = items.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("job_id", "run").agg(F.first("table_name").alias("table_name"), F.min("record_index").alias("first_index"), F.count(F.lit(1)).alias("n"))
