"""Structural confidence of line items, routing bands, and the summary of each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import words
from tallyspan.functions.exprs import contains_any, is_blank, percent, strip


def confidence_flags(label: Column, value: Column) -> Column:
    label, value = (strip(F.coalesce(c, F.lit(""))) for c in (label, value))
    low = F.lower(label)
    flat = is_blank(label) | (label == value) | ~label.contains(" / ")
    unclear = is_blank(label) | low.contains("merged") | low.contains("ambiguous")
    marked = label.rlike(words.NOTE_MARK) | value.rlike(words.NOTE_MARK)
    named = ((flat, "missing_header_hierarchy"), (unclear, "label_ambiguity"), (marked, "note_marker_present"))
    # arrays put together stay in generated code, which array_compact() does not
    return F.concat(*[F.when(c, F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for c, n in named])


def confidence_score(items: DataFrame) -> DataFrame:
    """+ flags, score: hundredths are whole numbers until the end, so bands have exact edges."""
    out = items.withColumn("flags", confidence_flags(F.col("label"), F.col("value")))
    lost = [("missing_header_hierarchy", 15), ("label_ambiguity", 35), ("note_marker_present", 10)]
    points = F.lit(100)
    for flag, n in lost:
        points = points - F.when(F.array_contains("flags", flag), n).otherwise(0)
    return out.withColumn("score", F.greatest(points, F.lit(0)) / 100)


def confidence_band(score: Column) -> Column:
    return F.when(score >= words.LEAST_CONFIDENCE_AUTO / 100, "auto_accepted").when(score >= words.LEAST_CONFIDENCE_REVIEW / 100, "needs_review").otherwise("manual_required")


def score_with_context(items: DataFrame) -> DataFrame:
    """Scored items; an error item has score 0, is left to people and carries one flag."""
    scored = confidence_score(items).withColumn("band", confidence_band(F.col("score")))
    err = F.col("is_error")
    title = F.lower("table_name")
    return scored.withColumns(
        {
            "score": F.when(err, 0.0).otherwise(F.col("score")),
            "band": F.when(err, "manual_required").otherwise(F.col("band")),
            "flags": F.when(err, F.array(F.lit("extraction_error"))).otherwise(F.col("flags")),
            "status": F.when(err, "extraction_error").otherwise("ok"),
            "is_candidate": contains_any(title, words.RECONCILIATION_TITLES),
        }
    )


def flagged_records(scored: DataFrame) -> DataFrame:
    return scored.where("band <> 'auto_accepted'")


def score_with_items(records: DataFrame, normalized: DataFrame) -> DataFrame:
    """Scored records, each with the normalized item at its place - but only in jobs that have as many items as
    records; elsewhere records are scored alone.

    records: job_id, record_index, label, value, is_candidate; normalized: job_id, record_index, table_name,
    is_error, error_detail, is_candidate. Counts are windows on job_id, so the join's exchange serves them.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    items = normalized.select("job_id", "record_index", F.struct("table_name", "is_error", "error_detail", "is_candidate", size.alias("n")).alias("item"))
    out = records.withColumn("_n", size).join(items, ["job_id", "record_index"], "left")
    item = F.when(F.col("item.n") == F.col("_n"), F.col("item"))
    scored = confidence_score(out.withColumn("item", item)).withColumn("band", confidence_band(F.col("score")))
    err = F.coalesce(F.col("item.is_error"), F.lit(False))
    return scored.withColumns(
        {
            "score": F.when(err, 0.0).otherwise(F.col("score")),
            "band": F.when(err, "manual_required").otherwise(F.col("band")),
            "flags": F.when(err, F.array(F.lit("extraction_error"))).otherwise(F.col("flags")),
            "status": F.when(err, "extraction_error").otherwise("ok"),
            "error_detail": F.when(err, F.coalesce(F.nullif(F.col("item.error_detail"), F.lit("")), F.lit("Extraction error"))),
            "table_name": F.col("item.table_name"),
            "is_candidate": F.coalesce("item.is_candidate", "is_candidate"),
        }
    ).drop("_n", "item")


def extraction_summary(jobs: DataFrame, scored: DataFrame, image_only: DataFrame | None = None) -> DataFrame:
    """One row a job, jobs without items included: they pass. Partial sums meet on job_id.

    image_only (job_id, image_only) counts pages without text; a job it lacks has none.
    """
    per = scored.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("band") == b).alias(b) for b in ("auto_accepted", "needs_review", "manual_required")],
        F.count_if(F.col("status") == "extraction_error").alias("errors"),
        F.count_if(~F.col("is_candidate")).alias("non_candidates"),
    )
    counts = ["total", "auto_accepted", "needs_review", "manual_required", "errors", "non_candidates"]
    out = jobs.select("job_id").join(per, "job_id", "left").fillna(0, counts)
    if image_only is not None:
        out = out.join(image_only, "job_id", "left").fillna(0, ["image_only"])
    out = out.withColumn("flagged", F.col("needs_review") + F.col("manual_required"))
    out = out.withColumn("flagged_percent", percent(F.col("flagged"), F.col("total")))
    return out.withColumn("passed", F.col("flagged_percent") <= words.MOST_FLAGGED_PERCENT)
