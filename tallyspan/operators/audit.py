"""Audit trail: leaves under each model cell with their review state, overrides, governance, drift and job state.

Every operator holds many jobs at once; job_id is a key of each join and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.exprs import is_blank, strip
from tallyspan.operators.drift import drift_scope

CELL, BOX = ["job_id", "sheet", "coord"], ("x0", "y0", "x1", "y1")


def provenance_scan(provenance: DataFrame, refs: DataFrame) -> DataFrame:
    """The record that each of refs (job_id, sheet, coord) points to; blanks around both and the case of coord do not matter. Where
    several records have one place, the first by seq, if there is one, else by node_id."""
    wanted = refs.select("job_id", strip(F.col("sheet")).alias("sheet"), F.upper(strip(F.col("coord"))).alias("coord")).distinct()
    found = provenance.join(wanted, CELL, "left_semi")
    first = Window.partitionBy(*CELL).orderBy(*(c for c in ("seq", "node_id") if c in provenance.columns))
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def chain_leaf_pick(provenance: DataFrame) -> DataFrame:
    """(job_id, leaf_id, sheet, coord): the last record among the inputs, else the first of any sheet, by seq."""
    inputs = F.col("sheet") == "Source_Inputs"
    rank = F.struct(inputs, F.when(inputs, F.col("seq")).otherwise(-F.col("seq")))
    leaves = provenance.where(F.col("node_id").startswith("leaf_"))
    picked = leaves.groupBy("job_id", F.col("node_id").alias("leaf_id")).agg(F.max_by(F.struct("sheet", "coord"), rank).alias("p"))
    return picked.select("job_id", "leaf_id", "p.sheet", "p.coord")


#: Rows of a job that each row of another table looks through; jobs with more go by a join of both keys.
MOST_BY_JOB = 256


def _left_by_job(rows: DataFrame, other: DataFrame, key: str, most: int, sizes: DataFrame | None = None) -> DataFrame:
    """rows left join other on (job_id, key), with other's further columns as the struct _of.

    A job of at most ``most`` rows of other, or of sizes, where these are cheaper to count, hands them on as one list, joined by job
    alone, which sends nothing where both tables are dealt by job; jobs with more, if there are any, are joined by both keys.
    """
    of = F.struct(*[c for c in other.columns if c not in ("job_id", key)])
    packed = other.select("job_id", F.col(key).alias("_key"), of.alias("_of"))
    lists = lambda df: df.groupBy("job_id").agg(F.collect_list(F.struct("_key", "_of")).alias("_list"))
    hit = F.explode_outer(F.filter("_list", lambda x: x["_key"] == F.col(key)))
    listed = lambda df, given: df.join(lists(given), "job_id", "left").withColumn("_hit", hit).withColumn("_of", F.col("_hit._of")).drop("_list", "_hit")
    large = (other if sizes is None else sizes).groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("job_id")
    if large.isEmpty():
        return listed(rows, packed)
    far = packed.join(large, "job_id", "left_semi").select("job_id", F.col("_key").alias(key), "_of")
    far = rows.join(large, "job_id", "left_semi").join(far, ["job_id", key], "left")
    return listed(rows.join(large, "job_id", "left_anti"), packed.join(large, "job_id", "left_anti")).unionByName(far)


def chain_review_enrich(chain: DataFrame, review: DataFrame, most: int = MOST_BY_JOB) -> DataFrame:
    """chain + review_status, value, label of the job's reviewed item; jobs under review may lack an item, others have none."""
    index = F.regexp_extract("leaf_id", r"^leaf_(\d+)_", 1)
    items = review.select("job_id", F.col("id").alias("item_id"), "status", "value", "label")
    reviewed = review.select("job_id").distinct().withColumn("_reviewed", F.lit(True))
    out = _left_by_job(chain.withColumn("item_id", F.concat("job_id", F.lit("_"), index)), items, "item_id", most).join(reviewed, "job_id", "left")
    absent = F.when(F.col("_reviewed"), "source_record_missing").otherwise("unreviewed")
    return out.select(*CELL, "leaf_id", F.coalesce("_of.status", absent).alias("review_status"), "_of.value", "_of.label")


def chain_components(chain: DataFrame, leaves: DataFrame, review: DataFrame, most: int = MOST_BY_JOB) -> DataFrame:
    """chain_review_enrich() with the leaf's source_file, page and box from leaves (job_id, leaf_id, source_file, page, x0..y1).

    A leaf without such a record is a gap: source unknown, page 1, a box of zeros, value and label [missing].
    """
    records = leaves.select("job_id", "leaf_id", "source_file", "page", "x0", "y0", "x1", "y1")
    out = _left_by_job(chain_review_enrich(chain, review, most), records, "leaf_id", most).withColumnRenamed("_of", "rec")
    gap = F.col("rec").isNull()
    missing = F.lit("[missing]")
    return out.select(
        *CELL, "leaf_id", F.when(gap, "source_record_missing").otherwise(F.col("review_status")).alias("review_status"), gap.alias("is_gap"),
        F.when(gap, missing).otherwise(F.col("value")).alias("value"), F.when(gap, missing).otherwise(F.col("label")).alias("label"), F.when(gap, "unknown").otherwise(F.col("rec.source_file")).alias("source_file"),
        F.when(gap, 1).otherwise(F.col("rec.page")).alias("page"), *[F.when(gap, 0.0).otherwise(F.col("rec." + b)).alias(b) for b in ("x0", "y0", "x1", "y1")],
    )


def chain_rollup(cells: DataFrame, enriched: DataFrame) -> DataFrame:
    """(job_id, sheet, coord, state, n, locked): the first that holds of no parts, any missing, any flagged, all locked."""
    s = F.col("review_status")
    per = enriched.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "locked").alias("locked"), F.count_if(s == "source_record_missing").alias("missing"), F.count_if(s == "flagged").alias("flagged")
    )
    out = cells.select(*CELL).join(per, CELL, "left").fillna(0, ["n", "locked", "missing", "flagged"])
    c = F.col
    state = F.when(c("n") == 0, "in_review").when(c("missing") > 0, "has_missing").when(c("flagged") > 0, "contains_flagged").when(c("locked") == c("n"), "all_locked").otherwise("in_review")
    return out.select(*CELL, state.alias("state"), "n", "locked")


def reconciliation_summary(provenance: DataFrame) -> DataFrame:
    """The formula cells of each job; all its cells where it has none."""
    derived = F.col("is_formula") | (F.col("sheet") == "Model_Summary")
    any_derived = F.max(derived).over(Window.partitionBy("job_id"))
    return provenance.withColumn("_any", any_derived).where(derived | ~F.col("_any")).drop("_any")


def provenance_matrix(provenance: DataFrame, enriched: DataFrame, most: int = MOST_BY_JOB) -> DataFrame:
    """Every cell with the sorted array of its parts, one join instead of a look-up a cell."""
    cell = F.concat(F.length("sheet"), F.lit(":"), "sheet", "coord").alias("_cell")
    parts = enriched.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("leaf_id", "review_status"))).alias("components"))
    none = F.array().cast("array<struct<leaf_id:string,review_status:string>>")
    out = _left_by_job(provenance.select("*", cell), parts.select("job_id", cell, "components"), "_cell", most, provenance)
    return out.select(*provenance.columns, F.coalesce("_of.components", none).alias("components"))


def manual_overrides(review: DataFrame, scored: DataFrame, provenance: DataFrame) -> DataFrame:
    """(item_id, override_type, original_value, final_value, original_label, final_label, review_status, flags, band, error_detail, source_file,
    page, x0, y0, x1, y1, is_hardcode): what people changed or entered. Flags, band and error are the review's, else the original's."""
    c = F.col
    ident = F.concat("job_id", F.lit("_"), c("record_index").cast("string"))
    was = scored.select(ident.alias("id"), F.struct("value", "label", "status", "flags", "band", *([c("error_detail")] if "error_detail" in scored.columns else [F.lit(None).cast("string").alias("error_detail")])).alias("was"))
    has = lambda n: c(n) if n in review.columns else F.lit(None)
    out = review.join(was, "id", "left")
    error = F.coalesce(c("was.status") == "extraction_error", F.lit(False)) | (c("status") == "extraction_error")
    manual = c("status") == "manual_required"
    edited = F.coalesce(c("value") != c("was.value"), F.lit(False)) | F.coalesce(c("label") != c("was.label"), F.lit(False))
    kind = F.when(error, "extraction_error_recovery").when(manual, "manual_required_entry").when(edited, "user_edit")
    none = F.lit(None).cast("string")
    rows = out.select(
        c("id").alias("item_id"), kind.alias("override_type"), c("was.value").alias("original_value"), c("value").alias("final_value"), c("was.label").alias("original_label"), c("label").alias("final_label"),
        c("status").alias("review_status"), F.coalesce(has("flags").cast("array<string>"), c("was.flags")).alias("flags"), F.coalesce(c("band"), c("was.band")).alias("band"),
        F.coalesce(has("error_detail").cast("string"), c("was.error_detail")).alias("error_detail"), has("source_file").cast("string").alias("source_file"), c("page").alias("page"), *[has(b).cast("double").alias(b) for b in BOX], F.lit(False).alias("is_hardcode"),
    )
    # Fixed values of the audit data set: marks of a cell that was typed in, and the box of a whole page.
    mark, band, detail, whole = "manual_hardcode", "manual_required", "Manual hardcode per NFR2", {"x0": 0.0, "y0": 0.0, "x1": 1000.0, "y1": 1000.0}
    target = lambda path, kind: c("target" + path) if "target" in provenance.columns else F.lit(None).cast(kind)
    spot = target(".selector.refinedBy.coordinates", "struct<x0: double, y0: double, x1: double, y1: double>")
    page = F.regexp_extract(target(".selector.value", "string"), "page=([0-9]+)", 1).try_cast("int")
    typed = provenance.where(c("node_id").startswith("hardcode_")).select(
        F.concat("sheet", F.lit("!"), "coord").alias("item_id"), F.lit(mark).alias("override_type"), none.alias("original_value"), c("body.value").alias("final_value"), none.alias("original_label"),
        c("node_id").alias("final_label"), F.lit(mark).alias("review_status"), F.array(F.lit(mark)).alias("flags"), F.lit(band).alias("band"), F.lit(detail).alias("error_detail"),
        target(".source", "string").alias("source_file"), F.coalesce(page, F.lit(1)).alias("page"), *[F.coalesce(spot[b], F.lit(v)).alias(b) for b, v in whole.items()], F.lit(True).alias("is_hardcode"),
    )
    return rows.where("override_type is not null").unionByName(typed)


def classifier_governance(log: DataFrame) -> DataFrame:
    """(job_id, calls, matched, errors, pending, numeric_free) from lines of JSON; one malformed line zeroes its job.

    numeric_free: no response holds a number or a boolean beside its label and confidence. Blank lines are skipped.
    """
    parsed = log.where(~is_blank(F.col("line"))).select("job_id", F.try_parse_json("line").alias("v"))
    text = lambda path: F.try_variant_get("v", path, "string")
    extras = F.map_filter(F.try_variant_get("v", "$.raw_response", "map<string,variant>"), lambda k, x: ~k.isin("label", "confidence"))
    numeric = F.exists(F.map_values(extras), lambda x: F.schema_of_variant(x).rlike("^(BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"))
    rows = parsed.select(
        "job_id", F.col("v").isNull().alias("bad"), F.coalesce(text("$.taxonomy_status") == "matched", F.lit(False)).alias("tax"),
        F.coalesce(text("$.resulting_state"), F.lit("pending_confirmation")).alias("state"), text("$.error_detail").isNotNull().alias("detail"), F.coalesce(numeric, F.lit(False)).alias("numeric"),
    )
    hit = F.col("tax") | (F.col("state") == "confirmed")
    lost = ~hit & ((F.col("state") == "classification_error") | F.col("detail"))
    per = rows.groupBy("job_id").agg(
        F.bool_or("bad").alias("bad"), F.count(F.lit(1)).alias("calls"), F.count_if(hit).alias("matched"), F.count_if(lost).alias("errors"), F.count_if(~hit & ~lost).alias("pending"), F.bool_and(~F.col("numeric")).alias("free")
    )
    counts = [F.when(F.col("bad"), 0).otherwise(F.col(n)).alias(n) for n in ("calls", "matched", "errors", "pending")]
    return per.select("job_id", *counts, (F.col("bad") | F.col("free")).alias("numeric_free"))


def _evaluated(jobs: DataFrame, compared: DataFrame) -> DataFrame:
    """Jobs with the comparison of their entity, metric and year; a null changed where there is none. Of several of a
    year the last counts."""
    scope = drift_scope(jobs).join(jobs.select("job_id", "target_metric"), "job_id")
    facts = F.struct("is_baseline", "changed", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))
    rows = compared.groupBy("entity", F.col("metric").alias("target_metric"), "year").agg(F.max_by(facts, "eval_seq").alias("x"))
    return scope.join(rows, ["entity", "target_metric", "year"], "left").select(*scope.columns, "x.*")


def drift_summary(jobs: DataFrame, compared: DataFrame) -> DataFrame:
    """(job_id, year, is_evaluated, summary): how the metric's definition stands against the year before."""
    c = F.col
    # The wording of the audit data set.
    text = (
        F.when(c("is_baseline").isNull(), F.format_string("Drift detection not recorded for metric '%s'.", "target_metric"))
        .when(c("is_baseline"), F.format_string("Baseline Year — Initialized definition for %s; no prior-year comparison available.", "target_metric"))
        .when(c("changed"), F.format_string("Metric Redefinition Detected: %d component(s) added, %d removed year-over-year.", "n_added", "n_removed"))
        .otherwise(F.format_string("Metric Continuation — Definition for %s unchanged.", "target_metric"))
    )
    seen = c("is_baseline").isNotNull()
    return _evaluated(jobs, compared).select("job_id", F.when(seen, c("year")).alias("year"), seen.alias("is_evaluated"), text.alias("summary"))


def drift_job_status(jobs: DataFrame, compared: DataFrame) -> DataFrame:
    """(job_id, entity, metric, year, state, flags), one row a job: jobs without locked labels are skipped, not failed."""
    c = F.col
    flag = F.coalesce(~c("is_baseline") & c("changed"), F.lit(False)).cast("int")
    state = F.when(c("is_baseline").isNull(), "skipped_no_locked_records").otherwise("evaluated")
    return _evaluated(jobs, compared).select("job_id", "entity", c("target_metric").alias("metric"), "year", state.alias("state"), flag.alias("flags"))


def report_metadata(jobs: DataFrame, review: DataFrame, provenance: DataFrame, compared: DataFrame) -> DataFrame:
    """(job_id, entity, year, automated, verified, flagged): heading of a job's report; without review all cells are automated."""
    s = F.col("status")
    per = review.groupBy("job_id").agg(F.count_if(s == "auto_accepted").alias("a"), F.count_if(s == "locked").alias("verified"), F.count_if(s == "flagged").alias("flagged"))
    cells = provenance.groupBy("job_id").agg(F.count(F.lit(1)).alias("cells"))
    named = F.regexp_extract("filename", r"((?:19|20)\d{2})", 1).try_cast("int")
    base = jobs.select("job_id", named.alias("file_year")).join(_evaluated(jobs, compared), "job_id")
    out = base.join(per, "job_id", "left").join(cells, "job_id", "left").fillna(0, ["verified", "flagged", "cells"])
    entity = F.when(F.col("entity") == "", "Unknown Entity").otherwise(F.col("entity"))
    year = F.coalesce(F.when(F.col("is_baseline").isNotNull(), F.col("year")), "file_year")
    return out.select("job_id", entity.alias("entity"), year.alias("year"), F.coalesce("a", "cells").alias("automated"), "verified", "flagged")


def model_readiness(jobs: DataFrame, inputs: DataFrame, metrics: tuple[str, ...] = ("Adjusted EBITDA",)) -> DataFrame:
    """(job_id, ready, reason): a job needs a supported metric and one usable input."""
    n = inputs.where("reason is null").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    out = jobs.select("job_id", "target_metric").join(n, "job_id", "left")
    reason = F.when(F.col("n").isNull(), "no confirmed items").when(~F.col("target_metric").isin(*metrics), "metric is not supported")
    return out.select("job_id", reason.isNull().alias("ready"), reason.alias("reason"))


def audit_eligibility(asked: DataFrame, jobs: DataFrame, provenance: DataFrame, review: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """(job_id, state) of asked jobs: ready, build_on_demand from reviewed items, build_from_classified where only those are
    there, model_not_complete, or job_not_found."""
    mark = lambda df, name: df.select("job_id").distinct().withColumn(name, F.lit(True))
    out = asked.select("job_id").join(mark(jobs, "_job"), "job_id", "left").join(mark(provenance, "_model"), "job_id", "left").join(mark(review, "_review"), "job_id", "left")
    out = out.withColumn("_classified", F.lit(False)) if classified is None else out.join(mark(classified, "_classified"), "job_id", "left")
    state = F.when(F.col("_job").isNull(), "job_not_found").when(F.col("_model"), "ready").when(F.col("_review"), "build_on_demand").when(F.col("_classified"), "build_from_classified").otherwise("model_not_complete")
    return out.select("job_id", state.alias("state"))
