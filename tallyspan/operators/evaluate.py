"""Extraction against ground truth: match, diffs, metrics of each filing and of the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions import words
from tallyspan.functions.exprs import accounting_number, bbox_iou, percent, ratio, same_value, strip
from tallyspan.operators.matching import matched_pages, matched_sides
from tallyspan.sources.scratch import stored


def truth(items: DataFrame) -> DataFrame:
    return items.select(
        "job_id", "page", F.col("record_index").alias("item_pos"), F.col("value").alias("gt_value"), F.col("label").alias("gt_label"), F.col("p_type").alias("gt_class"),
        (F.col("partkey") % 9 == 0).alias("is_optional"), *[F.col(c).alias("g" + c) for c in ("x0", "y0", "x1", "y1")],
    )


def extracted(items: DataFrame) -> DataFrame:
    """Disturbed copies of the truth, with extra rows: what an extractor might return. One pass over items."""
    both = F.array(*_extracts())
    return items.select("job_id", "page", F.explode(both).alias("r")).where("r is not null").select("job_id", "page", "r.*")


def both_sides(items: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """truth() and extracted() in one table, as matched_sides() takes them, from one reading of items. Columns named in carry are the
    items' own, null on records."""
    box = ("x0", "y0", "x1", "y1")
    own = lambda side: [(F.col(c) if side == 0 else F.when(F.lit(False), F.col(c))).alias(c) for c in carry]
    side = lambda side, pos, kind, optional, src: F.struct(F.lit(side).alias("side"), src(pos).alias("pos"), src("value").alias("value"), src("label").alias("label"), src(kind).alias("class"), optional.alias("is_optional"), *[src(b).alias(b) for b in box], *own(side))
    theirs = [F.when(r.isNotNull(), side(1, "record_index", "class", F.lit(False), lambda n, r=r: r[n])) for r in _extracts()]
    rows = F.explode(F.array(side(0, "record_index", "p_type", F.col("partkey") % 9 == 0, F.col), *theirs)).alias("r")
    return items.select("job_id", "page", rows).where("r is not null").select("job_id", "page", "r.*")


def _extracts() -> tuple[Column, Column]:
    """What an extractor might return for an item: a disturbed copy, and an extra row; either may be null."""
    k = F.col("partkey")
    shift = F.when(k % 5 == 0, 40.0).otherwise(0.0)
    index = F.col("record_index") * 2
    value = F.when(k % 7 == 0, F.concat(F.lit("-"), F.col("amount").cast("decimal(18,2)").cast("string"))).otherwise(F.col("value"))
    real = F.struct(
        index.alias("record_index"), value.alias("value"), F.col("label").alias("label"), F.when(k % 13 == 0, "Other").otherwise(F.col("p_type")).alias("class"),
        (F.col("x0") + shift).alias("x0"), F.col("y0").alias("y0"), (F.col("x1") + shift).alias("x1"), F.col("y1").alias("y1"),
    )
    extra = F.struct(
        (index + 1).alias("record_index"), F.lit("1").alias("value"), F.lit("Extra").alias("label"), F.lit("Extra").alias("class"),
        F.lit(900.0).alias("x0"), F.lit(900.0).alias("y0"), F.lit(960.0).alias("x1"), F.lit(915.0).alias("y1"),
    )
    return F.when(k % 11 != 0, real), F.when(k % 17 == 0, extra)


#: Items of a page that meet all its records in one join; pages with more go by keys.
MOST_BY_PAGE = 256


def match_candidates(gt: DataFrame, ext: DataFrame, iou: float = 0.5, most: int = MOST_BY_PAGE) -> DataFrame:
    """All pairs on one page of one filing that can match, with a score.

    On pages of at most ``most`` items each item meets all records of its page: one join, each side sent once, and at most ``most``
    comparisons a record. Pages with more items, if there are any, go by three keyed joins.
    """
    gt = gt.withColumns({"gt_num": accounting_number(F.col("gt_value")), "_gl": F.lower(strip(F.col("gt_label")))})
    ext = ext.withColumns({"num": accounting_number(F.col("value")), "_el": F.lower(strip(F.col("label")))})
    facts = {
        "iou": bbox_iou("g", ""),
        "value_eq": same_value(F.col("gt_value"), F.col("value"), F.col("gt_num"), F.col("num")),
        "label_eq": F.coalesce(F.col("_gl") == F.col("_el"), F.lit(False)),
    }
    columns = [*[c for c in gt.columns if c != "_gl"], *[c for c in ext.columns if c not in ("_el", "job_id", "page")], *facts]
    page = ["job_id", "page"]
    large = stored(gt.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*page))
    some = not large.isEmpty()
    small = gt.join(large, page, "left_anti") if some else gt
    pairs = small.join(ext, page).withColumns(facts).where((F.col("iou") >= iou) | F.col("value_eq") | F.col("label_eq")).select(columns)
    if some:
        pairs = pairs.union(_by_keys(gt.join(large, page, "left_semi"), ext.join(large, page, "left_semi"), facts, iou).select(columns))
    return pairs.withColumn("score", F.col("iou") * 2 + F.col("value_eq").cast("int") * 2 + F.col("label_eq").cast("int"))


def _by_keys(gt: DataFrame, ext: DataFrame, facts: dict[str, Column], iou: float) -> DataFrame:
    """Pairs from three keyed joins, of amounts (or texts) in neighbouring buckets, of labels, and of boxes in a grid cell; each pair
    comes from the first that finds it, so nothing is made distinct afterwards.
    """
    # two buckets are as wide as the tolerance, so equal amounts are in the same or the next one
    at = lambda number, text, by: F.when(number.isNull(), F.concat(F.lit("t"), F.coalesce(F.lower(strip(text)), F.lit("")), text.isNull().cast("string"))).otherwise(F.concat(F.lit("n"), (F.floor(number * 500).cast("double") + by).cast("string")))
    mine = F.explode(F.array_distinct(F.array(*[at(F.col("gt_num"), F.col("gt_value"), k) for k in (-1, 0, 1)])))
    by_value = gt.withColumn("_key", mine).join(ext.withColumn("_key", at(F.col("num"), F.col("value"), 0)), ["job_id", "page", "_key"]).withColumns(facts).where("value_eq")
    by_label = gt.withColumn("_key", F.col("_gl")).join(ext.withColumn("_key", F.col("_el")), ["job_id", "page", "_key"]).withColumns(facts).where("not value_eq")
    cells = lambda p: F.explode(F.flatten(F.transform(_steps(p + "x0", p + "x1"), lambda i: F.transform(_steps(p + "y0", p + "y1"), lambda j: F.struct(i.alias("i"), j.alias("j"))))))
    one = (F.col("_cell.i") == _cell(F.greatest("gx0", "x0"))) & (F.col("_cell.j") == _cell(F.greatest("gy0", "y0")))  # of the cells that two boxes share, the one where their overlap begins
    by_box = gt.withColumn("_cell", cells("g")).join(ext.withColumn("_cell", cells("")), ["job_id", "page", "_cell"]).where(one).withColumns(facts)
    by_box = by_box.where((F.col("iou") >= iou) & ~F.col("value_eq") & ~F.col("label_eq"))
    return by_value.drop("_key").unionByName(by_label.drop("_key")).unionByName(by_box.drop("_cell"))


#: Side of a grid cell in thousandths of a page.
CELL = 125


def _cell(c: Column) -> Column:
    return F.floor(c / CELL).cast("int")


def _steps(low: str, high: str) -> Column:
    """Cells that a box covers one way; none where it is empty or missing."""
    return F.when(F.col(high) > F.col(low), F.sequence(_cell(F.col(low)), _cell(F.col(high)))).otherwise(F.array().cast("array<int>"))


def greedy_match(gt: DataFrame, ext: DataFrame, iou: float = 0.5) -> DataFrame:
    """(job_id, page, item_pos, record_index): items in order take their best unused record, on pages of any size."""
    return matched_pages(gt, ext, iou).where("is_match").select("job_id", "page", "item_pos", "record_index")


def _status(value_eq: Column, class_: Column, gt_class: Column, iou: Column, least: float) -> Column:
    class_eq = F.coalesce(F.lower(strip(class_)) == F.lower(strip(gt_class)), F.lit(False))
    return F.when(~value_eq, "value_mismatch").when(~class_eq, "classification_mismatch").when(iou < least, "localization_error").otherwise("exact_match")


def match_status(gt: DataFrame, ext: DataFrame, iou: float = 0.5) -> DataFrame:
    """Every item and record once, as matched_pages() has them, with the status."""
    return _with_status(matched_pages(gt, ext, iou), iou)


def match_status_of(sides: DataFrame, iou: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """match_status() of both_sides()."""
    return _with_status(matched_sides(sides, iou, carry), iou)


def _with_status(matched: DataFrame, iou: float) -> DataFrame:
    found = F.when(F.col("is_match"), _status(F.col("value_eq"), F.col("class"), F.col("gt_class"), F.col("iou"), iou))
    return matched.withColumn("status", found.when(F.col("record_index").isNull(), "missed_item").otherwise("spurious_item"))


def failure_pattern(diffs: DataFrame) -> DataFrame:
    a, b = F.col("gt_num"), F.col("num")
    flipped = (a * b < 0) & (F.abs(F.abs(a) - F.abs(b)) <= F.greatest(F.abs(a), F.abs(b)) * 1e-3)
    s = F.col("status")
    pattern = (
        F.when(s == "exact_match", "none")
        .when(s == "missed_item", F.when(F.col("is_optional"), "none").otherwise("missing_item"))
        .when(s == "spurious_item", "spurious_item")
        .when(s == "classification_mismatch", "unrecognized_label")
        .when(s == "localization_error", "merged_cell_misalignment")
        .when(F.coalesce(flipped, F.lit(False)), "sign_mismatch")
        .otherwise("multi_column_bleed")
    )
    return diffs.withColumn("pattern", pattern)


DIFF = ["job_id", "page", "item_pos", "record_index", "gt_num", "num", "status", "is_optional", "iou"]


def missed_items(gt: DataFrame, matches: DataFrame) -> DataFrame:
    return gt.join(matches, ["job_id", "page", "item_pos"], "left_anti")


def spurious_items(ext: DataFrame, matches: DataFrame) -> DataFrame:
    return ext.join(matches, ["job_id", "page", "record_index"], "left_anti")


def unmatched(sides: DataFrame, side: int, iou: float = 0.5) -> DataFrame:
    """Rows of matched_sides() that found no partner: missed items of side 0, spurious records of side 1. The matching names them
    itself, so neither side is read again."""
    return matched_sides(sides, iou).where(F.col("record_index" if side == 0 else "item_pos").isNull())


def large_pages(gt: DataFrame, ext: DataFrame, least: int) -> DataFrame:
    """(job_id, page, n): pages of more than least rows, each the work of one task in matched_pages()."""
    sides = gt.select("job_id", "page").union(ext.select("job_id", "page"))
    return sides.groupBy("job_id", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)


def item_diffs(gt: DataFrame, ext: DataFrame, iou: float = 0.5) -> DataFrame:
    """Matched, missed and spurious items with status and failure pattern: one exchange, by page."""
    return _diffs(match_status(gt, ext, iou))


def item_diffs_of(sides: DataFrame, iou: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """item_diffs() of both_sides(), from one reading, with the columns that it carries."""
    return _diffs(match_status_of(sides, iou, carry), carry)


def _diffs(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    amount = lambda c: F.when(F.col("is_match"), F.col(c)).alias(c)
    return failure_pattern(rows.select(*[amount(c) if c in ("gt_num", "num") else c for c in DIFF], *carry)).select(*DIFF, "pattern", *carry)


LEAST_ACCURACY, MOST_FLAGGED = 90, 15


def filing_metrics(diffs: DataFrame, runs: DataFrame, scored: DataFrame | None = None, filings: DataFrame | None = None) -> DataFrame:
    """One row for each run (job_id, success, cells); a run without diffs has nothing to find. Where filings (job_id) are given,
    runs of others are left out.

    scored (job_id, score) gives the share of records that people must see; without it diffs carry the score of each item, so
    that items are read once.
    """
    if filings is not None:
        runs = runs.join(filings.select("job_id").distinct(), "job_id", "left_semi")
    s = F.col("status")
    per = diffs.groupBy("job_id").agg(
        F.count_if(s == "exact_match").alias("tp"),
        F.count_if(s == "spurious_item").alias("fp"),
        F.count_if((s == "missed_item") & ~F.col("is_optional")).alias("fn"),
        F.count_if(s != "spurious_item").alias("gt_total"),
        F.count_if((s != "spurious_item") & ~F.col("is_optional")).alias("gt_required"),
        F.count_if(s.isin("value_mismatch", "localization_error", "spurious_item") | ((s == "missed_item") & ~F.col("is_optional"))).alias("extraction_errors"),
        F.count_if(s == "classification_mismatch").alias("classification_errors"),
        *([F.count_if(F.col("item_pos").isNotNull()).alias("extracted"), F.count_if(F.col("item_pos").isNotNull() & (F.col("score") < 0.95)).alias("not_auto")] if scored is None else []),
    )
    out = runs.select("job_id", "success", "cells").join(per, "job_id", "left")
    if scored is not None:
        out = out.join(scored.groupBy("job_id").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("score") < 0.95).alias("not_auto")), "job_id", "left")
    out = out.fillna(0, [c for c in out.columns if c not in ("job_id", "success", "cells")])
    whole = F.when(F.col("gt_required") > 0, F.col("gt_required")).otherwise(F.col("gt_total"))
    out = out.withColumns(
        {
            "generation_errors": (~F.col("success") | (F.col("cells") == 0)).cast("int"),
            "accuracy": F.when(whole > 0, percent(F.col("tp"), whole)).otherwise(100.0),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "not_auto_percent": percent(F.col("not_auto"), F.col("extracted")),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", F.when(p + r > 0, F.bround(2 * p * r / (p + r), 4)).otherwise(0.0))
    failed = (F.col("not_auto_percent") > MOST_FLAGGED) | ~F.col("success")
    return out.withColumns({"is_failed": failed, "on_target": F.col("accuracy") >= LEAST_ACCURACY}).drop("success", "cells")


def corpus_metrics(filings: DataFrame) -> DataFrame:
    """One row: macro means of the rounded figures, micro figures from totals. Two-phase sums."""
    sums = ("tp", "fp", "fn", "gt_total", "extracted", "not_auto", "extraction_errors", "classification_errors", "generation_errors")
    t = filings.agg(
        F.count(F.lit(1)).alias("filings"), F.count_if("is_failed").alias("failed_filings"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.coalesce(F.bround(F.avg(c), 4), F.lit(0.0)).alias("macro_" + c) for c in ("precision", "recall", "f1")],
    )
    t = t.withColumns(
        {
            "successful_filings": F.col("filings") - F.col("failed_filings"),
            "micro_precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "micro_recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "accuracy": F.when(F.col("gt_total") > 0, percent(F.col("tp"), F.col("gt_total"))).otherwise(100.0),
            "review_percent": percent(F.col("not_auto"), F.col("extracted")),
        }
    )
    p, r = F.col("micro_precision"), F.col("micro_recall")
    t = t.withColumn("micro_f1", F.when(p + r > 0, F.bround(2 * p * r / (p + r), 4)).otherwise(0.0))
    return t.withColumn("on_target", F.col("accuracy") >= LEAST_ACCURACY)


def failure_pattern_counts(diffs: DataFrame) -> DataFrame:
    """Every known pattern with its count, zero where it is absent."""
    known = diffs.sparkSession.createDataFrame([(p,) for p in words.FAILURE_PATTERNS], "pattern string")
    return known.join(diffs.groupBy("pattern").count(), "pattern", "left").select("pattern", F.coalesce("count", F.lit(0)).alias("n"))
