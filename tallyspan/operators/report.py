"""Figures around an evaluation: runs and their budget, the gate, the disclosure, corpus checks and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.exprs import accounting_number, is_blank, percent

# Fixed values of an evaluation.
MOST_SECONDS, LEAST_ACCURACY, LEAST_FILINGS = 300, 90, 5
STAGES = ("extraction", "classification", "generation")


def failing_stage(runs: DataFrame) -> DataFrame:
    """+ failed_at: the first stage of a failed run without time."""
    at = F.coalesce(*[F.when(F.col(s) == 0, F.lit(s)) for s in STAGES], F.lit("unknown"))
    return runs.withColumn("failed_at", F.when(~F.col("success"), at))


def runtime_metrics(runs: DataFrame) -> DataFrame:
    """One row: seconds in all and a run, whether every run kept the budget, runs that succeeded."""
    seconds = sum((F.col(s) for s in STAGES[1:]), F.col(STAGES[0]))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if("success").alias("succeeded"), F.sum(seconds).cast("double").alias("total_seconds"),
        F.bround(F.sum(seconds) / F.count(F.lit(1)), 4).alias("mean_seconds"), F.coalesce(F.bool_and(seconds <= MOST_SECONDS), F.lit(True)).alias("within_budget"),
    )


def strict_gate(corpus: DataFrame, runs: DataFrame) -> DataFrame:
    """(passed, passed_strict): no run failed; strictly, accuracy reaches its target too and no filing fell short in
    extraction. Both inputs are one row or aggregate to one."""
    failed = runs.agg(F.count_if(~F.col("success")).alias("failed")).withColumn("_k", F.lit(1))
    out = corpus.withColumn("_k", F.lit(1)).join(failed, "_k")
    ok = F.col("failed") == 0
    return out.select(ok.alias("passed"), (ok & (F.col("accuracy") >= LEAST_ACCURACY) & (F.col("failed_filings") == 0)).alias("passed_strict"))


def governance_disclosure(scored: DataFrame, filings: DataFrame) -> DataFrame:
    """One sentence that stands beside any accuracy: corpus size, items, and how many people must review."""
    items = scored.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("score") < 0.95).alias("reviewed")).withColumn("_k", F.lit(1))
    n = filings.agg(F.count(F.lit(1)).alias("filings")).withColumn("_k", F.lit(1))
    share = F.format_string("%.2f", percent(F.col("reviewed"), F.col("items")))
    words = F.concat(F.lit("Measured on "), F.col("filings").cast("string"), F.lit(" filings with "), F.col("items").cast("string"), F.lit(" items; "), F.col("reviewed").cast("string"), F.lit(" ("), share, F.lit("%) need review."))
    return n.join(items, "_k").select(words.alias("disclosure"))


def filing_filter(gt: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the named filings, names that gt does not know)."""
    return gt.join(filings.select("job_id").distinct(), "job_id", "left_semi"), filings.join(gt.select("job_id").distinct(), "job_id", "left_anti")


def corpus_validation(items: DataFrame, filings: DataFrame, manifest: DataFrame) -> DataFrame:
    """(job_id, rule, n): rules that a corpus breaks; valid where no row is left.

    items: job_id, page, value, label, normalized_label, x0..y1; filings: job_id, page_count, actual_pages;
    manifest: job_id. An item that breaks the schema (a blank text, no page from 1, a box without extent or beyond
    the page) is counted for that alone.
    """
    c = F.col
    blank = is_blank(c("value")) | is_blank(c("label")) | is_blank(c("normalized_label"))
    inside = (c("x0") >= 0) & (c("y0") >= 0) & (c("x1") <= 1000) & (c("y1") <= 1000)
    breach = blank | ~F.coalesce((c("page") >= 1) & (c("x0") < c("x1")) & (c("y0") < c("y1")) & inside, F.lit(False))
    items = items.withColumn("_breach", breach)
    joined = items.join(filings.select("job_id", "page_count"), "job_id")
    found = [
        manifest.join(filings, "job_id", "left_anti").select("job_id", F.lit("folder_missing").alias("rule")),
        filings.where(c("page_count") != c("actual_pages")).select("job_id", F.lit("page_count_differs").alias("rule")),
        joined.select("job_id", F.explode(F.when(c("_breach"), F.array(F.lit("schema_breach"))).otherwise(F.array_compact(F.array(F.when(c("page") > c("page_count"), F.lit("page_beyond_end")), F.when(accounting_number(c("value")).isNull(), F.lit("value_not_numeric")))))).alias("rule")),
        filings.agg(F.count(F.lit(1)).alias("n")).where(c("n") < LEAST_FILINGS).select(F.lit(None).cast("string").alias("job_id"), F.lit("too_few_filings").alias("rule")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("job_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def report_tables(corpus: DataFrame, filings: DataFrame, diffs: DataFrame, patterns: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report by name; headline figures in long form, failures worst first."""
    names = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "micro_precision", "micro_recall", "micro_f1")
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("figure")) for n in names]))
    layers = F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n + "_errors").alias("errors")) for n in ("extraction", "classification", "generation")]))
    return {
        "headline": corpus.select(long.alias("x")).select("x.*"),
        "layers": corpus.select(layers.alias("x")).select("x.*"),
        "failed_filings": filings.where("is_failed or not on_target").orderBy("accuracy", "job_id"),
        "patterns": patterns,
        "filings": filings.orderBy("job_id"),
        "items": diffs,
    }
