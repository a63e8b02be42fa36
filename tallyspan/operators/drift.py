"""How a metric's component set changes from one evaluated filing of an entity to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.exprs import is_blank, strip

#: What one history belongs to.
KEYS = ("entity", "metric")


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("eval_seq")


def locked_labels(locked: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, eval_seq, labels) and year where locked has it: sorted distinct labels of each evaluated filing. eval_seq, the
    order of evaluation, need not be that of the years."""
    rows = locked.where(~is_blank(F.col("normalized_label")))
    year = [F.max("year").alias("year")] if "year" in locked.columns else []
    return rows.groupBy(*keys, "eval_seq").agg(F.array_sort(F.collect_set("normalized_label")).alias("labels"), *year)


def drift_compare(sets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """+ added, removed, unchanged, is_baseline, changed. The prior set is that of the filing before."""
    out = sets.withColumn("prior", F.lag("labels").over(_order(keys)))
    base = F.col("prior").isNull()
    out = out.withColumns(
        {
            "is_baseline": base,
            "added": F.when(base, F.array().cast("array<string>")).otherwise(F.array_except("labels", "prior")),
            "removed": F.when(base, F.array().cast("array<string>")).otherwise(F.array_except("prior", "labels")),
            "unchanged": F.when(base, F.col("labels")).otherwise(F.array_intersect("labels", "prior")),
        }
    )
    return out.withColumn("changed", base | (F.size("added") > 0) | (F.size("removed") > 0))


def drift_nodes(compared: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One node for each stretch of equal sets."""
    run = F.sum(F.col("changed").cast("int")).over(_order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return compared.withColumn("node", run.cast("int"))


def drift_edges(compared: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, eval_seq, from_node, to_node, kind, added, removed); a baseline has no edge."""
    nodes = drift_nodes(compared, keys).where("not is_baseline")
    before = F.col("node") - F.col("changed").cast("int")
    kind = F.when(F.col("changed"), "redefinition").otherwise("continuation")
    return nodes.select(*keys, "eval_seq", before.alias("from_node"), F.col("node").alias("to_node"), kind.alias("kind"), "added", "removed")


def drift_flags(compared: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, eval_seq, added, removed) of every set that differs from the one before."""
    return compared.where("not is_baseline and changed").select(*keys, "eval_seq", "added", "removed")


def drift_history(compared: DataFrame, entity: str | None = None, metric: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all histories or of one entity or metric. nodes (*KEYS, node, eval_seq, labels, filings): the set of a node, where it
    begins and how many filings share it."""
    for name, wanted in zip(KEYS, (entity, metric)):
        compared = compared if wanted is None else compared.where(F.col(name) == wanted)
    nodes = drift_nodes(compared).groupBy(*KEYS, "node").agg(F.min("eval_seq").alias("eval_seq"), F.min_by("labels", "eval_seq").alias("labels"), F.count(F.lit(1)).alias("filings"))
    return nodes, drift_edges(compared)


def label_change_rows(compared: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(*keys, eval_seq, label, change): one row for each label of the three sets."""

    def named(kind: str):
        return F.transform(F.col(kind), lambda x: F.struct(x.alias("label"), F.lit(kind).alias("change")))

    kinds = [named(k) for k in ("added", "removed", "unchanged")]
    return compared.select(*keys, "eval_seq", F.explode(F.concat(*kinds)).alias("x")).select(*keys, "eval_seq", "x.label", "x.change")


def drift_export(compared: DataFrame, entity: str | None = None, metric: str | None = None) -> DataFrame:
    """(entity, metric, eval_seq, node, kind, labels, added, removed): the history of each metric of an entity,
    of one entity or metric where they are given; kind is baseline, redefinition or continuation."""
    for name, wanted in zip(KEYS, (entity, metric)):
        compared = compared if wanted is None else compared.where(F.col(name) == wanted)
    kind = F.when(F.col("is_baseline"), "baseline").when(F.col("changed"), "redefinition").otherwise("continuation")
    return drift_nodes(compared).select(*KEYS, "eval_seq", "node", kind.alias("kind"), "labels", "added", "removed")


def drift_scope(jobs: DataFrame, given: DataFrame | None = None, metric: str = "Adjusted EBITDA") -> DataFrame:
    """(job_id, entity, year) read from the file name; with given (job_id, entity, metric, year) those go first where they are
    not null, and metric is the fourth column."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    year = F.regexp_extract("filename", r"((?:19|20)\d{2})", 1)
    out = jobs.select("job_id", F.split_part(stem, F.lit("_"), F.lit(1)).alias("entity"), F.coalesce(year.try_cast("int"), F.lit(2024)).alias("year"))
    if given is None:
        return out
    named = given.select("job_id", F.nullif(strip(F.col("entity")), F.lit("")).alias("_e"), F.nullif(strip(F.col("metric")), F.lit("")).alias("_m"), F.col("year").alias("_y"))
    out = out.join(named, "job_id", "left")
    return out.select("job_id", F.coalesce("_e", "entity").alias("entity"), F.coalesce("_y", "year").alias("year"), F.coalesce("_m", F.lit(metric)).alias("metric"))
