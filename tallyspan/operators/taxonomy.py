"""Classification of labels and their match to a controlled taxonomy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspan.functions import words
from tallyspan.functions.exprs import canonical_label, contains_any, is_blank, iso_utc, strip
from tallyspan.operators.numbering import numbered


def classification_candidates(scored: DataFrame, candidates_only: bool = True) -> DataFrame:
    keep = (F.col("status") != "extraction_error") & F.col("band").isin("auto_accepted", "needs_review")
    return scored.where(F.col("is_candidate") & keep if candidates_only else keep)


def dictionary_classifier(labels: DataFrame) -> DataFrame:
    """+ class, confidence: the first dictionary key in the stripped lower label, else the stripped label."""
    low = F.lower(strip(F.col("label")))
    hit = F.lit(None).cast("string")
    for key, name in reversed(words.DICTIONARY):
        hit = F.when(low.contains(key), name).otherwise(hit)
    return labels.withColumns({"class": F.coalesce(hit, strip(F.col("label"))), "confidence": F.lit(0.98)})


ANSWER = "label string, confidence double, error string"


def batch_classifier(answer: Callable | None = None, factory: Callable[[], Callable] | None = None) -> Callable[[Column], Column]:
    """A classifier for classify() from a function of a batch, or from a factory of one, which each task calls once, as to load
    a model. The function gets a pandas Series of labels and returns a frame of label and confidence; values, pages and
    boxes never reach it. Whatever a batch or the factory raises, its answers are null and name the error."""
    import pandas as pd

    def run(labels):
        ask = answer
        for batch in labels:
            try:
                ask = ask or factory()
                out = ask(batch)
                yield pd.DataFrame({"label": list(out["label"]), "confidence": [None if c is None else float(c) for c in out["confidence"]], "error": [None] * len(batch)})
            except Exception as e:
                yield pd.DataFrame({"label": [None] * len(batch), "confidence": [None] * len(batch), "error": [f"{type(e).__name__}: {e}"] * len(batch)}).astype({"label": object, "confidence": float})

    run.__annotations__ = {"labels": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, ANSWER)


def dictionary_answer(label: Column) -> Column:
    """The dictionary as a classifier for classify(), in built-in expressions."""
    low, hit = F.lower(strip(label)), F.lit(None).cast("string")
    for key, name in reversed(words.DICTIONARY):
        hit = F.when(low.contains(key), name).otherwise(hit)
    return F.struct(F.coalesce(hit, strip(label)).alias("label"), F.lit(0.98).alias("confidence"), F.lit(None).cast("string").alias("error"))


def classify(items: DataFrame, classifier: Callable[[Column], Column], most: int = 2000) -> DataFrame:
    """(job_id, record_index, label, resp_label, resp_confidence, is_error, error_detail): any classifier's answers to items.

    The classifier is a function of a column that gives (label, confidence, error), built in or from batch_classifier(). It sees
    each distinct label once and the label alone, cut at most characters. An answer without a label or with a
    confidence beyond 0 to 1 is an error.
    """
    asked = items.select(_payload(most).alias("_asked")).distinct()
    got = asked.withColumn("_a", classifier(F.col("_asked")))
    out = items.select("job_id", "record_index", "label", _payload(most).alias("_asked")).join(got, "_asked", "left")
    ok = ~is_blank(F.col("_a.label")) & F.coalesce(F.col("_a.confidence").between(0, 1), F.lit(False))
    return out.select("job_id", "record_index", "label", F.when(ok, F.col("_a.label")).alias("resp_label"), F.when(ok, F.col("_a.confidence")).alias("resp_confidence"), (~ok).alias("is_error"), F.when(~ok, F.coalesce("_a.error", F.lit("answer is not valid"))).alias("error_detail"))


#: Of classifiers in built-in expressions, which cost less than a join to their answers.
dictionary_answer.built_in = True


def with_answers(scored: DataFrame, classifier: Callable[[Column], Column], candidates_only: bool = True) -> DataFrame:
    """scored + resp_label, is_error_resp, bad_answer: classify() of its classification_candidates(), null elsewhere.

    A classifier marked built_in answers in place; of any other, each distinct label is asked once and its answer joined."""
    keep = (F.col("status") != "extraction_error") & F.col("band").isin("auto_accepted", "needs_review")
    keep = F.coalesce(F.col("is_candidate") & keep if candidates_only else keep, F.lit(False))
    rows = scored.withColumns({"_sent": keep, "_asked": F.when(keep, _payload(2000))})
    if getattr(classifier, "built_in", False):
        rows = rows.withColumn("_a", classifier(F.col("_asked")))
    else:
        rows = rows.join(rows.where("_asked is not null").select("_asked").distinct().withColumn("_a", classifier(F.col("_asked"))), "_asked", "left")
    ok = ~is_blank(F.col("_a.label")) & F.coalesce(F.col("_a.confidence").between(0, 1), F.lit(False))
    sent = F.col("_sent")
    answers = {"resp_label": F.when(sent & ok, F.col("_a.label")), "is_error_resp": F.when(sent, ~ok), "bad_answer": F.when(sent & ~ok, F.coalesce("_a.error", F.lit("answer is not valid")))}
    return rows.withColumns(answers).drop("_sent", "_asked", "_a")


def _payload(most: int) -> Column:
    return F.when(F.length("label") > most, F.concat(F.substring("label", 1, most), F.lit(" [TRUNCATED]"))).otherwise(F.col("label"))


def classifier_payload(items: DataFrame, most: int = 2000) -> DataFrame:
    return items.select("job_id", "record_index", _payload(most).alias("label"))


def classifier_response_check(raw: DataFrame) -> DataFrame:
    """(…, label, confidence, is_error, extra_keys) of raw JSON answers."""
    got = F.from_json("raw", "label string, confidence double")
    keys = F.json_object_keys("raw")
    ok = keys.isNotNull() & ~is_blank(got["label"]) & F.coalesce(got["confidence"].between(0, 1), F.lit(False))
    extra = F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(F.lit("label"), F.lit("confidence"))))
    return raw.select("job_id", "record_index", F.when(ok, got["label"]).alias("label"), F.when(ok, got["confidence"]).alias("confidence"), (~ok).alias("is_error"), F.array_join(extra, ",").alias("extra_keys"))


def classifier_responses(items: DataFrame, *carry: Column) -> DataFrame:
    """Answers of a stand-in classifier over items: by suppkey, right, shouted, by name, or an error. carry: more columns of items."""
    label, wrong = stand_in_answer()
    return items.select("job_id", "record_index", *carry, label.alias("resp_label"), F.when(~wrong, 0.9).alias("resp_confidence"), wrong.alias("is_error"))


def stand_in_answer() -> tuple[Column, Column]:
    """Label and error of the stand-in classifier's answer to an item."""
    k = F.col("suppkey") % 4
    return F.when(k == 0, F.col("p_type")).when(k == 1, F.upper("p_type")).when(k == 2, F.col("p_name")), k == 3


def seed_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(words.SEED_TAXONOMY)), "position int, entry string")


def taxonomy_scan(spark: SparkSession, path: str | None) -> DataFrame:
    """(position, entry) of a JSON list of texts; the seed where there is no file or it holds anything else."""
    from pyspark.errors import AnalysisException

    if path is None:
        return seed_taxonomy(spark)
    try:
        lines = spark.read.text(path, wholetext=True)
    except AnalysisException:  # the path does not exist
        return seed_taxonomy(spark)
    v = F.try_parse_json("value")
    # an array of anything else than texts does not come back the same from its texts
    parts = F.try_variant_get(v, "$", "array<variant>")
    plain = F.coalesce(F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    rows = lines.where(plain & parts.isNotNull()).select(F.posexplode(F.try_variant_get(v, "$", "array<string>")).alias("position", "entry"))
    valid = lines.agg(F.coalesce(F.bool_or(plain), F.lit(False)).alias("ok"))
    seed = seed_taxonomy(spark).join(F.broadcast(valid.where("not ok")))  # one row or none
    return rows.union(seed.select("position", "entry"))


def classification_fallback(answered: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """answered (…, label, resp_label, resp_confidence, is_error): an error whose raw label has the canonical form of an entry
    takes that entry with confidence 0.95 and is none any more. The entries are the seed's where none are given."""
    entries = seed_taxonomy(answered.sparkSession) if taxonomy is None else taxonomy
    out = canonical_match(answered, entries, "label", "_fallback")
    saved = F.col("is_error") & F.col("_fallback").isNotNull()
    changed = {
        "resp_label": F.when(saved, F.col("_fallback")).otherwise(F.col("resp_label")),
        "resp_confidence": F.when(saved, 0.95).otherwise(F.col("resp_confidence")),
        "is_error": F.col("is_error") & ~saved,
    }
    return out.withColumns(changed).drop("_fallback")


def classification_counts(scored: DataFrame, answered: DataFrame) -> DataFrame:
    """(job_id, dispatched, success, errors, skipped) by job: what was asked, and the records never sent."""
    records = scored.groupBy("job_id").agg(F.count(F.lit(1)).alias("records"))
    per = answered.groupBy("job_id").agg(F.count(F.lit(1)).alias("dispatched"), F.count_if(~F.col("is_error")).alias("success"), F.count_if("is_error").alias("errors"))
    out = records.join(per, "job_id", "left").fillna(0, ["dispatched", "success", "errors"])
    return out.select("job_id", "dispatched", "success", "errors", (F.col("records") - F.col("dispatched")).alias("skipped"))


def by_canonical(taxonomy: DataFrame) -> DataFrame:
    """(canon, canon_entry): the first entry of each canonical form; the blank form matches nothing."""
    t = taxonomy.withColumn("canon", canonical_label(F.col("entry"))).where("canon <> ''")
    return t.groupBy("canon").agg(F.min_by("entry", "position").alias("canon_entry"))


def exact_match(items: DataFrame, taxonomy: DataFrame, column: str) -> DataFrame:
    """+ matched: the entry equal to column, else null. A taxonomy row may come once only."""
    one = taxonomy.groupBy("entry").agg(F.min("position").alias("_p")).select(F.col("entry").alias("matched"))
    return items.join(one, F.col(column) == F.col("matched"), "left")


def canonical_match(items: DataFrame, taxonomy: DataFrame, column: str, name: str = "canon_entry") -> DataFrame:
    t = by_canonical(taxonomy).withColumnRenamed("canon_entry", name)
    return items.withColumn("_c", canonical_label(F.col(column))).join(t, F.col("_c") == F.col("canon"), "left").drop("_c", "canon")


def normalize_records(scored: DataFrame, responses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """scored + normalized_label, taxonomy_status: answer exact, answer canonical, label canonical, else pending."""
    answers = responses.select("job_id", "record_index", "resp_label", "is_error_resp")
    return normalize_answered(scored.join(answers, ["job_id", "record_index"], "left"), taxonomy)


def normalize_answered(answered: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """normalize_records() of rows that hold their answer already (resp_label, is_error_resp), which need no join to it."""
    kept = [c for c in answered.columns if c not in ("resp_label", "is_error_resp")]
    out = exact_match(answered, taxonomy, "resp_label")
    out = canonical_match(out, taxonomy, "resp_label", "by_answer")
    out = canonical_match(out, taxonomy, "label", "by_label")
    answered = F.coalesce(~F.col("is_error_resp"), F.lit(False))
    fit = F.col("band").isin("auto_accepted", "needs_review") & (F.col("status") == "ok")
    name = F.when(answered, F.coalesce("matched", "by_answer", "by_label", "resp_label")).when(fit, F.col("by_label"))
    hit = F.when(answered, F.coalesce("matched", "by_answer", "by_label")).when(fit, F.col("by_label"))
    return out.select(*kept, name.alias("normalized_label"), F.when(hit.isNotNull(), "matched").otherwise("pending").alias("taxonomy_status"))


def metric_candidates(items: DataFrame, metric: str = "Adjusted EBITDA") -> DataFrame:
    """+ is_target: does the item belong to the metric's bridge?"""
    title = F.lower(F.coalesce("table_name", F.lit("")))
    raw, norm = F.lower("label"), F.lower(F.coalesce("normalized_label", F.lit("")))
    either = lambda ws: contains_any(raw, ws) | contains_any(norm, ws)
    unrelated = contains_any(title, words.UNRELATED_TITLES)
    target = (
        F.when(title.contains(metric.lower()) | title.contains("reconciliation") | title.contains("non-gaap"), True)
        .when(either(words.METRIC_WORDS), ~unrelated | either(words.STRONG_WORDS))
        .otherwise(~unrelated & ((title == "") | title.startswith("table")))
    )
    return items.withColumn("is_target", target)


def decision_log_build(responses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row an answer; only an exact match confirms.

    responses may bring label (what was sent), asked_at and error_detail; those it lacks are null in the log.
    """
    has = lambda c: F.col(c) if c in responses.columns else F.lit(None).cast("string")
    out = exact_match(responses, taxonomy, "resp_label")
    err = F.col("is_error")
    state = F.when(err, "classification_error").when(F.col("matched").isNotNull(), "confirmed").otherwise("pending_confirmation")
    return out.select(
        "job_id", "record_index", "resp_label", state.alias("resulting_state"), F.when(~err & F.col("matched").isNotNull(), "matched").otherwise("pending").alias("taxonomy_status"), has("label").alias("payload"),
        F.when(~err, F.to_json(F.struct(F.col("resp_label").alias("label"), F.col("resp_confidence").alias("confidence")))).alias("raw_response"),
        (iso_utc(F.col("asked_at")) if "asked_at" in responses.columns else F.lit(None).cast("string")).alias("timestamp"), F.when(err, F.coalesce(has("error_detail"), F.lit("no answer"))).alias("error_detail"),
    )


def taxonomy_append(taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """taxonomy with new terms at the end, once each, in order. New terms are numbered by ranges, so terms of one prefix spread as
    others do."""
    new = terms.where(F.col("term").isNotNull()).select(F.col("term").alias("entry")).distinct().join(taxonomy.select("entry"), "entry", "left_anti")
    last = taxonomy.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("last"))
    rows = numbered(new.withColumn("_all", F.lit(0)), ["_all"], ["entry"], "at").crossJoin(F.broadcast(last))
    return taxonomy.select("position", "entry").union(rows.select((F.col("last") + F.col("at")).cast("int").alias("position"), "entry"))


def call_rate_audit(log: DataFrame, per_minute: int = 30, per_day: int = 1000) -> DataFrame:
    """(client, seq, calls_60s, over, calls_24h, over_day): calls of a client in the minute and the day up to each call."""
    w = Window.partitionBy("client").orderBy(F.unix_micros(F.col("ts").cast("timestamp")))
    n = F.count(F.lit(1))
    out = log.withColumns({"calls_60s": n.over(w.rangeBetween(-60_000_000, 0)), "calls_24h": n.over(w.rangeBetween(-86_400_000_000 + 1, 0))})
    return out.select("client", "seq", "calls_60s", (F.col("calls_60s") > per_minute).alias("over"), "calls_24h", (F.col("calls_24h") > per_day).alias("over_day"))
