"""Inputs are read once, however many steps use them, and streams call Python by bucket: what grows with the input grows once."""

import pytest
from pyspark.sql import functions as F
from test_filing import world

from tallyspan.operators import drift, evaluate, filing, taxonomy
from tallyspan.plans import queries, stream_queries
from tallyspan.streaming import jobs

SF = "/root/testdata/sf0.001"


def readings(df, column):
    """How often the plan reads the table that has this column."""
    return sum("Relation [" in line and column in line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_drift_state_is_by_bucket(spark, tmp_path):
    rows = [(f"e{k}", m, y, f"l{(k * 7 + y * (k % 3)) % 5}") for k in range(300) for m in ("a", None) for y in range(6)]
    sets = drift.locked_labels(spark.createDataFrame(rows, "entity string, metric string, eval_seq int, normalized_label string"))
    source, seen = str(tmp_path / "in"), []
    for lo in (0, 2, 4):  # three starts of one query
        sets.where(f"eval_seq in ({lo}, {lo + 1})").coalesce(1).write.mode("append").parquet(source)
        out = jobs.drift(spark.readStream.schema(sets.schema).parquet(source), buckets=4)
        q = out.writeStream.foreachBatch(lambda b, n, t=str(tmp_path / f"out{lo}"): b.write.mode("overwrite").parquet(f"{t}/{n}")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert 1 <= q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
        seen += spark.read.parquet(str(tmp_path / f"out{lo}/*")).collect()
    want = drift.drift_nodes(drift.drift_compare(sets)).select("entity", "metric", "eval_seq", "node", "changed").collect()
    assert sorted(map(str, seen)) == sorted(map(str, want)) and len(seen) == 3600


def test_filings_read_their_cells_once(spark, tmp_path):
    cells, dims, terms = world(spark)
    cells.write.parquet(str(tmp_path / "cells"))
    rows = filing.filing_rows(spark.read.parquet(str(tmp_path / "cells")), dims, terms)
    assert readings(rows, "is_row_header") == 1
    ask = taxonomy.batch_classifier(lambda labels: __import__("pandas").DataFrame({"label": ["Interest Expense"] * len(labels), "confidence": 0.9}))
    plain = lambda c: taxonomy.dictionary_answer(c)  # noqa: E731  without the mark, so by distinct labels
    both = [sorted(map(str, filing.filing_rows(cells, dims, terms, f).collect())) for f in (taxonomy.dictionary_answer, plain)]
    assert both[0] == both[1]
    (one,) = filing.filing_rows(cells, dims, terms, ask).where("outcome = 'item'").collect()
    assert one.normalized_label == "Interest Expense" and one.table_name == "Reconciliation of EBITDA"


@pytest.mark.parametrize(("name", "most"), [("spurious_items", 1), ("missed_items", 1), ("batch_job_summary", 0), ("manual_overrides", 0), ("report_metadata", 1)])
def test_line_items_are_read_once(spark, name, most):
    assert readings(stream_queries.QUERIES[name](spark, SF), "l_linenumber") <= most


def test_unmatched_equals_the_joins(spark):
    rows = stream_queries.items(spark, SF)
    gt, ext = evaluate.truth(rows), evaluate.extracted(rows)
    matches = evaluate.greedy_match(gt, ext)
    both = evaluate.both_sides(rows)
    missed = evaluate.missed_items(gt, matches).select("job_id", "page", F.col("item_pos"))
    spurious = evaluate.spurious_items(ext, matches).select("job_id", "page", "record_index")
    assert sorted(evaluate.unmatched(both, 0).select("job_id", "page", "item_pos").collect()) == sorted(missed.collect())
    assert sorted(evaluate.unmatched(both, 1).select("job_id", "page", "record_index").collect()) == sorted(spurious.collect())


def test_documents_are_shuffled_once(spark):
    docs = queries._gt_docs(spark, SF)
    assert docs.count() == docs.select("folder").distinct().count() > 0
    docs.collect()
    assert "hashpartitioning(suppkey" in (plan := docs._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(folder" not in plan


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_are_matched_where_the_items_lie(spark):
    """Items are dealt by job once, before their columns are made; matching, scores and sums of a job read them there."""
    for name in ("greedy_match", "match_status", "item_diffs", "missed_items"):
        df = queries.QUERIES[name](spark, SF)
        assert exchanges(df) == 1 and readings(df, "l_orderkey") == 1, name
    for name in ("filing_metrics", "corpus_metrics", "report_failed_filings", "report_layers"):
        df = stream_queries.QUERIES[name](spark, SF)
        assert exchanges(df) <= 3 and readings(df, "l_orderkey") == 1, name  # the others are of sums by job and of runs


def test_carried_scores_count_as_scored_records_do(spark):
    rows, runs = queries.scored(spark, SF), queries._runs(spark, SF)
    apart = evaluate.filing_metrics(evaluate.item_diffs(evaluate.truth(rows), evaluate.extracted(rows)), runs, rows.select("job_id", "score"))
    got, want = (sorted(map(str, df.select(sorted(df.columns)).collect())) for df in (queries.QUERIES["filing_metrics"](spark, SF), apart))
    assert got == want and len(got) > 100


def test_ground_truth_files_are_packed(spark):
    files = queries.QUERIES["gt_corpus_filings"](spark, SF).inputFiles()
    assert sum(f.endswith(".json.gz") for f in files) > 5 and not any(f.endswith(".json") for f in files)
