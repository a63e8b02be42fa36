"""Filings from cells: rows that fail go aside, a bad filing fails alone, late rows are dropped and counted."""

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import filing, taxonomy
from tallyspan.streaming import jobs

CELLS = """job_id string, source_file string, table_idx int, cell_idx int, text string, start_row string, start_col string, is_row_header boolean, is_col_header boolean, page_cell int, page_table int,
bbox_cell struct<x0:double,y0:double,x1:double,y1:double>, bbox_prov struct<x0:double,y0:double,x1:double,y1:double>, bbox_table struct<x0:double,y0:double,x1:double,y1:double>"""


def cells_of(spark, job, values, page=1):
    f, box = job + ".pdf", (10.0, 20.0, 30.0, 40.0)
    rows = [(job, f, 0, 0, "Reconciliation of EBITDA", "0", "0", True, True, page, None, None, None, None), (job, f, 0, 1, "2023", "0", "1", False, True, page, None, None, None, None)]
    for k, (value, row) in enumerate(values):
        rows += [(job, f, 0, 2 * k + 2, f"Interest expense {k}", row, "0", True, False, page, None, None, None, None), (job, f, 0, 2 * k + 3, value, row, "1", False, False, page, None, box, None, None)]
    return spark.createDataFrame(rows, CELLS)


def world(spark):
    cells = cells_of(spark, "good", [("1,000", "1"), (None, "2"), ("5", "x"), ("Total", "4")]).union(cells_of(spark, "dead", [(None, "1"), ("7", "-1")])).union(cells_of(spark, "blank", [("9", "1")], page=4))
    dims = spark.createDataFrame([(f, 1, 100.0, 200.0) for f in ("good.pdf", "dead.pdf", "blank.pdf")], "source_file string, page int, width double, height double")
    return cells, dims, spark.createDataFrame([(0, "Interest Expense")], "position int, entry string")


def test_every_failing_row_is_in_the_error_table(spark, tmp_path):
    cells, dims, terms = world(spark)
    items, errors = filing.write_filing_rows(filing.filing_rows(cells, dims, terms), str(tmp_path / "rows"))
    (r,) = items.collect()
    assert (r.job_id, r.label, r.value, r.page, r.x0, r.y1, r.table_name, r.is_candidate, r.normalized_label) == ("good", "Interest expense 0 / 2023", "1,000", 1, 100.0, 200.0, "Reconciliation of EBITDA", True, "Interest Expense")
    got = sorted((r.job_id, r.cell_idx, r.stage, r.reason, r.status, r.score) for r in errors.collect())
    assert got == [("blank", 3, "boxes", filing.NO_PAGE, "extraction_error", 0.0), *[(j, c, "cells", filing.NO_CELL, "extraction_error", 0.0) for j, c in (("dead", 3), ("dead", 5), ("good", 5), ("good", 7))]]

    def fails(batch):
        raise KeyError("model")

    rows = filing.filing_rows(cells, dims, terms, taxonomy.batch_classifier(fails))
    assert [(r.outcome, r.stage, r.reason) for r in rows.where("job_id = 'good' and cell_idx = 3").collect()] == [("error", "classification", "KeyError: 'model'")]


def test_one_bad_filing_fails_alone(spark, tmp_path):
    cells, dims, terms = world(spark)
    files = [("good", 10, "%PDF"), ("dead", 10, "%PDF"), ("blank", 10, "%PDF"), ("empty", 10, "%PDF"), ("text", 10, "text"), ("none", 0, "")]
    root, source, schema = str(tmp_path / "out"), str(tmp_path / "in"), "job_id string, length long, head string"
    process = lambda accepted: filing.filing_rows(cells.join(accepted.select("job_id"), "job_id", "left_semi"), dims, terms)

    def run(some, process=process):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.intake_filings(spark.readStream.schema(schema).parquet(source), root, process).start().awaitTermination(120)

    def states():
        return {r.job_id: (r.status, r.reason) for r in jobs.filing_jobs(spark, root).collect()}

    def broken(accepted):
        raise ZeroDivisionError("all of them")

    with pytest.raises(Exception, match="all of them"):
        run(files[:1], broken)
    assert states() == {"good": ("failed", "ZeroDivisionError: all of them")}
    run(files[1:])  # the batch is tried again, then the next one
    want = {"good": ("done", None), "dead": ("failed", filing.NO_CELL), "blank": ("failed", filing.NO_PAGE), "empty": ("failed", "no records"), "text": ("failed", "file is not a PDF"), "none": ("failed", "file is empty")}
    assert states() == want
    seen = spark.read.schema(jobs.STATES).option("basePath", f"{root}/status").parquet(f"{root}/status")
    assert [r.status for r in seen.where("job_id = 'good'").orderBy("batch", "phase").collect()] == ["queued", "extracting", "done"]
    records = spark.read.option("basePath", f"{root}/records").parquet(f"{root}/records")
    assert {(r.outcome, r.n) for r in records.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()} == {("item", 1), ("error", 5)}


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema, source = "ts timestamp, state string", str(tmp_path / "in")
    add = lambda *t: spark.createDataFrame([(s,) for s in t], "s string").selectExpr("cast(s as timestamp) as ts", "'a' as state").coalesce(1).write.mode("append").parquet(source)
    add("2024-01-01 00:00:05", "2024-01-01 00:10:00")
    add("2024-01-01 00:09:00")
    add("2024-01-01 00:00:06", "2024-01-01 00:08:30")  # the watermark is at 00:08:00
    counts = jobs.decision_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), width="60 seconds", slide="10 seconds")
    q = counts.writeStream.format("memory").queryName("late_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r.start)[11:]: r.n for r in spark.table("late_counts").groupBy("start").agg(F.max("n").alias("n")).collect()}
    early = [f"{23 if k > 0 else 0:02d}:{59 if k > 0 else 0:02d}:{(60 - k * 10) % 60:02d}" for k in range(6)]
    assert {t: got[t] for t in early} == dict.fromkeys(early, 1) and len(got) == 21 and jobs.dropped(q) == 6
