"""Audit trail, report and file sources on literal cases: rule order, absent rows, malformed lines, empty inputs."""

import json

from pyspark.sql import functions as F

from tallyspan.operators import audit, cells, reconcile, report
from tallyspan.sources import corpus

CHAIN = "job_id string, sheet string, coord string, leaf_id string"
REVIEW = "id string, job_id string, record_index int, status string, value string, label string"


def test_chain_states(spark):
    chain = spark.createDataFrame([("a", "S", "B1", "leaf_0_x"), ("a", "S", "B2", "leaf_0_x"), ("a", "S", "B2", "leaf_9_y"), ("a", "S", "B3", "leaf_1_z"), ("b", "S", "B1", "leaf_0_x")], CHAIN)
    review = spark.createDataFrame([("a_0", "a", 0, "locked", "7", "X"), ("a_1", "a", 1, "flagged", "8", "Z")], REVIEW)
    rows = audit.chain_review_enrich(chain, review)
    assert {(r.job_id, r.coord, r.leaf_id): (r.review_status, r.value) for r in rows.collect()} == {
        ("a", "B1", "leaf_0_x"): ("locked", "7"), ("a", "B2", "leaf_0_x"): ("locked", "7"), ("a", "B2", "leaf_9_y"): ("source_record_missing", None), ("a", "B3", "leaf_1_z"): ("flagged", "8"), ("b", "B1", "leaf_0_x"): ("unreviewed", None),
    }
    all_cells = chain.select("job_id", "sheet", "coord").distinct().union(spark.createDataFrame([("c", "S", "B1")], "job_id string, sheet string, coord string"))
    got = {(r.job_id, r.coord): (r.state, r.n, r.locked) for r in audit.chain_rollup(all_cells, rows).collect()}
    assert got == {("a", "B1"): ("all_locked", 1, 1), ("a", "B2"): ("has_missing", 2, 1), ("a", "B3"): ("contains_flagged", 1, 0), ("b", "B1"): ("in_review", 1, 0), ("c", "B1"): ("in_review", 0, 0)}
    assert audit.chain_rollup(all_cells.limit(0), rows).count() == 0


def test_leaf_pick_and_scan(spark):
    rows = [("j", "Other", "B1", "leaf_0_a", 1), ("j", "Other", "B9", "leaf_0_a", 9), ("j", "Source_Inputs", "B2", "leaf_1_b", 2), ("j", "Source_Inputs", "B3", "leaf_1_b", 3), ("j", "Other", "B4", "agg_a", 4)]
    prov = spark.createDataFrame(rows, "job_id string, sheet string, coord string, node_id string, seq int")
    assert {r.leaf_id: r.coord for r in audit.chain_leaf_pick(prov).collect()} == {"leaf_0_a": "B1", "leaf_1_b": "B3"}
    refs = spark.createDataFrame([("j", " Other ", "b9"), ("j", "Other", "B9"), ("j", "Other", "B77"), ("j", None, "B9")], "job_id string, sheet string, coord string")
    assert [r.coord for r in audit.provenance_scan(prov, refs).collect()] == ["B9"]


def test_governance_lines(spark):
    line = lambda **k: json.dumps(k)
    rows = [
        ("ok", line(taxonomy_status="matched", raw_response={"label": "x", "confidence": 1})), ("ok", line(resulting_state="classification_error", raw_response=None)), ("ok", " "), ("ok", line(error_detail="e", raw_response="text")), ("ok", line(raw_response={"note": "1"})),
        ("flag", line(resulting_state="confirmed", raw_response={"label": "x", "sure": True})), ("sum", line(raw_response={"sum": 1.5})), ("whole", line(raw_response={"n": 2})), ("nested", line(raw_response={"o": {"n": 1}})), ("bad", line(taxonomy_status="matched")), ("bad", "{"),
    ]
    got = {r.job_id: tuple(r)[1:] for r in audit.classifier_governance(spark.createDataFrame(rows, "job_id string, line string")).collect()}
    assert got == {"ok": (4, 1, 2, 1, True), "flag": (1, 1, 0, 0, False), "sum": (1, 0, 0, 1, False), "whole": (1, 0, 0, 1, False), "nested": (1, 0, 0, 1, True), "bad": (0, 0, 0, 0, True)}


def test_overrides_order(spark):
    review = spark.createDataFrame([("j_0", "j", 0, "locked", "2", "L"), ("j_1", "j", 1, "locked", "1", "L"), ("j_2", "j", 2, "manual_required", "1", "L"), ("j_3", "j", 3, "locked", "5", "L"), ("j_9", "j", 9, "locked", "1", "new")], REVIEW)
    scored = spark.createDataFrame([("j", i, "1", "L", "extraction_error" if i == 3 else "ok") for i in range(4)], "job_id string, record_index int, value string, label string, status string")
    scored = scored.selectExpr("*", "array('f') as flags", "'needs_review' as band")
    review = review.selectExpr("*", "if(record_index = 0, array('g'), null) as flags", "cast(null as string) as band", "1 as page")
    prov = spark.createDataFrame([("j", "Model", "B7", "hardcode_1", ("12",)), ("j", "Model", "B8", "leaf_1_x", ("1",))], "job_id string, sheet string, coord string, node_id string, body struct<value:string>")
    rows = audit.manual_overrides(review, scored, prov).collect()
    assert {r.item_id: (r.flags, r.band, r.page) for r in rows} == {"j_0": (["g"], "needs_review", 1), "j_2": (["f"], "needs_review", 1), "j_3": (["f"], "needs_review", 1), "Model!B7": (["manual_hardcode"], "manual_required", 1)}
    assert {r.item_id: (r.x0, r.y1, r.is_hardcode) for r in rows}["Model!B7"] == (0.0, 1000.0, True)
    got = {r.item_id: (r.override_type, r.final_value) for r in rows}
    assert got == {"j_0": ("user_edit", "2"), "j_2": ("manual_required_entry", "1"), "j_3": ("extraction_error_recovery", "5"), "Model!B7": ("manual_hardcode", "12")}


def test_cells_and_tie_out(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = spark.createDataFrame([(None, None, None, None, None), (2, 3, None, (1.0, 2.0, 3.0, 4.0), (9.0, 9.0, 9.0, 9.0))], f"page_cell int, page_table int, bbox_cell {box}, bbox_prov {box}, bbox_table {box}")
    assert [(r.page, r.x0, r.y1) for r in cells.cell_location(rows).orderBy("page").collect()] == [(1, 0.0, 0.0), (2, 1.0, 4.0)]
    raw = spark.createDataFrame([("t", "1", "2"), (None, "1", "1"), ("t", "x", "1"), ("t", "1", "-1"), ("t", "1.5e", None)], "text string, start_row string, start_col string")
    raw = raw.withColumns({"label": F.lit("l"), **{b: F.lit(5.0) for b in cells.BOX}})
    assert [(r.is_error, r.label, r.x0) for r in cells.cell_error_rows(raw).collect()] == [(False, "l", 5.0)] + [(True, "Error / Unparsed Cell", 0.0)] * 4
    acme = [("Net income", "50,000"), ("Interest expense", "5,000"), ("Taxes", "12,000"), ("Depreciation", "8,000"), ("Stock", "15,000"), ("Adjusted EBITDA", "90,000")]
    inputs = spark.createDataFrame([("acme", n, x, None) for n, x in acme], "job_id string, leaf_label string, value string, reason string")
    stated = spark.createDataFrame([("acme", 90000.0), ("none", 1.0)], "job_id string, expected_total double")
    assert {r.job_id: (r.total, r.ties) for r in reconcile.reconciliation_tie_out(inputs, stated, "adjusted ebitda").collect()} == {"acme": (90000.0, True), "none": (None, False)}


def test_runs_and_gate(spark):
    runs = spark.createDataFrame([("a", True, 100, 150, 50), ("b", False, 4, 0, 0)], "job_id string, success boolean, extraction int, classification int, generation int")
    m = report.runtime_metrics(runs).first()
    assert (m.runs, m.succeeded, m.total_seconds, m.mean_seconds, m.within_budget) == (2, 1, 304.0, 152.0, True)
    assert [r.failed_at for r in report.failing_stage(runs).orderBy("job_id").collect()] == [None, "classification"]
    assert report.runtime_metrics(runs.limit(0)).first().within_budget
    c90 = spark.createDataFrame([(90.0, 0)], "accuracy double, failed_filings int")
    assert tuple(report.strict_gate(c90, runs).first()) == (False, False)
    assert tuple(report.strict_gate(c90, runs.where("success")).first()) == (True, True)
    assert tuple(report.strict_gate(c90.withColumn("failed_filings", F.lit(1)), runs.where("success")).first()) == (True, False)
    assert tuple(report.strict_gate(c90.withColumn("accuracy", F.lit(89.99)), runs.where("success")).first()) == (True, False)


def test_corpus_rules(spark):
    filings = spark.createDataFrame([("a", 2, 2), ("b", 1, 3)], "job_id string, page_count int, actual_pages int")
    rows = spark.createDataFrame([("a", 2, "(1)", 5.0), ("a", 3, "x", 5.0), ("b", 1, None, 5.0), ("b", 1, "z", 5.0), ("b", 1, "1", 0.0)], "job_id string, page int, value string, x1 double")
    rows = rows.selectExpr("*", "'l' as label", "'n' as normalized_label", "0.0 as x0", "0.0 as y0", "1.0 as y1")
    manifest = spark.createDataFrame([("a",), ("gone",)], "job_id string")
    got = {(r.job_id, r.rule): r.n for r in report.corpus_validation(rows, filings, manifest).collect()}
    assert got == {("a", "page_beyond_end"): 1, ("a", "value_not_numeric"): 1, ("b", "value_not_numeric"): 1, ("b", "schema_breach"): 2, ("b", "page_count_differs"): 1, ("gone", "folder_missing"): 1, (None, "too_few_filings"): 1}
    known, unknown = report.filing_filter(rows, manifest)
    assert known.count() == 2 and [r.job_id for r in unknown.collect()] == ["gone"]


def test_files_round_trip(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / "gt" / name).mkdir(parents=True)
        box = {"x0": 0, "y0": 0, "x1": 1, "y1": 1}
        doc = {"metadata": {"filing_id": name, "page_count": 2}, "ground_truth_items": [{"value": "1", "label": name, "page": 1, "bbox": box}, {"value": "2", "label": "z", "page": 2, "bbox": box}], "expected_reconciliation_total": 3}
        (tmp_path / "gt" / name / "ground_truth.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "manifest.json").write_text(json.dumps({"filing_ids": ["c", "a"]}, indent=1))
    filings, rows = corpus.gt_corpus_scan(spark, str(tmp_path / "gt"))
    assert [r.filing_id for r in filings.orderBy("order_key").collect()] == ["a", "b", "c"] and rows.count() == 6
    filings, rows = corpus.gt_corpus_scan(spark, str(tmp_path / "gt"), str(tmp_path / "manifest.json"))
    assert [r.filing_id for r in filings.orderBy("order_key").collect()] == ["c", "a"]
    assert {(r.job_id, r.item_pos, r.value, r.bbox.x1) for r in rows.collect()} == {(j, i, str(i + 1), 1.0) for j in "ca" for i in (0, 1)}

    log = spark.createDataFrame([("j", 1, "t", "matched", "confirmed", None), ("j", 0, "t", "pending", "x", "e")], "job_id string, record_index int, timestamp string, taxonomy_status string, resulting_state string, error_detail string")
    corpus.decision_log_sink(log, str(tmp_path / "log"))
    (tmp_path / "log" / "extra.json").write_text("\n\n{broken\n")
    back = corpus.decision_log_scan(spark, str(tmp_path / "log")).collect()
    assert sorted((r.record_index, r.error_detail) for r in back if r._corrupt_record is None) == [(0, "e"), (1, None)]
    assert [r._corrupt_record for r in back if r.job_id is None] == ["{broken"]

    nodes = spark.createDataFrame([("e", "m", 1, 1), ("e", "m", 2, 1), ("e", "m", 3, 2)], "entity string, metric string, eval_seq int, node int")
    for _ in range(2):
        corpus.drift_store(nodes, nodes.limit(1), str(tmp_path / "drift"))
    n, edges, latest = corpus.drift_load(spark, str(tmp_path / "drift"))
    assert n.count() == 3 and edges.count() == 1 and [tuple(r) for r in latest.collect()] == [("e", "m", 2)]
