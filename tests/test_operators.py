from datetime import datetime

from pyspark.sql import functions as F

from tallyspan.operators import audit, cells, drift, evaluate, reconcile, review, scoring, taxonomy
from tallyspan.plans import audit_queries
from tallyspan.streaming import jobs


def test_bands_and_scores(spark):
    df = spark.createDataFrame([(1.0,), (0.95,), (0.94,), (0.65,), (0.64,), (0.0,)], "s double")
    assert [r.b for r in df.select(scoring.confidence_band(F.col("s")).alias("b")).collect()] == ["auto_accepted"] * 2 + ["needs_review"] * 2 + ["manual_required"] * 2
    rows = spark.createDataFrame([("Revenues / Net Sales / Product", "1"), ("Net Sales", "1"), ("Merged / x (1)", "1"), ("", "")], "label string, value string")
    assert [r.score for r in scoring.confidence_score(rows).collect()] == [1.0, 0.85, 0.55, 0.5]


def test_summary_edge(spark):
    jobs_ = spark.createDataFrame([("a",), ("b",), ("none",)], "job_id string")
    rows = [("a", "needs_review" if i < 15 else "auto_accepted") for i in range(100)] + [("b", "manual_required" if i < 1501 else "auto_accepted") for i in range(10000)]
    scored = spark.createDataFrame(rows, "job_id string, band string").withColumns({"status": F.lit("ok"), "is_candidate": F.lit(True)})
    got = {r.job_id: (r.flagged_percent, r.passed) for r in scoring.extraction_summary(jobs_, scored).collect()}
    assert got == {"a": (15.0, True), "b": (15.01, False), "none": (0.0, True)}


def test_published_corpus_figures(spark):
    """Counts of five published filings give back the published macro and micro figures."""
    rows = [("acme", 0, 8), ("globex", 0, 7), ("initech", 0, 9), ("umbrella", 4, 2), ("wayne", 0, 9)]
    gt = {"acme": 6, "globex": 5, "initech": 7, "umbrella": 6, "wayne": 7}
    diffs = []
    for job, tp, fp in rows:
        diffs += [(job, "exact_match")] * tp + [(job, "spurious_item")] * fp + [(job, "classification_mismatch")] * (gt[job] - tp)
    df = spark.createDataFrame(diffs, "job_id string, status string").withColumn("is_optional", F.lit(False))
    runs = spark.createDataFrame([(j, True, 3) for j, *_ in rows] + [("broken", False, 0)], "job_id string, success boolean, cells int")
    scores = spark.createDataFrame([("acme", 0.95)] * 17 + [("acme", 0.94)] * 3 + [("wayne", 0.5), ("other", 0.1)], "job_id string, score double")
    f = {r.job_id: r for r in evaluate.filing_metrics(df, runs, scores).collect()}
    assert (f["acme"].not_auto_percent, f["acme"].is_failed, f["wayne"].is_failed, f["broken"].is_failed) == (15.0, False, True, True)
    assert (f["broken"].generation_errors, f["broken"].accuracy, f["acme"].generation_errors, "other" in f) == (1, 100.0, 0, False)
    m = evaluate.corpus_metrics(evaluate.filing_metrics(df, runs.where("success"), scores)).first()
    assert (m.filings, m.successful_filings, m.failed_filings, m.not_auto, m.review_percent, m.on_target) == (5, 4, 1, 4, 19.05, False)
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == (0.1333, 0.2, 0.16)
    assert (m.micro_precision, m.micro_recall, m.micro_f1, m.accuracy) == (0.1026, 1.0, 0.1861, 12.9)
    assert m.classification_errors == 27 and m.extraction_errors == 35


def test_greedy_keeps_order(spark):
    """Every item likes record 3 and 5 best; the first in order takes the lower index."""
    gt = [("j", 1, i, v, "Net income", "c", False, 0.0, 0.0, 10.0, 10.0) for i, v in enumerate(["5", "7", "5", "5"])]
    ext = [("j", 1, 5, "5", "x", "c", 0.0, 0.0, 10.0, 10.0), ("j", 1, 3, "(7)", "y", "c", 50.0, 0.0, 60.0, 10.0), ("j", 1, 2, "5.0005", "z", "c", 70.0, 0.0, 80.0, 10.0), ("j", 2, 1, "7", "Net income", "c", 0.0, 0.0, 10.0, 10.0)]
    gt = spark.createDataFrame(gt, "job_id string, page int, item_pos int, gt_value string, gt_label string, gt_class string, is_optional boolean, gx0 double, gy0 double, gx1 double, gy1 double")
    ext = spark.createDataFrame(ext, "job_id string, page int, record_index int, value string, label string, class string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.item_pos, r.record_index) for r in evaluate.greedy_match(gt, ext).collect()) == [(0, 5), (2, 2)]
    status = {(r.item_pos, r.record_index): r.status for r in evaluate.match_status(gt, ext).collect()}
    assert status == {(0, 5): "exact_match", (2, 2): "localization_error", (1, None): "missed_item", (3, None): "missed_item", (None, 3): "spurious_item", (None, 1): "spurious_item"}


def test_drift_batch_equals_stream(spark, tmp_path):
    """Two metrics of an entity, three runs of one query on one checkpoint, an order that is not that of the years."""
    rows = [("e", "m", 1, 2023, "a"), ("e", "m", 1, 2023, "b"), ("e", "m", 2, 2021, "b"), ("e", "m", 2, 2021, "a"), ("e", "m", 3, 2022, "a"), ("f", "m", 1, 2021, "x"), ("f", "m", 2, 2022, "x"), ("f", "m", 3, 2023, " ")]
    rows += [("e", "n", 1, 2023, "b"), ("e", "n", 3, 2022, "b"), ("e", "n", 4, 2024, "c")]
    sets = drift.locked_labels(spark.createDataFrame(rows, "entity string, metric string, eval_seq int, year int, normalized_label string"))
    compared = drift.drift_compare(sets)
    batch = {(r.entity, r.metric, r.eval_seq): (r.node, r.changed) for r in drift.drift_nodes(compared).collect()}
    assert batch == {
        ("e", "m", 1): (1, True), ("e", "m", 2): (1, False), ("e", "m", 3): (2, True), ("f", "m", 1): (1, True), ("f", "m", 2): (1, False),
        ("e", "n", 1): (1, True), ("e", "n", 3): (1, False), ("e", "n", 4): (2, True),
    }
    got = {}
    for run, seqs in enumerate(((1,), (2, 3), (4,))):
        sets.where(F.col("eval_seq").isin(*seqs)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(sets.schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{run}")
        q = jobs.drift(stream).writeStream.foreachBatch(lambda b, n, o=out: b.write.parquet(f"{o}/{n}")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got.update({(r.entity, r.metric, r.eval_seq): (r.node, r.changed) for r in spark.read.parquet(f"{out}/*").collect()})
    assert got == batch
    nodes, edges = drift.drift_history(compared, "e", "m")
    assert {(r.node, r.eval_seq, r.filings, tuple(r.labels)) for r in nodes.collect()} == {(1, 1, 2, ("a", "b")), (2, 3, 1, ("a",))} and edges.count() == 2
    assert {(r.metric, r.eval_seq, tuple(r.removed)) for r in drift.drift_flags(compared).collect()} == {("m", 3, ("b",)), ("n", 4, ("b",))}
    filed = [("1", "e_2022_10k.pdf", "m"), ("2", "e_2022_10k.pdf", "n"), ("3", "e_2021_10k.pdf", "m"), ("4", "e_2021_10k.pdf", "n"), ("5", "e_2023_x.pdf", "m")]
    status = audit.drift_job_status(spark.createDataFrame(filed, "job_id string, filename string, target_metric string"), compared).collect()
    assert sorted((r.job_id, r.metric, r.state, r.flags) for r in status) == [("1", "m", "evaluated", 1), ("2", "n", "evaluated", 0), ("3", "m", "evaluated", 0), ("4", "n", "skipped_no_locked_records", 0), ("5", "m", "evaluated", 0)]


def test_stream_counts(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s), "confirmed") for s in (1, 2, 59)] + [(datetime(2024, 1, 1, 0, 9), "x")]
    df = spark.createDataFrame(rows, "ts timestamp, state string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.decision_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("counts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.state, r.n) for r in spark.table("counts_out").collect()] == [("confirmed", 3)]


def test_headers_noise_runs(spark):
    grid = spark.createDataFrame(
        [("f", 0, 0, 0, 0, "Item", True, True), ("f", 0, 1, 0, 1, "2023", False, True), ("f", 0, 2, 1, 0, "Net income", True, False), ("f", 0, 3, 1, 1, "50", False, False), ("f", 0, 4, 2, 2, "7", False, False)],
        "source_file string, table_idx int, cell_idx int, start_row int, start_col int, text string, is_row_header boolean, is_col_header boolean",
    )
    assert {r.cell_idx: r.label for r in cells.header_label_path(grid).collect()} == {3: "Net income / 2023", 4: "7"}
    texts = spark.createDataFrame([(t,) for t in ("Item 7. x", "(in millions)", "Cash", "n/a", "—", "12", " ", None)], "text string")
    assert [r.text for r in cells.cell_noise_filter(texts).collect()] == ["n/a", "—", "12"]
    runs = spark.createDataFrame([("j", 0, "a"), ("j", 1, "a"), ("j", 2, None), ("j", 3, "a")], "job_id string, record_index int, table_name string")
    assert [(r.table_name, r.n) for r in review.table_runs(runs).orderBy("run").collect()] == [("a", 2), (None, 1), ("a", 1)]


def test_tree_and_total(spark):
    rows = [("j", 0, "A", "10", 1), ("j", 1, "B", "(4)", 1), ("j", 2, "A", "$1", 2), ("j", 3, "B ", "x", 2)]
    items = spark.createDataFrame(rows, "job_id string, record_index int, normalized_label string, value string, page int").withColumns(
        {"label": F.lit("l"), "band": F.lit("auto_accepted"), "is_confirmed": F.lit(False), "source_file": F.lit("f"), "x0": F.lit(0.0), "x1": F.lit(1.0), "y0": F.lit(0.0), "y1": F.lit(1.0)}
    )
    inputs = reconcile.formula_inputs(items)
    total = {r.label: (r.total, r.n, r.unparsed) for r in reconcile.reconciliation_total(inputs).collect()}
    assert total == {"A": (11.0, 2, 0), "B": (-4.0, 2, 1), None: (7.0, 4, 1)}
    nodes = reconcile.formula_nodes(inputs)
    assert nodes.where("kind = 'aggregate'").count() == 2 and nodes.count() == 7
    root = {r.sheet: r.content for r in reconcile.model_cells(nodes).where("kind = 'root'").collect()}
    assert root == {"Reconciliation": "=B5+B8"}
    clash = inputs.withColumn("leaf_label", F.when(F.col("record_index") < 2, "Net income").otherwise("Net Income"))
    cells = {r.coord: r.content for r in reconcile.model_cells(reconcile.formula_nodes(clash)).where("sheet = 'Reconciliation'").collect()}
    assert cells["B5"] == "=B3+B4" and cells["B8"] == "=B6+B7" and cells["B9"] == "=B5+B8"
    edges = reconcile.formula_edges(reconcile.formula_nodes(clash)).where("parent_id = 'agg_net_income'").groupBy("group_label").count().collect()
    assert {r.group_label: r["count"] for r in edges} == {"Net income": 2, "Net Income": 2}


def test_taxonomy(spark):
    tax = spark.createDataFrame([(0, "Lease Adjustments"), (1, "lease-adjustments"), (2, "--")], "position int, entry string")
    rows = spark.createDataFrame([("LEASE adjustments",), ("Lease Adjustments",), ("..",)], "label string")
    got = {r.label: (r.matched, r.canon_entry) for r in taxonomy.canonical_match(taxonomy.exact_match(rows, tax, "label"), tax, "label").collect()}
    assert got == {"LEASE adjustments": (None, "Lease Adjustments"), "Lease Adjustments": ("Lease Adjustments", "Lease Adjustments"), "..": (None, None)}
    more = taxonomy.taxonomy_append(tax, spark.createDataFrame([("new",), ("new",), ("--",), (None,)], "term string"))
    assert sorted(map(tuple, more.collect()))[-1] == (3, "new") and more.count() == 4


def test_entry_without_training_data():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_confidence_strips(spark):
    rows = [("Net Sales / ", "1"), (" x / y ", " 2 "), ("5 ", " 5"), (None, None), ("a / b (1)", "3"), ("merged / b", "3*")]
    got = {r.label: r.score for r in scoring.confidence_score(spark.createDataFrame(rows, "label string, value string")).collect()}
    assert got == {"Net Sales / ": 0.85, " x / y ": 1.0, "5 ": 0.85, None: 0.5, "a / b (1)": 0.9, "merged / b": 0.55}


def test_records_beside_items(spark):
    records = spark.createDataFrame([("a", 0, "x / y", "1"), ("a", 1, "x / y", "1"), ("b", 0, "x / y", "1")], "job_id string, record_index int, label string, value string").withColumn("is_candidate", F.lit(False))
    norm = spark.createDataFrame([("a", 0, "t", True, "torn", True), ("a", 1, "t", False, None, True), ("b", 0, "t", True, None, True), ("b", 1, "t", True, None, True)], "job_id string, record_index int, table_name string, is_error boolean, error_detail string, is_candidate boolean")
    got = {(r.job_id, r.record_index): (r.score, r.status, r.error_detail, r.table_name, r.is_candidate) for r in scoring.score_with_items(records, norm).collect()}
    assert got == {("a", 0): (0.0, "extraction_error", "torn", "t", True), ("a", 1): (1.0, "ok", None, "t", True), ("b", 0): (1.0, "ok", None, None, False)}


def test_classifiers(spark, tmp_path):
    rows = spark.createDataFrame([("j", 0, "Net income"), ("j", 1, "boom"), ("j", 2, "Net income"), ("j", 3, "odd"), ("j", 4, None)], "job_id string, record_index int, label string")
    seen = []

    def answer(labels):
        import pandas as pd

        return pd.DataFrame({"label": [None if x is None else x.upper() for x in labels], "confidence": [2.0 if x == "odd" else 0.5 for x in labels]})

    def fails(labels):
        raise RuntimeError("down")

    got = {r.record_index: (r.resp_label, r.resp_confidence, r.is_error) for r in taxonomy.classify(rows, taxonomy.batch_classifier(answer)).collect()}
    assert got[0] == got[2] == ("NET INCOME", 0.5, False) and got[3] == (None, None, True) and got[4] == (None, None, True) and not seen
    down = taxonomy.classify(rows, taxonomy.batch_classifier(fails))
    assert down.where("is_error").count() == 5
    saved = taxonomy.classification_fallback(taxonomy.classify(rows.withColumn("label", F.lit("lease ADJUSTMENTS.")), taxonomy.batch_classifier(fails)))
    assert {(r.resp_label, r.resp_confidence, r.is_error) for r in saved.collect()} == {("Lease Adjustments", 0.95, False)}
    seed = [r.entry for r in taxonomy.taxonomy_scan(spark, None).orderBy("position").collect()]
    assert len(seed) == 10
    for text, want in (('["b", "a"]', ["b", "a"]), ("[1, 2]", seed), ("nonsense", seed), ('{"a": 1}', seed), ("[]", [])):
        path = tmp_path / "t.json"
        path.write_text(text)
        assert [r.entry for r in taxonomy.taxonomy_scan(spark, str(path)).orderBy("position").collect()] == want, text
    assert taxonomy.taxonomy_scan(spark, str(tmp_path / "none.json")).count() == 10


def test_normalize_with_and_without_a_join(spark):
    """Answers joined to their records give what rows give that hold them already; a record without an answer counts as such."""
    tax = spark.createDataFrame([(0, "Net Income"), (1, "Interest")], "position int, entry string")
    cols = "job_id string, record_index int, label string, band string, status string"
    scored = spark.createDataFrame([("a", 0, "x", "auto_accepted", "ok"), ("a", 1, "interest", "needs_review", "ok"), ("a", 2, "y", "auto_accepted", "ok"), ("a", 3, "Interest", "manual_required", "ok")], cols)
    answers = spark.createDataFrame([("a", 0, "net-income", False), ("a", 2, "Other", False), ("a", 3, None, True)], "job_id string, record_index int, resp_label string, is_error_resp boolean")
    joined = taxonomy.normalize_records(scored, answers, tax)
    held = taxonomy.normalize_answered(scored.join(answers, ["job_id", "record_index"], "left"), tax)
    want = [(0, "Net Income", "matched"), (1, "Interest", "matched"), (2, "Other", "pending"), (3, None, "pending")]
    for out in (joined, held):
        assert out.columns == scored.columns + ["normalized_label", "taxonomy_status"]
        assert sorted((r.record_index, r.normalized_label, r.taxonomy_status) for r in out.collect()) == want


def test_chain_of_every_cell(spark):
    """Labels of one slug keep their leaves apart; a leaf's record carries its place; an unknown ref is one row."""
    rows = [("j", i, n, 1, "5", "f.pdf", 1.0, 2.0, 3.0, 4.0, None) for i, n in enumerate(["Net Income", "Net income", "Net Income", "Net income", "Tax"])]
    inputs = spark.createDataFrame(rows, "job_id string, record_index int, leaf_label string, page int, value string, source_file string, x0 double, y0 double, x1 double, y1 double, reason string")
    cells_ = reconcile.model_cells(reconcile.formula_nodes(inputs, carry=reconcile.SOURCE))
    kinds = {(r.sheet, r.coord): r.kind for r in cells_.collect()}
    got = {}
    for r in reconcile.source_chain(cells_).collect():
        got.setdefault((r.sheet, r.coord), set()).add(int(r.leaf_id.split("_")[1]))
    assert set(got) == set(kinds)
    assert sorted(tuple(sorted(v)) for k, v in got.items() if kinds[k] != "leaf") == [(0, 1, 2, 3, 4), (0, 2), (1, 3)]
    assert all(len(v) == 1 for k, v in got.items() if kinds[k] == "leaf")
    made = reconcile.provenance_build(cells_).select("kind_", "target.source", "target.selector.value").distinct().collect()
    assert {(r.kind_, r.source, r.value) for r in made} == {("leaf", "f.pdf", "page=1&xywh=1.00,2.00,2.00,2.00"), ("aggregate", "model_derived", None), ("root", "model_derived", None)}
    refs = spark.createDataFrame([("j", " Reconciliation", "b3 "), ("j", "Reconciliation", "B99"), ("k", "Reconciliation", "B3")], "job_id string, sheet string, coord string")
    chain = {(r.job_id, r.coord): (r.is_found, r.leaf_id) for r in reconcile.source_chain_of(refs, cells_).collect()}
    assert chain == {("j", "B3"): (True, "leaf_0_net_income"), ("j", "B99"): (False, None), ("k", "B3"): (False, None)}


def test_terms_of_one_prefix_use_all_partitions(spark):
    n = 20_000
    old = spark.createDataFrame([(0, "prefix 00017"), (4, "zz")], "position int, entry string")
    terms = spark.range(n).selectExpr("concat('prefix ', lpad(cast(id as string), 5, '0')) as term").union(spark.createDataFrame([("zz",), (None,), ("aa",), ("aa",)], "term string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = taxonomy.taxonomy_append(old, terms)
        got = {r.entry: r.position for r in out.collect()}
        tasks = [f for f in out.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {"prefix 00017": 0, "zz": 4, **{e: 5 + k for k, e in enumerate(sorted({"aa", *(f"prefix {k:05d}" for k in range(n) if k != 17)}))}}
    assert len(tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_classifier_may_raise_anything(spark):
    rows = spark.createDataFrame([("a", 0, " Debt "), ("a", 1, None)], "job_id string, record_index int, label string")

    def fails(batch):
        raise KeyError("gone")

    def loads():
        raise OSError("no model")

    def answers():
        import pandas as pd

        return lambda batch: pd.DataFrame({"label": batch.str.strip(), "confidence": 0.5})

    for classifier, why in ((taxonomy.batch_classifier(fails), "KeyError: 'gone'"), (taxonomy.batch_classifier(factory=loads), "OSError: no model")):
        assert {(r.is_error, r.error_detail, r.resp_label) for r in taxonomy.classify(rows.where("label is not null"), classifier).collect()} == {(True, why, None)}
    assert taxonomy.classify(rows, taxonomy.dictionary_answer).where("label is null").first().error_detail == "answer is not valid"  # no label is no question
    got = {r.record_index: (r.is_error, r.resp_label) for r in taxonomy.classify(rows.where("label is not null"), taxonomy.batch_classifier(factory=answers)).collect()}
    assert got == {0: (False, "Debt")}
    assert taxonomy.classify(rows, taxonomy.dictionary_answer).where("record_index = 0").first().resp_label == "Debt"


def test_runs_of_unknown_filings_are_left_out(spark):
    diffs = spark.createDataFrame([("a", "exact_match", False)], "job_id string, status string, is_optional boolean")
    runs = spark.createDataFrame([("a", True, 1), ("x", False, 0)], "job_id string, success boolean, cells int")
    scores = spark.createDataFrame([("a", 1.0)], "job_id string, score double")
    assert [r.job_id for r in evaluate.filing_metrics(diffs, runs, scores, diffs).collect()] == ["a"]
    assert evaluate.filing_metrics(diffs, runs, scores).count() == 2


def test_every_run_has_its_metrics(spark):
    """A run of a filing without line items is a filing with nothing found: it counts in the metrics and in the report's tables."""
    sf, q = "/root/testdata/sf0.001", audit_queries.QUERIES
    runs = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("cast(o_orderkey as string) as job_id", "o_orderstatus")
    empty = runs.join(spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_orderkey as string) as job_id"), "job_id", "left_anti")
    assert empty.count() > 0
    per = q["filing_metrics"](spark, sf)
    assert per.count() == runs.count() and {r.job_id for r in per.where("extracted = 0").collect()} == {r.job_id for r in empty.collect()}
    assert q["corpus_metrics"](spark, sf).first().filings == runs.count()
    failed = {r.job_id for r in q["report_failed_filings"](spark, sf).collect()}
    assert {r.job_id for r in empty.where("o_orderstatus = 'P'").collect()} <= failed
