"""Registered queries of the audit trail, the report and what surrounds them; QUERIES and ORACLES hold all queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspan.operators import audit as a
from tallyspan.operators import cells as c
from tallyspan.operators import chain
from tallyspan.operators import evaluate as e
from tallyspan.operators import filing
from tallyspan.operators import reconcile as r
from tallyspan.operators import report as p
from tallyspan.operators import review as v
from tallyspan.plans.queries import _DICT, D, E1, E3, ITEMS, JOBS, N, ORACLES, QUERIES, R0, R2, REVIEW, RUNS, S, TAX, _compared, _confirmed, _inputs, _nodes, _num, _runs, _scored_diffs, _sides, _slug, items, normalized, query, scored
from tallyspan.sources.fixtures import fixture, job_tasks, oracle
from tallyspan.sources.scratch import scratch_dir, stored, stored_by

__all__ = ["ORACLES", "QUERIES"]

METRIC = "Economy"
LOG = oracle("fx_log")
RV = """rv AS (SELECT id, job_id, record_index, page, x0, y0, x1, y1, band, label, normalized_label, taxonomy_status, CASE WHEN record_index % 4 = 1 THEN '0' ELSE value END AS value,
  CASE WHEN st <> 'extraction_error' AND page = 1 THEN 'locked' WHEN record_index % 6 = 5 THEN 'flagged' ELSE st END AS status FROM review)"""
PROV = "prov AS (SELECT *, kind <> 'leaf' OR sheet = 'Reconciliation' AS is_formula, cast(substring(coord, 2) AS int) AS seq FROM cells_)"
CHAIN = """chain AS (SELECT job_id, sheet, coord, node_id AS leaf_id FROM cells_ WHERE kind = 'leaf'
  UNION ALL SELECT k.job_id, k.sheet, k.coord, n.node_id FROM cells_ k JOIN nodes n ON n.job_id = k.job_id AND n.kind = 'leaf' AND (k.kind = 'root' OR n.group_label = k.group_label) WHERE k.kind <> 'leaf')"""
ENR = """enr AS (SELECT h.*, coalesce(i.status, CASE WHEN j.job_id IS NOT NULL THEN 'source_record_missing' ELSE 'unreviewed' END) AS review_status, i.value, i.label
  FROM chain h LEFT JOIN rv i ON i.id = h.job_id || '_' || regexp_extract(h.leaf_id, '^leaf_(\\d+)_', 1) LEFT JOIN (SELECT DISTINCT job_id FROM rv) j ON j.job_id = h.job_id)"""
DJ = """dj AS (SELECT j.job_id, j.target_metric, regexp_extract(j.filename, '^([^_.]*)', 1) AS entity, j.year, x.is_baseline, x.changed, len(x.added) AS n_added, len(x.removed) AS n_removed
  FROM (SELECT *, coalesce(try_cast(regexp_extract(filename, '((?:19|20)\\d{2})', 1) AS INT), 2024) AS year FROM fx_jobs) j LEFT JOIN comp x ON replace(x.entity, '#', '-') = regexp_extract(j.filename, '^([^_.]*)', 1) AND x.metric = j.target_metric AND x.year = j.year)"""
RVS = (*N, REVIEW, RV)
P0 = (*R2, PROV)
CH = (*R2, PROV, CHAIN, REVIEW, RV, ENR)
DJS = (*D, JOBS, DJ)


def _review(spark, sf):
    return _review_of(normalized(spark, sf))


def _review_of(rows):
    """Items some weeks into their review: page 1 locked, some flagged, some amounts changed."""
    k, s = F.col("record_index"), F.col("status")
    rows = v.review_items_init(rows)
    status = F.when((s != "extraction_error") & (F.col("page") == 1), "locked").when(k % 6 == 5, "flagged").otherwise(s)
    return rows.withColumns({"status": status, "value": F.when(k % 4 == 1, "0").otherwise(F.col("value")), "source_file": F.concat("job_id", F.lit(".pdf"))})


def _model(spark, sf):
    return r.model_cells(_nodes(spark, sf, r.SOURCE))


def _provenance(spark, sf):
    return r.provenance_build(_model(spark, sf))


def _trail(spark, sf):
    """(cells, review): a model and its review from one reading of the records, both stored for the joins between them."""
    rows = _records(spark, sf)
    return _by_job(spark, sf)(_model_of(spark, sf, rows)), _review_of(rows)


def _records(spark, sf):
    """Normalized records, read once from the given tables and stored by job."""
    return _by_job(spark, sf)(normalized(spark, sf).drop("p_type", "p_name", "amount", "suppkey"))


def _model_of(spark, sf, rows):
    return r.model_cells(r.formula_nodes(r.formula_inputs(_confirmed(rows)), carry=r.SOURCE))


def _drift(spark, sf):
    """Comparisons under the entity name that file names carry."""
    return _compared(spark, sf).withColumn("entity", F.replace("entity", F.lit("#"), F.lit("-")))


def _jobs(spark, sf):
    return fixture(spark, sf, "fx_jobs")


# ---- cells
PLACED = """loc AS (SELECT *, CASE WHEN partkey % 3 <> 0 THEN page END AS page_cell, CASE WHEN suppkey % 4 <> 0 THEN cast(7 AS int) END AS page_table FROM fx_line_items)"""


def _box(cond, shift):
    return F.when(cond, F.struct(*[(F.col(b) + shift).alias(b) for b in c.BOX]))


@query("SELECT job_id, record_index, coalesce(page_cell, page_table, 1) AS page, " + ", ".join(f"CASE WHEN partkey % 5 <> 0 THEN {b} WHEN suppkey % 2 = 0 THEN {b} + 1 WHEN partkey % 7 <> 0 THEN {b} + 2 ELSE 0 END AS {b}" for b in c.BOX) + " FROM loc", ITEMS, PLACED)
def cell_location(spark, sf):
    k, s = F.col("partkey"), F.col("suppkey")
    rows = items(spark, sf).withColumns({"page_cell": F.when(k % 3 != 0, F.col("page")), "page_table": F.when(s % 4 != 0, F.lit(7)), "bbox_cell": _box(k % 5 != 0, 0), "bbox_prov": _box(s % 2 == 0, 1), "bbox_table": _box(k % 7 != 0, 2)})
    return c.cell_location(rows).select("job_id", "record_index", "page", *c.BOX)


@query("SELECT job_id, record_index, bad AS is_error, CASE WHEN bad THEN 'Error / Unparsed Cell' ELSE label END AS label, " + ", ".join(f"CASE WHEN bad THEN 0 ELSE {b} END AS {b}" for b in c.BOX) + " FROM (SELECT *, partkey % 19 = 0 OR suppkey % 23 = 0 OR record_index = 6 AS bad FROM fx_line_items)", ITEMS)
def cell_error_rows(spark, sf):
    i = F.col("record_index")
    rows = items(spark, sf).withColumns({"text": F.when(F.col("partkey") % 19 != 0, F.col("value")), "start_row": F.when(F.col("suppkey") % 23 == 0, "row x").otherwise(i.cast("string")), "start_col": F.when(i == 6, -1).otherwise(i)})
    return c.cell_error_rows(rows).select("job_id", "record_index", "is_error", "label", *c.BOX)


@query("SELECT job_id, record_index, value, label, page, x0, y0, x1, y1, job_id || '.pdf' AS source_file, is_candidate FROM scored", *S)
def assemble_records(spark, sf):
    rows = c.assemble_records(scored(spark, sf).withColumn("source_file", F.concat("job_id", F.lit(".pdf"))))
    return rows.select("job_id", "record_index", "value", "label", "page", "bbox.*", "source_file", "is_candidate")


# ---- chains of stored provenance, from the text of its formulas
TEXT_CHAIN = """mention AS (SELECT job_id, sheet, coord, unnest(regexp_extract_all(content, '(?:[A-Za-z_]+!)?[A-Z]+[0-9]+')) AS r FROM prov WHERE is_formula),
hop AS (SELECT job_id, sheet, coord, CASE WHEN contains(r, '!') THEN split_part(r, '!', 1) ELSE sheet END AS to_sheet, split_part(r, '!', -1) AS to_coord FROM mention),
led AS (SELECT * FROM hop UNION SELECT l.job_id, l.sheet, l.coord, h.to_sheet, h.to_coord FROM led l JOIN hop h ON h.job_id = l.job_id AND h.sheet = l.to_sheet AND h.coord = l.to_coord),
text_chain AS (SELECT l.job_id, l.sheet, l.coord, l.to_sheet AS leaf_sheet, l.to_coord AS leaf_coord, p.node_id AS leaf_id, p.job_id IS NULL AS is_missing FROM led l ANTI JOIN hop h ON h.job_id = l.job_id AND h.sheet = l.to_sheet AND h.coord = l.to_coord
  LEFT JOIN prov p ON p.job_id = l.job_id AND p.sheet = l.to_sheet AND p.coord = l.to_coord
  UNION ALL SELECT job_id, sheet, coord, sheet, coord, node_id, false FROM prov WHERE NOT is_formula)"""
TC = (*R2, PROV, TEXT_CHAIN)


def _by_job(spark, sf):
    """stored() by job, as the line items are dealt."""
    n = job_tasks(spark, sf)
    return lambda df: stored_by(df, "job_id", n)


def _stored_provenance(spark, sf):
    """Provenance as it lies in the shared folder, by job: of each record what its chain needs."""
    c_ = F.col
    value, place = F.struct(c_("body.value").alias("value")), F.struct(F.struct(c_("target.selector.value").alias("value")).alias("selector"))
    return _by_job(spark, sf)(_provenance(spark, sf).select("job_id", "sheet", "coord", "node_id", "is_formula", value.alias("body"), place.alias("target")))


@query("SELECT * FROM text_chain", *TC)
def source_chain_text(spark, sf):
    return chain.source_chain_text(_stored_provenance(spark, sf))


WHY = "CASE WHEN j.job_id IS NULL THEN 'job has no provenance' WHEN p.job_id IS NULL THEN '{}' END AS reason, t.leaf_sheet, t.leaf_coord, t.leaf_id, t.is_missing"
HELD = "LEFT JOIN (SELECT DISTINCT job_id FROM prov) j ON j.job_id = q.job_id LEFT JOIN text_chain t ON t.job_id = p.job_id AND t.sheet = p.sheet AND t.coord = p.coord"


@query(f"""SELECT q.job_id, q.sheet, q.coord, p.job_id IS NOT NULL AS is_found, {WHY.format('no record of this cell')} FROM (SELECT job_id, 'Reconciliation' AS sheet, unnest(['B5', 'Z99']) AS coord FROM fx_jobs) q
LEFT JOIN prov p ON p.job_id = q.job_id AND p.sheet = q.sheet AND p.coord = q.coord {HELD}""", *TC, JOBS)
def source_chain_text_of(spark, sf):
    prov = _stored_provenance(spark, sf)
    refs = _jobs(spark, sf).select("job_id", F.lit(" Reconciliation ").alias("sheet"), F.explode(F.array(F.lit("b5"), F.lit("Z99 "))).alias("coord"))
    return chain.chain_of_cells(refs, prov, chain.source_chain_text(prov))


@query(f"""SELECT q.job_id, q.id, p.sheet, p.coord, p.job_id IS NOT NULL AS is_found, {WHY.format('no record of this id')} FROM (SELECT job_id, unnest(['urn:provenance:' || job_id || ':Reconciliation:B4', 'urn:provenance:' || job_id || ':Model:B1']) AS id FROM fx_jobs) q
LEFT JOIN prov p ON p.job_id = q.job_id AND q.id = 'urn:provenance:' || p.job_id || ':' || p.sheet || ':' || p.coord {HELD}""", *TC, JOBS)
def source_chain_by_id(spark, sf):
    prov = _stored_provenance(spark, sf)
    ids = F.array(F.concat(F.lit("urn:provenance:"), "job_id", F.lit(":Reconciliation:B4 ")), F.concat(F.lit("urn:provenance:"), "job_id", F.lit(":Model:B1")))
    return chain.chain_of_ids(_jobs(spark, sf).select("job_id", F.explode(ids).alias("id")), prov, chain.source_chain_text(prov))


@query("""SELECT c.job_id, c.sheet, c.coord, 'urn:provenance:' || c.job_id || ':' || c.sheet || ':' || c.coord AS id, 'http://host/models/' || c.job_id || '/provenance/' || c.sheet || '/' || c.coord AS link,
CASE WHEN c.kind = 'leaf' THEN format(E'[Provenance]\nLabel: {}\nValue: {}\nSource: {} (p. {})\nBBox [0-1000]: [{:.1f}, {:.1f}, {:.1f}, {:.1f}]\nID: ', c.group_label, coalesce(i.value, ''), i.source_file, i.page, i.x0::DOUBLE, i.y0::DOUBLE, i.x1::DOUBLE, i.y1::DOUBLE)
ELSE E'[Provenance - Calculated]\nMetric: ' || CASE c.kind WHEN 'root' THEN 'Adjusted EBITDA' ELSE 'Total ' || c.group_label END || E'\nFormula: ' || c.content || E'\nID: ' END || 'urn:provenance:' || c.job_id || ':' || c.sheet || ':' || c.coord AS comment
FROM cells_ c LEFT JOIN rows_ i ON i.job_id = c.job_id AND c.kind = 'leaf' AND 'leaf_' || i.record_index || '_' || """ + _slug("i.leaf_label") + " = c.node_id", *R2)
def provenance_text(spark, sf):
    return r.provenance_text(_model(spark, sf), "http://host")


# ---- tree and model
@query("""SELECT job_id, record_index, coalesce(nullif(trim(normalized_label), ''), nullif(trim(label), '')) AS leaf_label, band = 'manual_required' AS is_hardcode, CASE WHEN x1 > 1000 OR y1 > 1000 THEN 'box is incomplete or outside the page' END AS reason
FROM rv WHERE (status IN ('locked', 'auto_accepted') OR (status = 'needs_review' AND trim(coalesce(normalized_label, '')) <> '')) AND coalesce(nullif(trim(normalized_label), ''), nullif(trim(label), '')) IS NOT NULL""", *RVS)
def formula_inputs_review(spark, sf):
    return r.formula_inputs_review(_review(spark, sf)).select("job_id", "record_index", "leaf_label", "is_hardcode", "reason")


@query(f"""SELECT o_orderkey::STRING AS job_id, t.total, o_totalprice::DOUBLE AS expected_total, coalesce(abs(t.total - o_totalprice::DOUBLE) <= 50000, false) AS ties FROM orders LEFT JOIN (
SELECT job_id, coalesce(sum(CASE WHEN lower(leaf_label) <> lower('{METRIC}') THEN {_num('value')}::DECIMAL(28,4) END)::DOUBLE, 0) AS total FROM inputs WHERE reason IS NULL GROUP BY 1) t ON t.job_id = o_orderkey::STRING""", *R0)
def reconciliation_tie_out(spark, sf):
    expected = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("job_id"), F.col("o_totalprice").cast("double").alias("expected_total"))
    return r.reconciliation_tie_out(_inputs(spark, sf), expected, METRIC, 50_000)


@query(f"SELECT job_id, bool_or(kind = 'root') AS success, count(*) AS cells, count(*) FILTER (sheet <> 'Source_Inputs') AS formulas, count(*) FILTER (sheet = 'Source_Inputs') AS sources, count(*) FILTER (sheet = 'Source_Inputs' AND {_num('content')} IS NULL) AS unparsed FROM cells_ GROUP BY 1", *R2)
def generation_result(spark, sf):
    return r.generation_result(_model(spark, sf))


@query("""SELECT job_id, reason IS NULL AS ready, reason FROM (SELECT j.job_id, CASE WHEN n.job_id IS NULL THEN 'no confirmed items' WHEN target_metric <> 'Adjusted EBITDA' THEN 'metric is not supported' END AS reason
FROM fx_jobs j LEFT JOIN (SELECT DISTINCT job_id FROM inputs WHERE reason IS NULL) n ON n.job_id = j.job_id)""", *R0, JOBS)
def model_readiness(spark, sf):
    return a.model_readiness(_jobs(spark, sf), _inputs(spark, sf))


# ---- audit trail
@query("SELECT job_id, sheet, coord, node_id FROM cells_ WHERE sheet = 'Reconciliation' AND coord = 'B3' AND job_id IN (SELECT job_id FROM fx_jobs)", *R2, JOBS)
def provenance_scan(spark, sf):
    refs = _jobs(spark, sf).select("job_id", F.lit(" Reconciliation").alias("sheet"), F.lit("b3 ").alias("coord"))
    return a.provenance_scan(_provenance(spark, sf), refs).select("job_id", "sheet", "coord", "node_id")


@query("""SELECT job_id, node_id AS leaf_id, sheet, coord FROM prov WHERE starts_with(node_id, 'leaf_')
QUALIFY row_number() OVER (PARTITION BY job_id, node_id ORDER BY (sheet = 'Source_Inputs')::INT DESC, CASE WHEN sheet = 'Source_Inputs' THEN seq ELSE -seq END DESC) = 1""", *P0)
def chain_leaf_pick(spark, sf):
    return a.chain_leaf_pick(_provenance(spark, sf).withColumn("seq", F.substring("coord", 2, 9).cast("int")))


@query("SELECT job_id, sheet, coord, leaf_id, review_status, value, label FROM enr", *CH)
def chain_review_enrich(spark, sf):
    cells, review = _trail(spark, sf)
    return a.chain_review_enrich(r.source_chain(cells), review)


@query("""SELECT job_id, sheet, coord, CASE WHEN n = 0 THEN 'in_review' WHEN missing > 0 THEN 'has_missing' WHEN flagged > 0 THEN 'contains_flagged' WHEN locked = n THEN 'all_locked' ELSE 'in_review' END AS state, n, locked FROM (
SELECT k.job_id, k.sheet, k.coord, count(h.leaf_id) AS n, count(*) FILTER (review_status = 'locked') AS locked, count(*) FILTER (review_status = 'source_record_missing') AS missing, count(*) FILTER (review_status = 'flagged') AS flagged
FROM cells_ k LEFT JOIN enr h ON h.job_id = k.job_id AND h.sheet = k.sheet AND h.coord = k.coord GROUP BY 1, 2, 3)""", *CH)
def chain_rollup(spark, sf):
    cells, review = _trail(spark, sf)
    return a.chain_rollup(cells, a.chain_review_enrich(r.source_chain(cells), review))


@query("""SELECT h.job_id, h.sheet, h.coord, h.leaf_id, g.seq IS NULL AS is_gap, CASE WHEN g.seq IS NULL THEN 'source_record_missing' ELSE review_status END AS review_status, CASE WHEN g.seq IS NULL THEN '[missing]' ELSE h.value END AS value,
  CASE WHEN g.seq IS NULL THEN '[missing]' ELSE h.label END AS label, coalesce(i.source_file, 'unknown') AS source_file, coalesce(i.page, 1) AS page, coalesce(i.x0, 0) AS x0, coalesce(i.y1, 0) AS y1
FROM enr h LEFT JOIN nodes g ON g.job_id = h.job_id AND g.node_id = h.leaf_id AND g.kind = 'leaf' AND g.seq % 9 <> 3 LEFT JOIN inputs i ON i.job_id = g.job_id AND i.record_index = g.seq""", *CH)
def chain_components(spark, sf):
    cells, review = _trail(spark, sf)
    known = F.regexp_extract("node_id", r"^leaf_(\d+)_", 1).cast("int") % 9 != 3
    leaves = cells.where((F.col("sheet") == "Source_Inputs") & known).select("job_id", F.col("node_id").alias("leaf_id"), "source.*")
    out = a.chain_components(r.source_chain(cells), leaves, review)
    return out.select("job_id", "sheet", "coord", "leaf_id", "is_gap", "review_status", "value", "label", "source_file", "page", "x0", "y1")


@query("SELECT job_id, sheet, coord, node_id, is_formula FROM (SELECT *, bool_or(is_formula) OVER (PARTITION BY job_id) AS derived FROM prov) WHERE is_formula OR NOT derived", *P0)
def reconciliation_summary(spark, sf):
    return a.reconciliation_summary(_provenance(spark, sf)).select("job_id", "sheet", "coord", "node_id", "is_formula")


@query("""SELECT k.job_id, k.sheet, k.coord, k.node_id, coalesce(h.parts, '') AS components FROM cells_ k LEFT JOIN (
SELECT job_id, sheet, coord, string_agg(leaf_id || ':' || review_status, ',' ORDER BY leaf_id, review_status) AS parts FROM enr GROUP BY 1, 2, 3) h ON h.job_id = k.job_id AND h.sheet = k.sheet AND h.coord = k.coord""", *CH)
def provenance_matrix(spark, sf):
    parts = F.array_join(F.transform("components", lambda x: F.concat(x["leaf_id"], F.lit(":"), x["review_status"])), ",")
    cells, review = _trail(spark, sf)
    return a.provenance_matrix(r.provenance_build(cells), a.chain_review_enrich(r.source_chain(cells), review)).select("job_id", "sheet", "coord", "node_id", parts.alias("components"))


@query("""SELECT * FROM (SELECT i.id AS item_id, CASE WHEN s.status = 'extraction_error' OR i.status = 'extraction_error' THEN 'extraction_error_recovery' WHEN i.status = 'manual_required' THEN 'manual_required_entry' WHEN i.value <> s.value OR i.label <> s.label THEN 'user_edit' END AS override_type,
s.value AS original_value, i.value AS final_value, s.label AS original_label, i.label AS final_label, i.status AS review_status, s.flags, coalesce(i.band, s.band) AS band, CASE WHEN s.status = 'extraction_error' THEN 'cell could not be parsed' END AS error_detail, i.job_id || '.pdf' AS source_file, i.page, i.x0, i.y0, i.x1, i.y1, false AS is_hardcode FROM rv i LEFT JOIN scored s ON s.job_id = i.job_id AND s.record_index = i.record_index) WHERE override_type IS NOT NULL
UNION ALL SELECT sheet || '!' || coord, 'manual_hardcode', NULL, content, NULL, 'hardcode_' || node_id, 'manual_hardcode', 'manual_hardcode', 'manual_required', 'Manual hardcode per NFR2', i.source_file, i.page, i.x0, i.y0, i.x1, i.y1, true
FROM cells_ c JOIN rows_ i ON i.job_id = c.job_id AND 'leaf_' || i.record_index || '_' || """ + _slug("i.leaf_label") + " = c.node_id WHERE sheet = 'Reconciliation' AND kind = 'leaf' AND coord = 'B4'", *R2, REVIEW, RV)
def manual_overrides(spark, sf):
    rows = _records(spark, sf)
    typed = r.provenance_build(_model_of(spark, sf, rows)).where("sheet = 'Reconciliation' and kind_ = 'leaf' and coord = 'B4'").withColumn("node_id", F.concat(F.lit("hardcode_"), "node_id"))
    out = a.manual_overrides(_review_of(rows), rows.withColumn("error_detail", F.when(F.col("status") == "extraction_error", "cell could not be parsed")), typed)
    return out.withColumn("flags", F.array_join("flags", ","))


@query("""SELECT job_id, CASE WHEN bad THEN 0 ELSE calls END AS calls, CASE WHEN bad THEN 0 ELSE matched END AS matched, CASE WHEN bad THEN 0 ELSE errors END AS errors, CASE WHEN bad THEN 0 ELSE calls - matched - errors END AS pending, bad OR free AS numeric_free FROM (
SELECT job_id, bool_or(bad) AS bad, count(*) AS calls, count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit AND lost) AS errors, bool_and(NOT num) AS free FROM (
SELECT job_id, NOT ok AS bad, coalesce(json_extract_string(j, '$.taxonomy_status') = 'matched' OR json_extract_string(j, '$.resulting_state') = 'confirmed', false) AS hit, coalesce(json_extract_string(j, '$.resulting_state') = 'classification_error', false) AS lost,
  coalesce(json_type(j, '$.raw_response.ok') = 'BOOLEAN' OR json_type(j, '$.raw_response.sum') = 'DOUBLE', false) AS num
FROM (SELECT job_id, json_valid(line) AS ok, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM fx_log WHERE trim(line) <> '')) GROUP BY 1)""", LOG)
def classifier_governance(spark, sf):
    return a.classifier_governance(fixture(spark, sf, "fx_log"))


@query("""SELECT job_id, CASE WHEN is_baseline IS NOT NULL THEN year END AS year, is_baseline IS NOT NULL AS is_evaluated, CASE WHEN is_baseline IS NULL THEN 'Drift detection not recorded for metric ''' || target_metric || '''.'
WHEN is_baseline THEN 'Baseline Year — Initialized definition for ' || target_metric || '; no prior-year comparison available.' WHEN changed THEN 'Metric Redefinition Detected: ' || n_added || ' component(s) added, ' || n_removed || ' removed year-over-year.'
ELSE 'Metric Continuation — Definition for ' || target_metric || ' unchanged.' END AS summary FROM dj""", *DJS)
def drift_summary(spark, sf):
    return a.drift_summary(_jobs(spark, sf), _drift(spark, sf))


@query("SELECT job_id, entity, target_metric AS metric, year, CASE WHEN is_baseline IS NULL THEN 'skipped_no_locked_records' ELSE 'evaluated' END AS state, coalesce(NOT is_baseline AND changed, false)::INT AS flags FROM dj", *DJS)
def drift_job_status(spark, sf):
    return a.drift_job_status(_jobs(spark, sf), _drift(spark, sf))


@query("""SELECT d.job_id, d.entity, d.year, coalesce(w.au, k.n, 0) AS automated, coalesce(w.ve, 0) AS verified, coalesce(w.fl, 0) AS flagged FROM dj d
LEFT JOIN (SELECT job_id, count(*) FILTER (status = 'auto_accepted') AS au, count(*) FILTER (status = 'locked') AS ve, count(*) FILTER (status = 'flagged') AS fl FROM rv GROUP BY 1) w ON w.job_id = d.job_id
LEFT JOIN (SELECT job_id, count(*) AS n FROM cells_ GROUP BY 1) k ON k.job_id = d.job_id""", *R2, REVIEW, RV, *DJS)
def report_metadata(spark, sf):
    rows = _records(spark, sf)
    return a.report_metadata(_jobs(spark, sf), _review_of(rows), _model_of(spark, sf, rows), _drift(spark, sf))


@query("""SELECT q.job_id, CASE WHEN j.job_id IS NULL THEN 'job_not_found' WHEN q.job_id IN (SELECT job_id FROM cells_) THEN 'ready' WHEN q.job_id IN (SELECT job_id FROM rv) THEN 'build_on_demand' WHEN q.job_id IN (SELECT job_id FROM norm WHERE record_index > 2) THEN 'build_from_classified' ELSE 'model_not_complete' END AS state
FROM (SELECT job_id FROM fx_jobs UNION ALL SELECT 'x' || c_custkey FROM customer) q LEFT JOIN fx_jobs j ON j.job_id = q.job_id""", *R2, REVIEW, RV, JOBS)
def audit_eligibility(spark, sf):
    asked = _jobs(spark, sf).select("job_id").union(spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))))
    return a.audit_eligibility(asked, _jobs(spark, sf), _model(spark, sf), _review(spark, sf), normalized(spark, sf).where("record_index > 2"))


# ---- report
@query("SELECT count(*) AS runs, count(*) FILTER (success) AS succeeded, sum(extraction + classification + generation)::DOUBLE AS total_seconds, round_even(sum(extraction + classification + generation) / count(*)::DOUBLE, 4) AS mean_seconds, bool_and(extraction + classification + generation <= 300) AS within_budget FROM fx_runs", RUNS)
def runtime_metrics(spark, sf):
    return p.runtime_metrics(fixture(spark, sf, "fx_runs"))


@query("SELECT job_id, CASE WHEN NOT success THEN CASE WHEN extraction = 0 THEN 'extraction' WHEN classification = 0 THEN 'classification' WHEN generation = 0 THEN 'generation' ELSE 'unknown' END END AS failed_at FROM fx_runs", RUNS)
def failing_stage(spark, sf):
    return p.failing_stage(fixture(spark, sf, "fx_runs")).select("job_id", "failed_at")


@query("SELECT f = 0 AS passed, f = 0 AND acc >= 90 AND ff = 0 AS passed_strict FROM (SELECT count(*) FILTER (NOT success) AS f FROM fx_runs), (SELECT round_even(sum(tp) * 100 / sum(gt_total)::DOUBLE, 2) AS acc, count(*) FILTER (is_failed) AS ff FROM fm)", *E3)
def strict_gate(spark, sf):
    return p.strict_gate(QUERIES["corpus_metrics"](spark, sf), fixture(spark, sf, "fx_runs"))


@query("""SELECT 'Measured on ' || f || ' filings with ' || n || ' items; ' || k || ' (' || format('{:.2f}', round_even(k * 100 / n::DOUBLE, 2)) || '%) need review.' AS disclosure
FROM (SELECT count(*) AS f FROM fx_jobs), (SELECT count(*) AS n, count(*) FILTER (score < 0.95) AS k FROM scored)""", *S, JOBS)
def governance_disclosure(spark, sf):
    return p.governance_disclosure(scored(spark, sf), _jobs(spark, sf))


@query("SELECT job_id, record_index, value FROM fx_line_items WHERE job_id IN (SELECT job_id FROM fx_jobs WHERE status = 'done')", ITEMS, JOBS)
def filing_filter(spark, sf):
    return p.filing_filter(items(spark, sf), _jobs(spark, sf).where("status = 'done'"))[0].select("job_id", "record_index", "value")


@query(f"""SELECT job_id, rule, count(*) AS n FROM (
SELECT 'x' || c_custkey AS job_id, 'folder_missing' AS rule FROM customer
UNION ALL SELECT o_orderkey::STRING, 'page_count_differs' FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT job_id, 'schema_breach' FROM fx_line_items WHERE (partkey % 37 = 0 OR x1 > 1000 OR y1 > 1000) AND job_id IN (SELECT o_orderkey::STRING FROM orders)
UNION ALL SELECT job_id, 'page_beyond_end' FROM fx_line_items WHERE NOT (partkey % 37 = 0 OR x1 > 1000 OR y1 > 1000) AND page > 1 + job_id::BIGINT % 3 AND job_id IN (SELECT o_orderkey::STRING FROM orders)
UNION ALL SELECT job_id, 'value_not_numeric' FROM fx_line_items WHERE NOT (partkey % 37 = 0 OR x1 > 1000 OR y1 > 1000) AND partkey % 31 = 0 AND job_id IN (SELECT o_orderkey::STRING FROM orders)) GROUP BY 1, 2""", ITEMS)
def corpus_validation(spark, sf):
    key = F.col("o_orderkey")
    pages = (1 + key % 3).cast("int")
    filings = spark.read.parquet(f"{sf}/orders.parquet").select(key.cast("string").alias("job_id"), pages.alias("page_count"), (pages + (key % 10 == 0).cast("int")).alias("actual_pages"))
    manifest = filings.select("job_id").union(spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string"))))
    rows = items(spark, sf).withColumn("value", F.when(F.col("partkey") % 31 == 0, F.concat("value", F.lit(" n/m"))).otherwise(F.col("value")))
    rows = rows.withColumns({"page": F.when(F.col("partkey") % 37 == 0, 0).otherwise(F.col("page")), "normalized_label": F.col("p_type")})
    return p.corpus_validation(rows, filings, manifest)


@query("""SELECT m.metric, CASE m.metric WHEN 'accuracy' THEN accuracy WHEN 'macro_precision' THEN mp WHEN 'macro_recall' THEN mr WHEN 'macro_f1' THEN mf WHEN 'micro_precision' THEN p WHEN 'micro_recall' THEN r
ELSE CASE WHEN p + r > 0 THEN round_even(2 * p * r / (p + r), 4) ELSE 0 END END::DOUBLE AS figure FROM (
SELECT round_even(sum(tp) * 100 / sum(gt_total)::DOUBLE, 2) AS accuracy, round_even(avg(precision), 4) AS mp, round_even(avg(recall), 4) AS mr, round_even(avg(f1), 4) AS mf, round_even(sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 4) AS p, round_even(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 4) AS r FROM fm),
(VALUES ('accuracy'), ('macro_precision'), ('macro_recall'), ('macro_f1'), ('micro_precision'), ('micro_recall'), ('micro_f1')) m(metric)""", *E3)
def report_tables(spark, sf):
    return _report(spark, sf)["headline"]


def _report(spark, sf):
    diffs = _scored_diffs(spark, sf)
    filings = e.filing_metrics(diffs, _runs(spark, sf))
    return p.report_tables(e.corpus_metrics(filings), filings, diffs.drop("score"), e.failure_pattern_counts(diffs))


@query("SELECT l.layer, CASE l.layer WHEN 'extraction' THEN x WHEN 'classification' THEN c ELSE g END AS errors FROM (SELECT sum(extraction_errors)::BIGINT AS x, sum(classification_errors)::BIGINT AS c, sum(generation_errors)::BIGINT AS g FROM fm), (VALUES ('extraction'), ('classification'), ('generation')) l(layer)", *E3)
def report_layers(spark, sf):
    return _report(spark, sf)["layers"]


@query("SELECT job_id, accuracy, not_auto_percent, is_failed FROM fm WHERE is_failed OR NOT on_target", *E3)
def report_failed_filings(spark, sf):
    return _report(spark, sf)["failed_filings"].select("job_id", "accuracy", "not_auto_percent", "is_failed")


@query("SELECT job_id, page, n FROM (SELECT job_id, page, count(*) AS n FROM (SELECT job_id, page FROM gt UNION ALL SELECT job_id, page FROM ext) GROUP BY 1, 2) WHERE n > 5", *E1[:3])
def oversized_pages(spark, sf):
    return e.large_pages(*_sides(spark, sf), 5)


# ---- the whole chain
@query("""SELECT j.job_id, coalesce(s.total, 0) AS total, coalesce(s.errors, 0) AS errors, coalesce(i.n, 0) AS inputs, coalesce(k.n, 0) AS cells, CASE WHEN i.n IS NULL THEN 'no confirmed items' WHEN j.target_metric <> 'Adjusted EBITDA' THEN 'metric is not supported' END AS reason
FROM fx_jobs j LEFT JOIN (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'extraction_error') AS errors FROM scored GROUP BY 1) s ON s.job_id = j.job_id
LEFT JOIN (SELECT job_id, count(*) AS n FROM inputs WHERE reason IS NULL GROUP BY 1) i ON i.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS n FROM cells_ GROUP BY 1) k ON k.job_id = j.job_id""", *R2, JOBS)
def batch_job_summary(spark, sf):
    """Score, classify, normalize, build the tree and the model of every filing in one plan; a bad row fails itself alone."""
    records = _records(spark, sf)
    inputs = r.formula_inputs(_confirmed(records))
    n = inputs.where("reason is null").groupBy("job_id").agg(F.count(F.lit(1)).alias("inputs"))
    built = r.generation_result(r.model_cells(r.formula_nodes(inputs))).select("job_id", "cells")
    rows = records.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "extraction_error").alias("errors"))
    out = a.model_readiness(_jobs(spark, sf), inputs)
    for part in (rows, n, built):
        out = out.join(part, "job_id", "left")
    return out.fillna(0, ["total", "errors", "inputs", "cells"]).select("job_id", "total", "errors", "inputs", "cells", "reason")


# ---- filings from their cells
#: One table a job, two cells a row: the first row and column are headers. Some cells are malformed, some pages have no size.
FILED = f"""grid2 AS (SELECT *, job_id || '.pdf' AS source_file, 0 AS table_idx, record_index AS cell_idx, record_index // 2 AS start_row, record_index % 2 AS start_col, record_index % 2 = 0 AS is_row_header, record_index < 2 AS is_col_header,
  CASE WHEN record_index % 2 = 0 OR record_index < 2 THEN label WHEN partkey % 19 <> 0 THEN value END AS text, suppkey % 23 = 0 AND record_index >= 2 AND record_index % 2 = 1 AS bad_row FROM fx_line_items),
path2 AS (SELECT g.* EXCLUDE (label, value, table_name, page, is_error), r.label || ' / ' || h.label AS path, h.table_name, coalesce(CASE WHEN g.partkey % 3 <> 0 THEN g.page END, CASE WHEN g.suppkey % 4 <> 0 THEN 7 END, 1) AS page, bad_row OR text IS NULL AS bad_cell
  FROM grid2 g JOIN fx_line_items r ON r.job_id = g.job_id AND r.record_index = g.record_index - 1 JOIN (SELECT job_id, max(label) FILTER (record_index = 1) AS label, max(table_name) FILTER (record_index = 0) AS table_name FROM fx_line_items GROUP BY 1) h ON h.job_id = g.job_id WHERE NOT is_row_header AND NOT is_col_header),
box2 AS (SELECT * EXCLUDE (x0, y0, x1, y1), {", ".join(f"CASE WHEN bad_cell THEN 0 WHEN partkey % 5 <> 0 THEN {b} WHEN suppkey % 2 = 0 THEN {b} + 1 WHEN partkey % 7 <> 0 THEN {b} + 2 ELSE 0 END::DOUBLE AS {b}" for b in c.BOX)},
  page < 4 AND job_id::BIGINT % 10 <> 0 AS sized FROM path2),
filed AS (SELECT * EXCLUDE (x0, y0, x1, y1, record_index), (row_number() OVER (PARTITION BY job_id ORDER BY page, y0, x0, cell_idx) - 1)::INT AS record_index, coalesce(text, '') AS value, CASE WHEN bad_cell THEN 'Error / Unparsed Cell' ELSE path END AS label, bad_cell OR NOT sized AS is_error,
  {", ".join(f"CASE WHEN sized AND NOT bad_cell THEN round_even(greatest(0, least(1000, {b} / {612.0 if b[0] == 'x' else 792.0} * 1000)), 2) ELSE 0 END AS {b}" for b in c.BOX)} FROM box2)"""
OF_FILED = [x.replace("FROM fx_line_items)", "FROM filed)") for x in S[1:]]
RESP2 = f"resp AS (SELECT job_id, record_index, CASE {_DICT} ELSE trim(label) END AS resp_label, false AS is_error FROM scored WHERE status = 'ok' AND band <> 'manual_required')"
TAGGED = """tagged AS (SELECT job_id, record_index, cell_idx, value, label, page, x0, y0, x1, y1, table_name, is_candidate, score, band, flags, status, normalized_label, taxonomy_status, CASE WHEN is_error THEN 'error' ELSE 'item' END AS outcome,
  CASE WHEN bad_cell THEN 'cells' WHEN is_error THEN 'boxes' END AS stage, CASE WHEN bad_cell THEN 'cell could not be parsed' WHEN is_error THEN 'page has no size' END AS reason FROM norm)"""
FILINGS = (ITEMS, FILED, *OF_FILED, TAX, RESP2, *N[-2:], TAGGED)
_COLUMNS = ["job_id", "record_index", "cell_idx", "value", "label", "page", *c.BOX, "table_name", "is_candidate", "score", "band", "flags", "status", "normalized_label", "taxonomy_status", "outcome", "stage", "reason"]


def _filing_cells(spark, sf):
    """Cells of all filings, and on each table's first one its caption; read once from the given tables and stored, for their tables and pages are read from them, too."""
    k, s, i = F.col("partkey"), F.col("suppkey"), F.col("record_index")
    head = (i % 2 == 0) | (i < 2)
    rows = items(spark, sf).withColumns({"page_cell": F.when(k % 3 != 0, F.col("page")), "page_table": F.when(s % 4 != 0, F.lit(7)), "bbox_cell": _box(k % 5 != 0, 0), "bbox_prov": _box(s % 2 == 0, 1), "bbox_table": _box(k % 7 != 0, 2)})
    return stored(rows.select(
        "job_id", F.concat("job_id", F.lit(".pdf")).alias("source_file"), F.lit(0).alias("table_idx"), i.alias("cell_idx"), F.when(head, F.col("label")).when(k % 19 != 0, F.col("value")).alias("text"),
        F.when((s % 23 == 0) & ~head, "row x").otherwise(F.floor(i / 2).cast("string")).alias("start_row"), (i % 2).cast("string").alias("start_col"), (i % 2 == 0).alias("is_row_header"), (i < 2).alias("is_col_header"),
        "page_cell", "page_table", "bbox_cell", "bbox_prov", "bbox_table", F.when(i == 0, F.col("table_name")).alias("caption"),
    ))


def _filing_rows(spark, sf, cells):
    """Of cells that _filing_cells() made, or some of them."""
    first = cells.where("cell_idx = 0")
    tables = first.select("source_file", "table_idx", "caption", F.lit(None).cast("string").alias("label"))
    pages = F.explode(F.array(*[F.lit(p) for p in (1, 2, 3)])).alias("page")
    dims = first.where("cast(job_id as bigint) % 10 <> 0").select("source_file", pages, F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return filing.filing_rows(cells.drop("caption"), dims, stored(fixture(spark, sf, "fx_taxonomy")), tables=tables)


@query("SELECT * FROM tagged", *FILINGS)
def batch_score_pipeline(spark, sf):
    """All filings from their cells to normalized records, written once by outcome; items and errors as they are read back."""
    rows, good = _filing_rows(spark, sf, _filing_cells(spark, sf)), [F.array_join("flags", ",").alias(x) if x == "flags" else x for x in _COLUMNS]
    found, errors = filing.write_filing_rows(rows, f"{scratch_dir(spark)}/tallyspan-{uuid.uuid4().hex}")
    return found.union(errors).select(good)


@query("""SELECT j.job_id, CASE WHEN coalesce(n, 0) = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN k IS NULL THEN 'no records' WHEN n = 0 THEN first END AS reason, coalesce(n, 0) AS items, coalesce(k - n, 0) AS errors FROM fx_jobs j LEFT JOIN (
SELECT job_id, count(*) AS k, count(*) FILTER (outcome = 'item') AS n, arg_min(reason, record_index) FILTER (outcome = 'error') AS first FROM tagged GROUP BY 1) t USING (job_id)""", *FILINGS, JOBS)
def filing_states(spark, sf):
    return filing.filing_states(_jobs(spark, sf), _filing_rows(spark, sf, _filing_cells(spark, sf)))
