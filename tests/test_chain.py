"""Chains from formula text: depth, ranges, sheets, cycles, gaps, and what stands for silent totals."""

from pyspark.sql import functions as F

from tallyspan.operators import audit, chain, reconcile
from tallyspan.plans import audit_queries

ROW = "job_id string, sheet string, coord string, node_id string, is_formula boolean, text string, place string"


def prov(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    return df.select("job_id", "sheet", "coord", "node_id", "is_formula", F.struct(F.col("text").alias("value")).alias("body"), F.struct(F.struct(F.col("place").alias("value")).alias("selector")).alias("target"))


INPUTS = [("j", "Source_Inputs", f"B{k}", f"leaf_{k}_{s}", False, t, "p") for k, s, t in ((2, "tax", "=B9"), (3, "sbc", "5"), (4, "sbc", "6"), (5, "net_sbc", "7"))]


def test_closure_of_any_depth(spark):
    deep = [("j", "Deep", f"C{k}", f"calc_{k}", True, f"=C{k + 1}*2", None) for k in range(1, 40)] + [("j", "Deep", "C40", "calc_40", True, "=SUM(Source_Inputs!$B$3:B4, 'Source_Inputs'!B2) + 10 & \"B5\"", None)]
    rows = INPUTS + deep + [
        ("j", "Reconciliation", "B3", "leaf_2_tax", True, "=Source_Inputs!B2", "p"),
        ("j", "Reconciliation", "B4", "agg_sbc", True, "=deep!C1+b3+Deep!C40", None),
        ("j", "Loop", "A1", "x", True, "=B1+Source_Inputs!B5", None), ("j", "Loop", "B1", "y", True, "=A1+Loop!ZZ100", None),
        ("j", "Ids", "A1", "agg_z", True, "leaf_3_sbc + leaf_9_gone", None),
        ("k", "Reconciliation", "B4", "agg_sbc", True, "=Deep!C1", None),
    ]
    rows += [("j", "deep", "C1", "calc", True, "=Source_Inputs!B4", None)]  # another sheet: names of sheets keep their case
    got = {}
    for r in chain.source_chain_text(prov(spark, rows)).collect():
        assert (r.leaf_id is None or r.leaf_sheet is None) == r.is_missing
        got.setdefault((r.job_id, r.sheet, r.coord), []).append((r.leaf_sheet, r.leaf_coord, r.leaf_id))
    three = sorted(("Source_Inputs", f"B{k}", f"leaf_{k}_{s}") for k, s in ((2, "tax"), (3, "sbc"), (4, "sbc")))
    assert all(sorted(got["j", "Deep", f"C{k}"]) == three for k in (1, 2, 39, 40))
    assert sorted(got["j", "Reconciliation", "B4"]) == three and got["j", "Reconciliation", "B3"] == [three[0]]
    assert all(got["j", "Source_Inputs", c] == [("Source_Inputs", c, i)] for _, _, c, i, *_ in INPUTS)
    both = {("Source_Inputs", "B5", "leaf_5_net_sbc"), ("Loop", "ZZ100", None)}
    assert set(got["j", "Loop", "A1"]) == both == set(got["j", "Loop", "B1"])
    assert set(got["j", "Ids", "A1"]) == {("Source_Inputs", "B3", "leaf_3_sbc"), (None, None, "leaf_9_gone")}
    assert got["k", "Reconciliation", "B4"] == [("Deep", "C1", None)]


def test_silent_totals(spark):
    rows = INPUTS + [("j", "Reconciliation", "B6", "agg_sbc", True, "Total", None), ("j", "Reconciliation", "B7", "root_x", True, "All", None), ("j", "Reconciliation", "B8", "note", True, "words", "p"), ("j", "Reconciliation", "B9", "bare", True, None, None)]
    got = {}
    for r in chain.source_chain_text(prov(spark, rows)).collect():
        got.setdefault(r.coord if r.sheet == "Reconciliation" else None, set()).add(r.leaf_id)
    assert got["B6"] == {"leaf_3_sbc", "leaf_4_sbc", "leaf_5_net_sbc"} and got["B7"] == {i for *_, i, _, _, _ in INPUTS} and got["B8"] == {"note"} and "B9" not in got


def test_look_up_by_cell_and_id(spark):
    p = prov(spark, INPUTS + [("j", "Reconciliation", "B3", "leaf_2_tax", True, "=Source_Inputs!B2", "p")])
    c = chain.source_chain_text(p)
    refs = spark.createDataFrame([("j", " Reconciliation", "b3 "), ("j", "Reconciliation", "B99"), ("none", "Reconciliation", "B3")], "job_id string, sheet string, coord string")
    got = {(r.job_id, r.coord): (r.is_found, r.reason, r.leaf_id) for r in chain.chain_of_cells(refs, p, c).collect()}
    assert got == {("j", "B3"): (True, None, "leaf_2_tax"), ("j", "B99"): (False, chain.NO_CELL, None), ("none", "B3"): (False, chain.NO_JOB, None)}
    ids = spark.createDataFrame([("j", "urn:provenance:j:Reconciliation:B3 "), ("j", "urn:provenance:k:S:A1"), ("none", "x")], "job_id string, id string")
    got = {(r.job_id, r.id): (r.is_found, r.reason, r.sheet, r.coord, r.leaf_id) for r in chain.chain_of_ids(ids, p, c).collect()}
    assert got[("j", "urn:provenance:j:Reconciliation:B3")] == (True, None, "Reconciliation", "B3", "leaf_2_tax")
    assert got[("j", "urn:provenance:k:S:A1")][:2] == (False, chain.NO_ID) and got[("none", "x")][:2] == (False, chain.NO_JOB)


def test_first_record_of_a_place(spark):
    rows = [("j", "S", "B2", "leaf_9", 2), ("j", "S", "B2", "leaf_1", 7), ("j", "S", "B3", "leaf_2", 1)]
    p = spark.createDataFrame(rows, "job_id string, sheet string, coord string, node_id string, seq int")
    refs = spark.createDataFrame([("j", "\u00a0S\t", " b2"), ("j", "S", "B2")], "job_id string, sheet string, coord string")
    assert [r.node_id for r in audit.provenance_scan(p, refs).collect()] == ["leaf_9"]


def test_letters(spark):
    df = spark.createDataFrame([("A",), ("Z",), ("AA",), ("AZ",), ("BA",), ("ZZ",), ("AAA",), ("XFD",), ("ZZZ",)], "s string")
    assert all(r.s == r.t for r in df.select("s", chain._letters(chain._column_number(F.col("s"))).alias("t")).collect())


def test_a_model_of_many_leaves(spark):
    """300,000 leaves of one job, a third of one label: places and formulas as plain counting gives them."""
    n = 300_000
    label = lambda k: "Hot" if k % 3 == 0 else f"Pair {k // 6}" if k % 3 == 1 else f"One {k}"
    rows = spark.range(n).selectExpr(
        "'j' as job_id", "int(id) as record_index", "case id % 3 when 0 then 'Hot' when 1 then concat('Pair ', id div 6) else concat('One ', id) end as leaf_label", "1 as page", "string(id) as value", "cast(null as string) as reason"
    )
    groups: dict = {}
    for k in range(n):
        groups.setdefault(label(k), []).append(k)
    at, leaf_at, formulas, under_root = 3, {}, {}, []
    for name, members in groups.items():  # in order of first appearance
        for k in members:
            leaf_at[k] = f"B{at}"
            at += 1
        if len(members) > 1:
            formulas[f"B{at}"] = "=" + "+".join(leaf_at[k] for k in members)
            under_root.append(f"B{at}")
            at += 1
        else:
            under_root.append(leaf_at[members[0]])
    formulas[f"B{at}"] = "=" + "+".join(under_root)
    out = reconcile.model_cells(reconcile.formula_nodes(rows)).persist()
    got = {r.coord: r.content for r in out.where("sheet = 'Reconciliation' and kind <> 'leaf'").collect()}
    assert got == formulas
    inputs = {r.coord: r.content for r in out.where("sheet = 'Source_Inputs'").collect()}
    assert inputs == {f"B{k + 1}": str(k) for k in range(n)}
    links = {r.coord: r.content for r in out.where("sheet = 'Reconciliation' and kind = 'leaf'").collect()}
    assert links == {leaf_at[k]: f"=Source_Inputs!B{k + 1}" for k in range(n)}
    out.unpersist()


def test_places_by_range_equal_windows(spark):
    rows = spark.range(30_000).selectExpr("if(id % 10 = 3, 'k', 'j') as job_id", "int(id) as record_index", "if(id % 4 = 0, 'Hot', concat('L', id % 977)) as leaf_label", "1 as page", "string(id) as value", "cast(null as string) as reason")
    nodes = reconcile.formula_nodes(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = reconcile.model_cells(nodes, by_range=True)
        got, tables = sorted(map(str, out.collect())), out.inputFiles()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(map(str, reconcile.model_cells(nodes).collect()))
    assert len(tables) >= int(spark.conf.get("spark.sql.shuffle.partitions"))  # the last numbering's ranges, of one large job


def test_trails_have_few_exchanges(spark):
    for name in ("chain_rollup", "provenance_matrix", "chain_components"):
        plan = audit_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") < 20 and plan.count("FileScan") <= 8, name


def test_nodes_meet_in_as_many_tasks_as_asked(spark):
    """What one task sorts follows the number given, not that of the session; the nodes are the same."""
    rows = [(f"j{i % 9}", f"L{i % 4}", i, 1, "1", None) for i in range(60)]
    inputs = spark.createDataFrame(rows, "job_id string, leaf_label string, record_index int, page int, value string, reason string")
    few = reconcile.formula_nodes(inputs, tasks=3)
    assert sorted(map(repr, few.collect())) == sorted(map(repr, reconcile.formula_nodes(inputs).collect()))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert ", 3), REPARTITION_BY_NUM" in plan


def test_walks_equal_joins(spark):
    """Cells of any depth, cycles, ranges and places of several records, walked by job and joined: the same rows."""
    rows = []
    for j in range(3):
        for k in range(1, 16):
            to = [f"S{(k * 7 + i * j) % 3}!B{(k * (i + 3) + j) % 18}" for i in range((k + j) % 4)] + (["b2:C4"] if k % 9 == j % 9 else [])
            rows.append((f"j{j}", f"S{k % 3}", f"B{k}", f"n{k}", bool(to), "=" + "+".join(to) if to else "1", "p" if k % 2 else None))
        rows += [(f"j{j}", "S1", "B4", "twin", False, "1", "p"), (f"j{j}", "S1", "B7", "twin", True, "=B1+$B$1", "p")]
    p = prov(spark, rows)
    every = lambda df: sorted(map(repr, df.collect()))
    mixed = p.unionByName(prov(spark, INPUTS + [("j", "R", "B1", "agg_sbc", True, "leaf_3_sbc", None)]))
    assert every(chain.source_chain_text(mixed)) == every(chain.source_chain_text(mixed, most=0))


def test_text_chains_send_items_and_nothing_else(spark):
    for name, most in (("source_chain_text", 0), ("source_chain_text_of", 9), ("source_chain_by_id", 9)):
        plan = audit_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, name


def test_lists_by_job_equal_joins(spark):
    """Reviewed items and records of a job, handed on as lists or joined by key: the same rows, repeated ids and absent ones included."""
    cells = [(f"j{j}", "S", f"B{k}", f"leaf_{k % 7}_x") for j in range(4) for k in range(11 * (j % 3) + 2)] + [("none", "S", "B1", "leaf_0_x"), ("j1", "S", "B99", "odd")]
    link = spark.createDataFrame(cells, "job_id string, sheet string, coord string, leaf_id string")
    review = spark.createDataFrame([(f"j{j}_{k % 5}", f"j{j}", "locked", f"{k}", f"L{j}") for j in range(3) for k in range(6)], "id string, job_id string, status string, value string, label string")
    leaves = spark.createDataFrame([(f"j{j}", f"leaf_{k}_x", "f", k, 0.0, 0.0, 1.0, 1.0) for j in range(4) for k in range(1, 7)], "job_id string, leaf_id string, source_file string, page int, x0 double, y0 double, x1 double, y1 double")
    rows = [sorted(map(repr, audit.chain_components(link, leaves, review, most).collect())) for most in (0, 6, 256)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > len(cells)
    places = link.select("job_id", "sheet", "coord").union(spark.createDataFrame([("j0", None, "B1"), ("j0", "S", "B500")], "job_id string, sheet string, coord string"))
    parts = audit.chain_review_enrich(link, review)
    rows = [sorted(map(repr, audit.provenance_matrix(places, parts, most).collect())) for most in (0, 20, 256)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == len(cells) + 2


def test_trails_send_nothing_after_their_tables(spark):
    for name, most in (("chain_components", 0), ("chain_review_enrich", 0), ("provenance_matrix", 0)):
        plan = audit_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, name
