"""Confirmed items to a reconciliation tree, its totals, model cells and their provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.exprs import accounting_number, is_blank, slug, strip
from tallyspan.operators.numbering import numbered


def formula_input_errors(items: DataFrame) -> DataFrame:
    """+ reason: the first provenance rule that fails, null where all hold."""
    c = F.col
    inside = F.lit(True)
    for v in ("x0", "y0", "x1", "y1"):
        inside = inside & c(v).between(0, 1000)
    reason = (
        F.when(is_blank(c("source_file")), "source file is blank")
        .when(c("page").isNull() | (c("page") < 1), "page is below 1")
        .when(~F.coalesce(inside, F.lit(False)), "box is incomplete or outside the page")
        .when(c("x0") > c("x1"), "box is reversed in x")
        .when(c("y0") > c("y1"), "box is reversed in y")
    )
    return items.withColumn("reason", reason)


def formula_inputs(classified: DataFrame) -> DataFrame:
    """Items that enter the tree: routed past review or confirmed, with a label; + leaf_label, reason."""
    label = F.coalesce(F.nullif(strip(F.col("normalized_label")), F.lit("")), F.nullif(strip(F.col("label")), F.lit("")))
    kept = classified.where("band = 'auto_accepted' or is_confirmed").withColumn("leaf_label", label).where("leaf_label is not null")
    return formula_input_errors(kept)


def formula_input_counts(classified: DataFrame) -> DataFrame:
    """(job_id, received, confirmed, excluded): what becomes of each job's items."""
    enters = F.coalesce((F.col("band") == "auto_accepted") | F.col("is_confirmed"), F.lit(False)) & ~(is_blank(F.col("normalized_label")) & is_blank(F.col("label")))
    out = classified.groupBy("job_id").agg(F.count(F.lit(1)).alias("received"), F.count_if(enters).alias("confirmed"))
    return out.withColumn("excluded", F.col("received") - F.col("confirmed"))


#: what provenance_build() asks formula_nodes() to carry along with the leaves
SOURCE = ("source_file", "page", "x0", "y0", "x1", "y1")


def formula_nodes(inputs: DataFrame, metric: str = "Adjusted EBITDA", carry: tuple = (), tasks: int | None = None) -> DataFrame:
    """(job_id, node_id, parent_id, kind, label, group_label, seq, value, first) and, where columns of inputs are
    named in carry, source: these as a struct on leaves, null elsewhere. Nodes are leaves, aggregates of labels met twice, one root.

    Groups are by the exact label, in order of first appearance, whatever their ids: labels that differ in case
    or marks have one slug but are groups of their own. One exchange by job serves all windows; a row becomes
    its leaf, and the first of a group or job its aggregate or root as well. tasks, the exchange's number of tasks, should
    follow the number of inputs: what a task sorts then stays the same, however large the table is.
    """
    job, group = Window.partitionBy("job_id"), Window.partitionBy("job_id", "leaf_label")
    rows = inputs.where("reason is null").select("job_id", "leaf_label", "record_index", "page", "value", *([F.struct(*carry).alias("source")] if carry else []))
    rows = rows.repartition(tasks, "job_id") if tasks else rows
    rows = rows.withColumn("start", F.min("record_index").over(job)).withColumns({"n": F.count(F.lit(1)).over(group), "first": F.min("record_index").over(group)})
    rows = rows.withColumn("slug", slug(F.col("leaf_label")))
    many, index, none = F.col("n") >= 2, F.col("record_index"), F.lit(None).cast("string")
    root_id, agg_id = F.concat(F.lit("root_"), slug(F.lit(metric))), F.concat(F.lit("agg_"), "slug")

    def node(node_id, parent, kind, label, group_label, value, first):
        parts = {"node_id": node_id, "parent_id": parent, "kind": F.lit(kind), "label": label, "group_label": group_label, "seq": index, "value": value, "first": first}
        if carry:
            parts["source"] = F.when(F.lit(kind == "leaf"), F.col("source"))
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    leaf_id = F.concat(F.lit("leaf_"), index.cast("string"), F.lit("_"), "slug")
    leaf_label = F.when(many, F.concat("leaf_label", F.lit(" (p. "), F.col("page").cast("string"), F.lit(")"))).otherwise(F.col("leaf_label"))
    leaf = node(leaf_id, F.when(many, agg_id).otherwise(root_id), "leaf", leaf_label, F.col("leaf_label"), F.col("value"), F.col("first"))
    agg = node(agg_id, root_id, "aggregate", F.concat(F.lit("Total "), F.col("leaf_label")), F.col("leaf_label"), none, F.col("first"))
    root = node(root_id, none, "root", F.lit(metric), none, none, index)
    kinds = F.array(leaf, F.when(many & (index == F.col("first")), agg), F.when(index == F.col("start"), root))
    return rows.select("job_id", F.explode(kinds).alias("k")).where("k is not null").select("job_id", "k.*")


def _placed(nodes: DataFrame, by_range: bool = False) -> DataFrame:
    """+ pos: a node's place in the reconciliation, groups before their totals, the root last."""
    rank = F.when(F.col("kind") == "leaf", 0).when(F.col("kind") == "aggregate", 1).otherwise(2)
    if by_range:
        rows = nodes.withColumns({"_root": (F.col("kind") == "root").cast("int"), "_rank": rank})
        return numbered(rows, ["job_id"], ["_root", "first", "_rank", "seq"], "pos").drop("_root", "_rank")
    return nodes.withColumn("pos", F.row_number().over(Window.partitionBy("job_id").orderBy((F.col("kind") == "root").cast("int"), "first", rank, "seq")))


def formula_edges(nodes: DataFrame, sign: str = "+") -> DataFrame:
    """(job_id, parent_id, group_label, child_id, operator, position): one row for each child, group_label telling apart
    parents that share an id; position counts the children of a parent from 0."""
    child = _placed(nodes).where("parent_id is not null")
    parent = F.when(F.col("parent_id").startswith("agg_"), F.col("group_label"))
    rows = child.select("job_id", "parent_id", parent.alias("group_label"), F.col("node_id").alias("child_id"), F.lit(sign).alias("operator"), "pos")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("job_id", "parent_id", "group_label").orderBy("pos")) - 1).drop("pos")


def reconciliation_total(inputs: DataFrame) -> DataFrame:
    """(job_id, label, total, n, unparsed): sums by label and by job; the row with null label is the job's total."""
    amount = F.bround(accounting_number(F.col("value")), 4).cast("decimal(28,4)")
    rows = inputs.where("reason is null").select("job_id", "leaf_label", amount.alias("amount"))
    sums = (F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount").isNull()).alias("unparsed"))
    # labels are never null here, so a null one is the job's
    out = rows.groupingSets([["job_id", "leaf_label"], ["job_id"]], "job_id", "leaf_label").agg(*sums)
    return out.select("job_id", F.col("leaf_label").alias("label"), F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), "n", "unparsed")


def model_cells(nodes: DataFrame, by_range: bool = False) -> DataFrame:
    """(job_id, sheet, coord, node_id, kind, group_label, content) and source where nodes have it: inputs from row 1 down, the reconciliation from row 3
    with groups before their totals. Children are those of the same group label.

    A child sends its place to its parent's group, where the parent itself is, so one aggregate a parent gives its formula and no
    list is ever on another row: the work is linear in a job's nodes. Places come from a window by job, one task a job; with by_range,
    for jobs of very many nodes, from ranges of nodes over many tasks, at the price of two stored tables.
    """
    kind, leaf = F.col("kind"), F.col("kind") == "leaf"
    coord = lambda n: F.concat(F.lit("B"), n.cast("string"))
    placed = _placed(nodes, by_range)
    if by_range:
        placed = numbered(placed, ["job_id", "kind"], ["seq"], "up")
    else:
        placed = placed.withColumn("up", F.row_number().over(Window.partitionBy("job_id", "kind").orderBy("seq")))
    placed = placed.withColumns({"coord": coord(F.col("pos") + 2), "up": coord(F.col("up"))})
    along = ["source", "label", "value"] if "source" in nodes.columns else []
    cell = lambda sheet, at, what: F.struct(F.lit(sheet).alias("sheet"), at.alias("coord"), "node_id", "kind", "group_label", what.alias("content"), *along)
    both = F.array(cell("Source_Inputs", F.col("up"), F.col("value")), cell("Reconciliation", F.col("coord"), F.concat(F.lit("=Source_Inputs!"), "up")))
    leaves = placed.where(leaf).select("job_id", F.explode(both).alias("c"))

    none = F.lit(None).cast("string")
    group = F.when(F.col("parent_id").startswith("agg_"), F.col("group_label"))
    nobody, nothing = F.when(F.lit(False), F.struct("pos", "coord")), F.when(F.lit(False), cell("Reconciliation", F.col("coord"), none))
    entry = lambda of, child, node: F.struct(of.alias("of"), child.alias("child"), node.alias("node"))
    mine = F.when(kind == "aggregate", F.col("group_label"))
    entries = F.array(
        F.when(F.col("parent_id").isNotNull(), entry(group, F.struct("pos", "coord"), nothing)),
        F.when(~leaf, entry(mine, nobody, cell("Reconciliation", F.col("coord"), none))),
    )
    parents = placed.select("job_id", F.explode(entries).alias("e")).where("e is not null").select("job_id", "e.*").groupBy("job_id", "of")
    parents = parents.agg(F.any_value("node", True).alias("c"), F.array_sort(F.collect_list("child")).alias("refs")).where("c is not null")
    formula = F.concat(F.lit("="), F.array_join(F.col("refs.coord"), "+"))
    parents = parents.select("job_id", F.col("c").withField("content", formula).alias("c"))
    return leaves.union(parents).select("job_id", "c.*")


def provenance_id(job: Column, sheet: Column, coord: Column) -> Column:
    return F.concat(F.lit("urn:provenance:"), job, F.lit(":"), sheet, F.lit(":"), coord)


def provenance_build(cells: DataFrame) -> DataFrame:
    """One nested record a cell of nodes that carry SOURCE: a leaf points to its file, page and box, all else to the model."""
    src = F.col("source")
    out = cells.withColumns({"source_file": src["source_file"], "page": src["page"], "box": F.when(src.isNotNull(), F.struct(*[src[b].alias(b) for b in SOURCE[2:]]))})
    leaf = F.col("kind") == "leaf"
    where = F.when(leaf, F.format_string("page=%d&xywh=%.2f,%.2f,%.2f,%.2f", "page", "box.x0", "box.y0", F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")))
    target = F.struct(F.when(leaf, F.col("source_file")).otherwise("model_derived").alias("source"), F.struct(where.alias("value"), F.struct(F.col("box").alias("coordinates")).alias("refinedBy")).alias("selector"))
    body = F.struct(F.col("content").alias("value"), F.col("kind").alias("purpose"))
    return out.select("job_id", "sheet", "coord", "node_id", F.col("kind").alias("kind_"), (~leaf | (F.col("sheet") == "Reconciliation")).alias("is_formula"), body.alias("body"), target.alias("target"))


def provenance_text(cells: DataFrame, base: str = "") -> DataFrame:
    """(job_id, sheet, coord, id, comment, link): a cell's provenance in words, and where it is found under base; of cells as provenance_build() takes them."""
    leaf, src = F.col("kind") == "leaf", F.col("source")
    ident = provenance_id(F.col("job_id"), F.col("sheet"), F.col("coord"))
    box = F.format_string("BBox [0-1000]: [%.1f, %.1f, %.1f, %.1f]", *[src[b] for b in SOURCE[2:]])
    of = F.concat(F.lit("Source: "), src["source_file"], F.lit(" (p. "), src["page"].cast("string"), F.lit(")"))
    line = lambda name, c: F.concat(F.lit(name + ": "), F.coalesce(c, F.lit("")))
    placed = F.concat_ws("\n", F.lit("[Provenance]"), line("Label", F.col("group_label")), line("Value", F.col("value")), of, box, line("ID", ident))
    derived = F.concat_ws("\n", F.lit("[Provenance - Calculated]"), line("Metric", F.col("label")), line("Formula", F.col("content")), line("ID", ident))
    link = F.concat_ws("/", F.lit(base + "/models"), "job_id", F.lit("provenance"), "sheet", "coord")
    return cells.select("job_id", "sheet", "coord", ident.alias("id"), F.when(leaf, placed).otherwise(derived).alias("comment"), link.alias("link"))


def source_chain(cells: DataFrame) -> DataFrame:
    """(job_id, sheet, coord, leaf_id): the leaves under every cell: its own, its group's by label, or all of the job's.

    One reading of cells: a leaf goes to its own cells, its group and its job, where a window finds the parent's place.
    """
    kind, leaf, none = F.col("kind"), F.col("kind") == "leaf", F.lit(None).cast("string")
    at, apart = F.struct("sheet", "coord"), F.concat_ws("!", "sheet", "coord")

    def entry(under, key, leaf_id, place):
        return F.struct(F.lit(under).alias("under"), key.alias("key"), leaf_id.alias("leaf_id"), place.alias("at"))

    nowhere, whole = F.when(F.lit(False), at), F.lit("")
    once = leaf & (F.col("sheet") == "Reconciliation")
    entries = F.array(
        F.when(leaf, entry("leaf", apart, F.col("node_id"), at)),
        F.when(once, entry("aggregate", F.col("group_label"), F.col("node_id"), nowhere)),
        F.when(once, entry("root", whole, F.col("node_id"), nowhere)),
        F.when(kind == "aggregate", entry("aggregate", F.col("group_label"), none, at)),
        F.when(kind == "root", entry("root", whole, none, at)),
    )
    rows = cells.select("job_id", F.explode(entries).alias("e")).where("e is not null").select("job_id", "e.*")
    rows = rows.withColumn("at", F.max("at").over(Window.partitionBy("job_id", "under", "key")))
    return rows.where("leaf_id is not null and at is not null").select("job_id", "at.sheet", "at.coord", "leaf_id")


def source_chain_of(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """(job_id, sheet, coord, is_found, leaf_id) of refs (job_id, sheet, coord); blanks around both and the case of coord do
    not matter. A ref to no cell is one row with is_found false and no leaf; every cell has a leaf."""
    wanted = refs.select("job_id", strip(F.col("sheet")).alias("sheet"), F.upper(strip(F.col("coord"))).alias("coord")).distinct()
    named = cells.join(wanted.select("job_id").distinct(), "job_id", "left_semi")
    out = wanted.join(source_chain(named), ["job_id", "sheet", "coord"], "left")
    return out.select("job_id", "sheet", "coord", F.col("leaf_id").isNotNull().alias("is_found"), "leaf_id")


def formula_inputs_review(review: DataFrame) -> DataFrame:
    """Reviewed items that enter the tree: locked, accepted, or under review with a known label; + leaf_label, is_hardcode, reason."""
    known = F.nullif(strip(F.col("normalized_label")), F.lit(""))
    s = F.col("status")
    kept = review.where((s == "locked") | (s == "auto_accepted") | ((s == "needs_review") & known.isNotNull()))
    kept = kept.withColumns({"leaf_label": F.coalesce(known, F.nullif(strip(F.col("label")), F.lit(""))), "is_hardcode": F.col("band") == "manual_required"})
    return formula_input_errors(kept.where("leaf_label is not null"))


def reconciliation_tie_out(inputs: DataFrame, expected: DataFrame, metric: str, tolerance: float = 0.005) -> DataFrame:
    """(job_id, total, expected_total, ties): parts without the metric's own line against the total that the filing states."""
    own = F.lower("leaf_label") == metric.lower()
    amount = F.when(~own, F.bround(accounting_number(F.col("value")), 4).cast("decimal(28,4)"))
    got = inputs.where("reason is null").groupBy("job_id").agg(F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("total"))
    out = expected.select("job_id", "expected_total").join(got, "job_id", "left")
    return out.select("job_id", "total", "expected_total", F.coalesce(F.abs(F.col("total") - F.col("expected_total")) <= tolerance, F.lit(False)).alias("ties"))


def generation_result(cells: DataFrame) -> DataFrame:
    """(job_id, success, cells, formulas, sources, unparsed): a model stands where it has a root."""
    source = F.col("sheet") == "Source_Inputs"
    return cells.groupBy("job_id").agg(
        F.bool_or(F.col("kind") == "root").alias("success"), F.count(F.lit(1)).alias("cells"), F.count_if(~source).alias("formulas"),
        F.count_if(source).alias("sources"), F.count_if(source & accounting_number(F.col("content")).isNull()).alias("unparsed"),
    )
