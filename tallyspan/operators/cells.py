"""Parsed table cells to ordered line items with page and box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions import words
from tallyspan.functions.exprs import contains_any, strip


def is_noise(text: Column) -> Column:
    """Blank, boilerplate, a unit declaration, or neither a digit nor a known placeholder."""
    t = strip(F.coalesce(text, F.lit("")))
    plain = ~t.rlike(r"(?U)\d") & ~F.lower(t).isin(*words.PLACEHOLDERS)
    return (t == "") | t.rlike(words.BOILERPLATE) | t.rlike(words.UNIT_QUALIFIER) | plain


def cell_noise_filter(cells: DataFrame) -> DataFrame:
    return cells.where(~is_noise(F.col("text")))


def table_title(cells: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(source_file, table_idx, title): the table's caption, else its label unless that only says what it is, else the
    first titled cell of row 0, else the first titled header cell, else a number.

    cells hold start_row and is_header; tables (source_file, table_idx, caption, label), where there are any.
    """
    a, b = _titled()
    got = cells.groupBy("source_file", "table_idx").agg(a.alias("a"), b.alias("b"))
    number = F.concat(F.lit("Table "), (F.col("table_idx") + 1).cast("string"))
    if tables is None:
        return got.select("source_file", "table_idx", F.coalesce("a", "b", number).alias("title"))
    out = tables.select("source_file", "table_idx", _named().alias("named")).join(got, ["source_file", "table_idx"], "full")
    return out.select("source_file", "table_idx", F.coalesce("named", "a", "b", number).alias("title"))


def _titled() -> tuple[Column, Column]:
    """A table's first titled cell of row 0 and its first titled header cell, as aggregates."""
    text = strip(F.coalesce("text", F.lit("")))
    low = F.lower(text)
    first = F.coalesce(F.col("start_row").cast("string").try_cast("int") == 0, F.lit(False)) & (F.length(text) > words.ALLOWED_TITLE_LENGTH) & contains_any(low, words.TITLE_WORDS)
    head = F.col("is_header") & contains_any(low, words.HEADER_TITLE_WORDS)
    return tuple(F.min_by(F.when(is_, text), F.when(is_, F.col("cell_idx"))) for is_ in (first, head))


def _named() -> Column:
    """What a table's caption or label calls it, null where neither does."""
    caption, label = (F.nullif(strip(F.col(c)), F.lit("")) for c in ("caption", "label"))
    return F.coalesce(caption, F.when(~F.lower("label").isin("table", "data_table"), label))


def reconciliation_tables(titles: DataFrame, metric: str = "") -> DataFrame:
    low = F.lower(F.coalesce("title", F.lit("")))
    hit = contains_any(low, words.RECONCILIATION_TITLES)
    if metric.strip():
        hit = hit | low.contains(metric.strip().lower())
    return titles.withColumn("is_candidate", (low != "") & hit)


def header_label_path(cells: DataFrame) -> DataFrame:
    """(source_file, table_idx, cell_idx, label) of the data cells, see labelled()."""
    return labelled(cells).select("source_file", "table_idx", "cell_idx", "label")


def labelled(cells: DataFrame) -> DataFrame:
    """Data cells + label: row headers, then column headers, joined by ' / ', else the cell's text.

    cells: source_file, table_idx, cell_idx, start_row, start_col, is_row_header, is_col_header, text.
    """
    return _in_tables(cells, {})


def titled_cells(cells: DataFrame, tables: DataFrame | None = None, metric: str = "") -> DataFrame:
    """labelled() + table_name and named, the title that table_title() gives the cell's table and whether that is a candidate; both
    null for a cell without file or table. The cells are read once."""
    a, b = _titled()
    table = Window.partitionBy("source_file", "table_idx")
    out = _in_tables(cells.withColumn("is_header", F.col("is_row_header") | F.col("is_col_header")), {"_a": a.over(table), "_b": b.over(table)})
    title = [F.col("_a"), F.col("_b"), F.concat(F.lit("Table "), (F.col("table_idx") + 1).cast("string"))]
    if tables is not None:
        out = out.join(tables.select("source_file", "table_idx", _named().alias("_named")), ["source_file", "table_idx"], "left")
        title.insert(0, F.col("_named"))
    known = F.col("source_file").isNotNull() & F.col("table_idx").isNotNull()
    out = reconciliation_tables(out.withColumn("title", F.coalesce(*title)), metric)
    named = {"table_name": F.when(known, F.col("title")), "named": F.when(known, F.col("is_candidate"))}
    return out.withColumns(named).drop("title", "is_candidate", "is_header", "_a", "_b", "_named")


def _in_tables(cells: DataFrame, more: dict[str, Column]) -> DataFrame:
    """Data cells + label and more, windows over all cells of a table. One exchange by table serves all windows, so cells are made once."""
    table = ["source_file", "table_idx"]

    def heads(flag: str, line: str) -> Column:
        """The headers of a cell's line; none for a line without number."""
        text = strip(F.col("text"))
        listed = F.collect_list(F.when(F.col(flag) & (text != ""), F.struct("cell_idx", text.alias("t")))).over(Window.partitionBy(*table, line))
        whole = F.col(line).isNotNull() & F.col(table[0]).isNotNull() & F.col(table[1]).isNotNull()
        return F.when(whole, F.transform(F.array_sort(listed), lambda x: x["t"])).otherwise(F.array().cast("array<string>"))

    rows = cells.repartition(*table).withColumn("_rh", heads("is_row_header", "start_row")).withColumn("_ch", heads("is_col_header", "start_col"))
    out = rows.withColumns(more).where("not is_row_header and not is_col_header")
    path = F.array_join(F.concat("_rh", "_ch"), " / ")
    return out.withColumn("label", F.when(path != "", path).otherwise(F.col("text"))).drop("_rh", "_ch")


def item_order(items: DataFrame) -> DataFrame:
    """+ record_index by page, y0, x0; ties by table and cell, as a stable sort has them."""
    w = Window.partitionBy("job_id").orderBy("page", "y0", "x0", "table_idx", "cell_idx")
    return items.withColumn("record_index", F.row_number().over(w) - 1)


def bbox_normalize(items: DataFrame, dims: DataFrame) -> DataFrame:
    """Boxes in thousandths of the page, ordered, clamped, two places; a page without size gives an error row."""
    out = items.join(dims, ["source_file", "page"], "left")
    ok = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("page") >= 1), F.lit(False))
    scale = lambda v, of: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.col(v) / F.col(of) * 1000)), 2)
    x0, x1, y0, y1 = scale("x0", "width"), scale("x1", "width"), scale("y0", "height"), scale("y1", "height")
    boxes = {"x0": F.least(x0, x1), "x1": F.greatest(x0, x1), "y0": F.least(y0, y1), "y1": F.greatest(y0, y1)}
    return out.withColumns({k: F.when(ok, v).otherwise(0.0) for k, v in boxes.items()} | {"is_error": ~ok}).drop("width", "height")


def image_only_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("source_file").agg(F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("image_only"))


BOX = ("x0", "y0", "x1", "y1")


def cell_location(cells: DataFrame) -> DataFrame:
    """+ page, x0..y1: the cell's own, else (box only) its provenance's, else the table's, else page 1 and zeros."""
    zero = F.struct(*[F.lit(0.0).alias(b) for b in BOX])
    out = cells.withColumns({"page": F.coalesce("page_cell", "page_table", F.lit(1)), "_box": F.coalesce("bbox_cell", "bbox_prov", "bbox_table", zero)})
    return out.withColumns({b: F.col("_box")[b] for b in BOX}).drop("_box")


def cell_error_rows(cells: DataFrame) -> DataFrame:
    """cells, malformed ones (no text, or a row or column that is no whole number from 0) as error rows; the rest is untouched."""
    place = lambda c: F.col(c).cast("string").try_cast("int")
    bad = F.col("text").isNull() | ~F.coalesce((place("start_row") >= 0) & (place("start_col") >= 0), F.lit(False))
    out = cells.withColumns({"is_error": bad, "label": F.when(bad, "Error / Unparsed Cell").otherwise(F.col("label"))})
    return out.withColumns({b: F.when(bad, 0.0).otherwise(F.col(b)) for b in BOX})


def assemble_records(items: DataFrame) -> DataFrame:
    """The five lasting fields, the candidate flag, and the keys that hold the order."""
    return items.select("job_id", "record_index", "value", "label", "page", F.struct(*BOX).alias("bbox"), "source_file", "is_candidate")
