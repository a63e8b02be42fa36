"""Projections of the star-schema tables that give the operators their inputs at any scale.

Each text is SQL that Spark and the oracle both run; only the number format differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = {"spark": "format_number({x}, 2)", "duckdb": "format('{{:,.2f}}', {x})"}

TEXTS = {
    "fx_line_items": """
SELECT cast(l_orderkey AS string) AS job_id,
       cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS int) AS record_index,
       CASE l_returnflag WHEN 'R' THEN concat('(', MONEY, ')') WHEN 'A' THEN concat('$', MONEY) ELSE MONEY END AS value,
       concat(CASE WHEN l_linestatus = 'O' THEN concat(p_type, ' / ') ELSE '' END, CASE WHEN l_quantity >= 46 THEN 'Merged ' ELSE '' END, p_name,
              CASE WHEN p_size % 7 = 0 THEN ' (1)' ELSE '' END) AS label,
       cast(1 + l_linenumber % 3 AS int) AS page,
       cast((l_partkey % 80) * 10 AS double) AS x0, cast((l_suppkey % 90) * 10 AS double) AS y0,
       cast((l_partkey % 80) * 10 + 60 AS double) AS x1, cast((l_suppkey % 90) * 10 + 15 AS double) AS y1,
       CASE p_size % 5 WHEN 0 THEN 'Debt schedule' WHEN 1 THEN 'Table 3' ELSE concat('Adjusted EBITDA reconciliation ', p_brand) END AS table_name,
       l_discount >= 0.1 AS is_error, p_type, p_name, l_partkey AS partkey, l_suppkey AS suppkey, l_extendedprice AS amount
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_jobs": """
SELECT cast(o_orderkey AS string) AS job_id, concat(replace(c_name, '#', '-'), '_', cast(year(o_orderdate) AS string), '_10k.pdf') AS filename,
       CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'extracting' END AS status,
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Adjusted EBITDA' WHEN '2' THEN 'EBITDA' WHEN '3' THEN 'Net Income' ELSE 'Free Cash Flow' END AS target_metric,
       o_orderdate AS submitted_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fx_locked": """
SELECT concat(c_name, '-', cast(year(o_orderdate) AS string)) AS job_id, c_name AS entity, cast(year(o_orderdate) AS int) AS eval_seq, cast(year(o_orderdate) AS int) AS year, p_type AS normalized_label,
       CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'Adjusted EBITDA' ELSE 'EBITDA' END AS metric
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
WHERE l_linestatus = 'F' AND substring(o_orderpriority, 1, 1) IN ('1', '2')""",
    "fx_taxonomy": """
SELECT cast(row_number() OVER (ORDER BY p_type) - 1 AS int) AS position, p_type AS entry
FROM (SELECT DISTINCT p_type FROM {part}) AS t WHERE p_type <> (SELECT min(p_type) FROM {part})""",
    "fx_actions": """
SELECT cast(user_id AS string) AS item_id, ts, event_id AS seq, CASE event_type WHEN 'view' THEN 'flag' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'confirm' WHEN 'signup' THEN 'unlock' ELSE 'batch_confirm' END AS action,
       CASE WHEN value < 1 THEN '' WHEN event_id % 4 > 0 THEN concat('label ', cast(event_id % 5 AS string)) END AS new_label,
       CASE WHEN event_id % 3 = 0 THEN cast(event_id % 100 AS string) WHEN event_id % 3 = 1 THEN ' ' END AS new_value,
       CASE WHEN event_id % 7 = 0 THEN true WHEN event_id % 7 = 1 THEN false END AS add_to_taxonomy
FROM {events}""",
    "fx_log": """
SELECT cast(user_id AS string) AS job_id, CASE WHEN event_id % 499 = 0 THEN 'not json' WHEN event_id % 97 = 0 THEN '  ' ELSE concat(
  '{{"taxonomy_status": "', CASE event_type WHEN 'view' THEN 'matched' ELSE 'pending' END, '", "resulting_state": "', CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'signup' THEN 'classification_error' ELSE 'pending_confirmation' END,
  '", "raw_response": {{"label": "x", "confidence": 0.5', CASE WHEN event_id % 211 = 0 THEN ', "ok": true' WHEN event_id % 223 = 0 THEN ', "sum": 3.5' WHEN event_id % 3 = 0 THEN ', "note": "n"' ELSE '' END, '}}}}') END AS line
FROM {events}""",
    "fx_runs": """
SELECT cast(o_orderkey AS string) AS job_id, o_orderstatus <> 'P' AS success, cast(o_orderkey % 200 AS int) AS extraction,
       cast(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 + o_custkey % 60 END AS int) AS classification, cast(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 + o_custkey % 7 END AS int) AS generation
FROM {orders}""",
}

TABLES = {"fx_line_items": ("lineitem", "part"), "fx_jobs": ("orders", "customer"), "fx_locked": ("lineitem", "orders", "customer", "part"), "fx_taxonomy": ("part",), "fx_actions": ("events",), "fx_log": ("events",), "fx_runs": ("orders",)}


def _text(name: str, dialect: str) -> str:
    return TEXTS[name].replace("MONEY", MONEY[dialect].format(x="l_extendedprice"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "fx_cells":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
        return docs.select(F.col("source").alias("source_file"), F.col("doc_id").alias("table_idx"), F.posexplode(F.split("text", "\n")).alias("cell_idx", "text"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    if name == "fx_line_items":
        return _dealt(spark, sf_dir, _text(name, "spark"), **tables)
    return spark.sql(_text(name, "spark"), **tables)


#: Line items to a task where a job's rows meet.
ITEMS_A_TASK = 400_000


def job_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks, or buckets, for rows dealt by job: what one holds stays the same, however large the table is."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ITEMS_A_TASK)


def _dealt(spark: SparkSession, sf_dir: str, text: str, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """The text's columns over its two tables, joined and dealt by order. They are dealt before the columns are made, so that the
    tables' own values are sent, and the order is a string by then, so that job_id is the key they are dealt by: what goes by job
    afterwards finds its rows together and sends nothing again."""
    rows = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("l_orderkey", F.col("l_orderkey").cast("string"))
    n = job_tasks(spark, sf_dir)
    few = n == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition("l_orderkey") if few else rows.repartition(n, "l_orderkey")
    return spark.sql(text.rsplit("\nFROM ", 1)[0] + "\nFROM {rows}", rows=rows)


def oracle(name: str) -> str:
    """The projection as a common table expression."""
    if name == "fx_cells":
        return """fx_cells AS (SELECT source AS source_file, doc_id AS table_idx, cast(i - 1 AS int) AS cell_idx, parts[i] AS text
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i))"""
    text = _text(name, "duckdb")
    for t in TABLES[name]:
        text = text.replace("{" + t + "}", t)
    text = text.replace("{{", "{").replace("}}", "}")
    return f"{name} AS ({text})"
