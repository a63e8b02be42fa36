import pytest
from pyspark.sql import functions as F

from tallyspan.functions import exprs as x


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(
    "text, n",
    [("(1,234.50)", -1234.5), ("$50,000", 50000.0), ("-100.0", -100.0), ("100%", 100.0), ("  ( 500 ) ", -500.0), ("invalid_text", None), (None, None), ("100 200", None), ("1f", None), ("(-5)", 5.0), ("", None)],
)
def test_number(spark, text, n):
    assert one(spark, x.accounting_number(F.lit(text).cast("string"))) == n


@pytest.mark.parametrize("a, b, same", [("(1,234)", "-1234", True), ("$50,000.00", "50000", True), ("(50.00)", "50.00", False), (None, None, True), (None, "1", False), ("Net income", "net income ", True)])
def test_equivalent(spark, a, b, same):
    s = lambda t: F.lit(t).cast("string")
    assert one(spark, x.values_equivalent(s(a), s(b))) is same


@pytest.mark.parametrize("box, iou", [((0, 0, 10, 10), 1.0), ((20, 20, 30, 30), 0.0), ((5, 0, 15, 10), 0.3333), ((10, 0, 20, 10), 0.0)])
def test_iou(spark, box, iou):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, *map(float, box))], "gx0 double, gy0 double, gx1 double, gy1 double, x0 double, y0 double, x1 double, y1 double")
    assert df.select(x.bbox_iou("g", "").alias("v")).first().v == iou


def test_text(spark):
    assert one(spark, x.strip(F.lit("  a b\t"))) == "a b"
    assert one(spark, x.canonical_label(F.lit("  Stock-Based (Comp) "))) == "stock based comp"
    assert one(spark, x.slug(F.lit("Café – net"))) == "café_net"
    assert one(spark, x.percent(F.lit(1), F.lit(0))) == 0.0


def test_strip_equals_the_pattern_for_every_sign(spark):
    """Every sign at either end, alone and doubled, against the pattern (?U)\\s."""
    signs = [chr(k) for k in range(1, 0x3100) if not 0xD800 <= k < 0xE000] + ["　 ", " \n", "\x1c", "\U0001f600", ""]
    df = spark.createDataFrame([(s + "a" + s + "b" + s,) for s in signs] + [(s + s,) for s in signs] + [(None,)], "c string")
    same = df.select((x.strip(F.col("c")).eqNullSafe(F.regexp_replace("c", r"(?U)^\s+|\s+$", ""))).alias("ok"))
    assert same.where("not ok").count() == 0
    assert "regexp" not in df.select(x.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString().lower()
