"""Column expressions that the operators share. All stay inside code generation: no Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the pattern (?U)\s matches: all signs with the property White_Space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without blanks of any script at either end; trim() without signs knows the space alone."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


_NUMBER = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def accounting_number(c: Column) -> Column:
    """Amount in accounting notation: signs of currency and percent dropped, parentheses or a minus negate."""
    bare = F.regexp_replace(c, r"[$€£%,]", "")
    part = lambda before, after: F.nullif(F.regexp_extract(bare, rf"(?U)^\s*{before}{_NUMBER}{after}\s*$", 1), F.lit("")).try_cast("double")
    first = F.ltrim(bare, F.lit(BLANKS))  # the first sign names the one form that can hold, so one pattern runs a row
    return F.when(first.startswith("("), -part(r"\(\s*", r"\s*\)")).when(first.startswith("-"), -part(r"-\s*", "")).otherwise(part("", ""))


def same_value(a: Column, b: Column, x: Column, y: Column) -> Column:
    """values_equivalent() of texts a, b whose amounts x, y are known: amounts are parsed once a row, not once a pair."""
    return (
        F.when(a.isNull() & b.isNull(), True)
        .when(a.isNull() | b.isNull(), False)
        .when(F.lower(strip(a)) == F.lower(strip(b)), True)
        .otherwise(F.coalesce(F.abs(x - y) <= 1e-3, F.lit(False)))
    )


def values_equivalent(a: Column, b: Column) -> Column:
    return same_value(a, b, accounting_number(a), accounting_number(b))


def bbox_iou(a: str, b: str) -> Column:
    """Intersection over union of boxes with columns {a}x0 .. {a}y1; 0 where one is missing or they only touch."""
    c = F.col
    w = F.least(c(a + "x1"), c(b + "x1")) - F.greatest(c(a + "x0"), c(b + "x0"))
    h = F.least(c(a + "y1"), c(b + "y1")) - F.greatest(c(a + "y0"), c(b + "y0"))
    area = lambda p: (c(p + "x1") - c(p + "x0")) * (c(p + "y1") - c(p + "y0"))
    both = w * h
    return F.when((w > 0) & (h > 0), F.bround(both / (area(a) + area(b) - both), 4)).otherwise(0.0)


def px_bbox(width: Column, height: Column, box: Column | None = None) -> Column:
    """(left, top, width, height) in pixels of a box in thousandths of a page of the given size: clamped, ordered,
    at least one pixel each way; zeros where the page has no size. Halves go up, as on a screen."""
    at = (lambda n: box[n]) if box is not None else F.col
    clamp = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1000.0), at(n)))
    near = lambda v: F.floor(v + 0.5).cast("int")
    x0, x1, y0, y1 = (clamp(n) for n in ("x0", "x1", "y0", "y1"))
    wide, high = near(F.abs(x1 - x0) / 1000 * width), near(F.abs(y1 - y0) / 1000 * height)
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    parts = {"left": near(F.least(x0, x1) / 1000 * width), "top": near(F.least(y0, y1) / 1000 * height), "width": F.greatest(wide, F.lit(1)), "height": F.greatest(high, F.lit(1))}
    return F.struct(*[F.when(sized, v).otherwise(0).alias(k) for k, v in parts.items()])


def iso_utc(c: Column) -> Column:
    """A time as ISO text in UTC, whatever the session's zone."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def canonical_label(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, "[^a-zA-Z0-9]+", " ")))


def slug(c: Column) -> Column:
    """File-name form of a label; word characters of any script stay."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(c, r"(?U)[^\w\s-]", ""))), r"(?U)[-\s]+", "_")


def percent(part: Column, whole: Column) -> Column:
    """part of whole in percent, half-even to two places; 0 of nothing."""
    exact = (part * 100).cast("decimal(28,8)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.bround(exact, 2).cast("double"), F.lit(0.0))


def ratio(part: Column, whole: Column, places: int = 4) -> Column:
    exact = part.cast("decimal(28,8)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.bround(exact, places).cast("double"), F.lit(0.0))
