"""Greedy matching of a page's items and records from ordered pools, in time near-linear in the page.

Items of a page, in order, each take their best unused record: score = 2 * box overlap + 2 if the values
are equal + 1 if the labels are, ties to the least index. No list of pairs is made. The unused records wait in
pools, each in index order: those of a value, of a label, of both, for the page and for each distinct box.
Without overlap only three records can be the best, the first of the value and label, of the value, and
of the label; with overlap the same holds box by box, so an item looks at the heads of three pools and of those of
the boxes it touches, found by grid cell, the largest overlap first. Amounts within the tolerance of each other are
equal, so a pool's amounts are a sorted list with a tree of least indices above it.

Spark deals the rows to tasks by page, or leaves them where they are dealt by job, sorted; a task streams them and holds one page at a time.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspan.functions.exprs import accounting_number, strip

TOLERANCE = 1e-3
#: Pages of at most so many pairs are matched pair by pair, without pools.
FEW_PAIRS = 256


def rounded(x: float) -> float:
    """Half-even to four places on the decimal digits, as bbox_iou() rounds."""
    y = x * 10_000
    if abs(y - math.floor(y) - 0.5) < 1e-6:
        return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))
    return round(x, 4)


def overlap(a: tuple, b: tuple) -> float:
    if None in a or None in b:
        return 0.0
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if not (w > 0 and h > 0):
        return 0.0
    return rounded(w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h))


def equal_values(a: tuple, b: tuple) -> bool:
    """Of rows (text, amount, ...)."""
    if a[0] is None or b[0] is None:
        return a[0] is None and b[0] is None
    return a[0] == b[0] or (a[1] is not None and b[1] is not None and abs(a[1] - b[1]) <= TOLERANCE)


class Pool:
    """Unused records, by index: the first of all, and the first of those with a value or a label."""

    def __init__(self, rows: list[int], records: list[tuple], used: bytearray):
        self.rows, self.records, self.used, self.at = rows, records, used, 0
        self.texts: dict | None = None
        self.labels: dict | None = None

    def first(self) -> int | None:
        while self.at < len(self.rows) and self.used[self.rows[self.at]]:
            self.at += 1
        return self.rows[self.at] if self.at < len(self.rows) else None

    def with_label(self, label) -> Pool | None:
        if self.labels is None:
            groups: dict = {}
            for r in self.rows[self.at :]:
                groups.setdefault(self.records[r][2], []).append(r)
            self.labels = {k: Pool(v, self.records, self.used) for k, v in groups.items() if k is not None}
        return self.labels.get(label)

    def first_equal(self, text, amount) -> int | None:
        if self.texts is None:
            self._by_value()
        if text is None or amount is None:
            pool = self.texts.get(text)
            return pool.first() if pool else None
        n, lo = len(self.amounts), bisect_left(self.amounts, amount - TOLERANCE)
        while lo and amount - self.amounts[lo - 1] <= TOLERANCE:
            lo -= 1
        while lo < n and amount - self.amounts[lo] > TOLERANCE:
            lo += 1
        hi = bisect_left(self.amounts, amount + TOLERANCE, lo)
        while hi > lo and self.amounts[hi - 1] - amount > TOLERANCE:
            hi -= 1
        while hi < n and self.amounts[hi] - amount <= TOLERANCE:
            hi += 1
        while lo < hi:
            best = self._least(lo, hi)
            if best == self.none:
                return None
            if not self.used[best]:
                return best
            self._refresh(bisect_left(self.amounts, self.records[best][1]))
        return None

    def _by_value(self) -> None:
        texts: dict = {}
        amounts: dict = {}
        for r in self.rows[self.at :]:
            text, amount = self.records[r][:2]
            if text is None or amount is None:
                texts.setdefault(text, []).append(r)
            else:
                amounts.setdefault(amount, []).append(r)
        self.texts = {k: Pool(v, self.records, self.used) for k, v in texts.items()}
        self.amounts = sorted(amounts)
        self.pools = [Pool(amounts[a], self.records, self.used) for a in self.amounts]
        self.none, n = len(self.records), len(self.pools)
        self.tree = [self.none] * n + [p.rows[0] for p in self.pools]
        for k in range(n - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def _least(self, lo: int, hi: int) -> int:
        best, lo, hi = self.none, lo + len(self.pools), hi + len(self.pools)
        while lo < hi:
            if lo & 1:
                best, lo = min(best, self.tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo >> 1, hi >> 1
        return best

    def _refresh(self, leaf: int) -> None:
        first, k = self.pools[leaf].first(), leaf + len(self.pools)
        self.tree[k] = self.none if first is None else first
        while k > 1:
            k >>= 1
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def best(self, item: tuple, any_at_all: bool) -> tuple[int, int, bool] | None:
        """(bonus, record, value equal) of the best record of this pool for an item."""
        text, amount, label = item[:3]
        named = self.with_label(label) if label is not None else None
        if named is not None and (r := named.first_equal(text, amount)) is not None:
            return 3, r, True
        if (r := self.first_equal(text, amount)) is not None:
            return 2, r, True
        if named is not None and (r := named.first()) is not None:
            return 1, r, False
        if any_at_all and (r := self.first()) is not None:
            return 0, r, False
        return None


class Boxes:
    """Pools of the distinct boxes of a page, by grid cell: a box lies in the cells of a grid about as wide as itself."""

    def __init__(self, records: list[tuple], used: bytearray):
        rows: dict[tuple, list[int]] = {}
        for r, x in enumerate(records):
            box = x[3:7]
            if None not in box and box[2] > box[0] and box[3] > box[1] and all(map(math.isfinite, box)):
                rows.setdefault(box, []).append(r)
        self.pools = {box: Pool(v, records, used) for box, v in rows.items()}
        self.grids: dict[int, tuple[dict, dict]] = {}  # by level: all boxes, and those of each cell
        for box in self.pools:
            level = math.frexp(max(box[2] - box[0], box[3] - box[1]))[1]
            whole, cells = self.grids.setdefault(level, ({}, {}))
            whole[box] = None
            for cell in self._cells(box, level):
                cells.setdefault(cell, {})[box] = None

    @staticmethod
    def _cells(box: tuple, level: int) -> list[tuple]:
        size = 2.0**level
        return [(i, j) for i in range(math.floor(box[0] / size), math.floor(box[2] / size) + 1) for j in range(math.floor(box[1] / size), math.floor(box[3] / size) + 1)]

    def touched(self, box: tuple) -> list[tuple[float, tuple]]:
        """(overlap, box) of every box with unused records that overlaps, the largest overlap first."""
        if None in box or not all(map(math.isfinite, box)) or not (box[2] > box[0] and box[3] > box[1]):
            return []
        found = set()
        for level, (whole, cells) in self.grids.items():
            size = 2.0**level
            if ((box[2] - box[0]) / size + 2) * ((box[3] - box[1]) / size + 2) > len(whole):
                found.update(whole)
            else:
                for cell in self._cells(box, level):
                    found.update(cells.get(cell, ()))
        out = []
        for b in found:
            if v := overlap(box, b):
                out.append((v, b))
        out.sort(reverse=True)
        return out

    def drop(self, box: tuple) -> None:
        level = math.frexp(max(box[2] - box[0], box[3] - box[1]))[1]
        whole, cells = self.grids[level]
        del whole[box]
        for cell in self._cells(box, level):
            del cells[cell][box]


def match_page(items: list[tuple], records: list[tuple], least: float) -> list[tuple[int, float, bool]]:
    """For each item (text, amount, label, x0, y0, x1, y1) its record, or -1, their overlap, and whether the values are equal."""
    if len(items) * len(records) <= FEW_PAIRS:
        return _pair_by_pair(items, records, least)
    used = bytearray(len(records))
    page, boxes, out = Pool(list(range(len(records))), records, used), Boxes(records, used), []
    for item in items:
        best, record, found = -1.0, -1, (0.0, False)
        if (got := page.best(item, False)) is not None:
            best, record, found = float(got[0]), got[1], (0.0, got[2])
        for v, box in boxes.touched(item[3:7]):
            if v * 2 + 3 < best:
                break
            pool = boxes.pools[box]
            if pool.first() is None:
                boxes.drop(box)
            elif (got := pool.best(item, v >= least)) is not None:
                score = v * 2 + got[0]
                if score > best or (score == best and got[1] < record):
                    best, record, found = score, got[1], (v, got[2])
        if record >= 0:
            used[record] = 1
        out.append((record, *found))
    return out


def _pair_by_pair(items: list[tuple], records: list[tuple], least: float) -> list[tuple[int, float, bool]]:
    free, out = list(range(len(records))), []
    for item in items:
        best, record, found = -1.0, -1, (0.0, False)
        for r in free:
            x = records[r]
            v, value, label = overlap(item[3:7], x[3:7]), equal_values(item, x), item[2] is not None and item[2] == x[2]
            score = v * 2 + 2 * value + label
            if score > best and (v >= least or value or label):
                best, record, found = score, r, (v, value)
        if record >= 0:
            free.remove(record)
        out.append((record, *found))
    return out


_KEYS = ["text", "amount", "label", "x0", "y0", "x1", "y1"]


def _whole_pages(batches):
    """Tables of whole pages, from batches sorted by page."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cut = t.num_rows
        last = (t["job_id"][-1].as_py(), t["page"][-1].as_py())
        jobs, pages = t["job_id"].to_pylist(), t["page"].to_pylist()
        while cut and (jobs[cut - 1], pages[cut - 1]) == last:
            cut -= 1
        if held is not None:
            first = (held["job_id"][-1].as_py(), held["page"][-1].as_py())
            if cut or first != last:
                yield pa.concat_tables([held, t.slice(0, cut)])
                held = None
        elif cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
        held = rest if held is None else pa.concat_tables([held, rest])
    if held is not None:
        yield held


def _matched(least: float, carry: Sequence[str] = ()):
    def run(batches):
        for t in _whole_pages(batches):
            jobs, pages, sides = t["job_id"].to_pylist(), t["page"].to_pylist(), t["side"].to_pylist()
            rows = list(zip(*(t[k].to_pylist() for k in _KEYS)))
            mine, theirs, overlaps, values = [], [], [], []
            a = 0
            while a < len(rows):
                b = a + 1
                while b < len(rows) and jobs[b] == jobs[a] and pages[b] == pages[a]:
                    b += 1
                m = a
                while m < b and not sides[m]:
                    m += 1
                got = match_page(rows[a:m], rows[m:b], least)
                taken = bytearray(b - m)
                for k, (r, v, value) in enumerate(got):
                    mine.append(a + k)
                    theirs.append(m + r if r >= 0 else None)
                    overlaps.append(v)
                    values.append(value)
                    if r >= 0:
                        taken[r] = 1
                rest = [m + r for r in range(b - m) if not taken[r]]
                mine += [None] * len(rest)
                theirs += rest
                overlaps += [0.0] * len(rest)
                values += [False] * len(rest)
                a = b
            i, r = pa.array(mine, pa.int64()), pa.array(theirs, pa.int64())
            at = pa.array([x if x is not None else y for x, y in zip(mine, theirs)], pa.int64())
            both = pa.array([x is not None and y is not None for x, y in zip(mine, theirs)])
            cols = {
                "job_id": t["job_id"].take(at), "page": t["page"].take(at), "item_pos": t["pos"].take(i), "record_index": t["pos"].take(r), "gt_num": t["amount"].take(i), "num": t["amount"].take(r),
                "gt_class": t["class"].take(i), "class": t["class"].take(r), "is_optional": t["is_optional"].take(at), "iou": pa.array(overlaps, pa.float64()), "value_eq": pa.array(values, pa.bool_()), "is_match": both,
            }
            cols |= {c: t[c].take(at) for c in carry}
            yield from pa.table(cols).to_batches()

    return run


def matched_pages(gt: DataFrame, ext: DataFrame, iou: float = 0.5) -> DataFrame:
    """Every item and record once: (job_id, page, item_pos, record_index, gt_num, num, gt_class, class, is_optional, iou, value_eq, is_match).

    A missed item has no record_index, a record that no item takes no item_pos; of either, iou is 0. One exchange, by
    page; pages of any size. A row without filing or page meets only rows without one, too.
    """
    sides = (gt, 0, "item_pos", "gt_value", "gt_label", "gt_class", F.col("is_optional"), "g"), (ext, 1, "record_index", "value", "label", "class", F.lit(False), "")
    rows = [
        df.select("job_id", "page", F.lit(side).alias("side"), F.col(pos).alias("pos"), F.col(value).alias("value"), F.col(label).alias("label"), F.col(kind).alias("class"), optional.alias("is_optional"), *[F.col(box + c).alias(c) for c in _KEYS[3:]])
        for df, side, pos, value, label, kind, optional, box in sides
    ]
    return matched_sides(rows[0].unionByName(rows[1]), iou)


def matched_sides(rows: DataFrame, iou: float = 0.5, carry: Sequence[str] = ()) -> DataFrame:
    """matched_pages() of both sides in one table (job_id, page, side, pos, value, label, class, is_optional, x0..y1): side 0 is the truth, 1 the records.
    Rows that are dealt by job are not sent again. Columns named in carry come along: the item's, and the record's where no item takes it."""
    rows = rows.select(
        "job_id", "page", "side", F.col("pos").cast("int").alias("pos"), F.lower(strip(F.col("value"))).alias("text"), accounting_number(F.col("value")).alias("amount"), F.lower(strip(F.col("label"))).alias("label"),
        "class", "is_optional", *[F.col(c).cast("double").alias(c) for c in _KEYS[3:]], *carry,
    )
    # a page's rows side by side in their order, as the window needs them
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "page").orderBy("side", "pos")))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(
        _matched(iou, carry),
        f"job_id {kind('job_id')}, page {kind('page')}, item_pos int, record_index int, gt_num double, num double, gt_class string, class string, is_optional boolean, iou double, value_eq boolean, is_match boolean" + "".join(f", `{c}` {kind(c)}" for c in carry),
    )
