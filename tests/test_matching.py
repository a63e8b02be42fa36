"""Matching from ordered pools equals a plain loop, on pages of any size."""

import time

import numpy as np
import pytest

from tallyspan.operators import evaluate, matching

GT = "job_id string, page int, item_pos int, gt_value string, gt_label string, gt_class string, is_optional boolean, gx0 double, gy0 double, gx1 double, gy1 double"
EXT = "job_id string, page int, record_index int, value string, label string, class string, x0 double, y0 double, x1 double, y1 double"


def plain(items, records, least):
    used, out = set(), []
    for item in items:
        best = (-1.0, -1, 0.0, False)
        for r, x in enumerate(records):
            if r not in used:
                v, value, label = matching.overlap(item[3:7], x[3:7]), matching.equal_values(item, x), item[2] is not None and item[2] == x[2]
                score = v * 2 + 2 * value + label
                if score > best[0] and (v >= least or value or label):
                    best = (score, r, v, value)
        used.add(best[1])
        out.append(best[1:])
    return out


def some_rows(rng, n, kinds, boxes, spread):
    amount = rng.integers(0, kinds, n)
    out = []
    for k in range(n):
        text = [f"{amount[k]}", f"{amount[k] + 0.0005}", f"{amount[k]}.00", "n/a", "none", None][rng.choice(6, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])]
        number = float(text) if text and text[0].isdigit() else None
        label = [None, "a", "b", "c"][rng.choice(4, p=[0.1, 0.5, 0.2, 0.2])]
        x, y, w, h = (float(v) for v in (*rng.integers(0, boxes, 2) * spread, *rng.integers(0, 4, 2) * spread * 2))
        box = (x, y, x + w, y + h) if rng.random() > 0.05 else (None, y, x, None)
        out.append((text, number, label, *box))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_pools_equal_a_plain_loop(seed):
    rng = np.random.default_rng(seed)
    items, records = (some_rows(rng, int(rng.integers(17, 90)), (2, 8, 60)[seed % 3], (3, 12, 40)[seed // 3 % 3], (1, 7.5, 100)[seed // 9 % 3]) for _ in range(2))
    for least in (0.5, 0.05, 0.0001):
        assert matching.match_page(items, records, least) == plain(items, records, least)
        assert matching._pair_by_pair(items, records, least) == plain(items, records, least)


def test_halves_round_as_columns_do(spark):
    x = [k / 20_000 for k in range(1, 20_000, 7)] + [0.03125, 0.12345, 1 / 3, 2.675]
    df = spark.createDataFrame([(v,) for v in x], "x double").selectExpr("x", "bround(x, 4) as y")
    assert all(matching.rounded(r.x) == r.y for r in df.collect())


def frames(spark, gt, ext):
    return spark.createDataFrame(gt, GT), spark.createDataFrame(ext, EXT)


def test_one_label_on_a_page_of_100_000_rows(spark):
    """What a plain loop gives follows from the rows: every box lies apart, values are unique, indices reversed."""
    n = 50_000
    at = lambda k: (float(k % 250 * 4), float(k // 250 * 5), float(k % 250 * 4 + 3), float(k // 250 * 5 + 4))
    gt = [("j", 1, k, f"{k}", "Same label", "c", False, *at(k)) for k in range(n)]
    # a third of the records keep box and value, a third the value alone, and the last third only the label
    ext = [("j", 1, n - 1 - k, f"{k}" if k % 3 < 2 else f"{-k - 1}", "same LABEL ", "c", *(at(k) if k % 3 == 0 else (2000.0, 2000.0, 2000.0, 2000.0))) for k in range(n)]
    df = frames(spark, gt, ext)
    began = time.time()
    got = {r.item_pos: (r.record_index, r.iou, r.value_eq) for r in evaluate.matched_pages(*df).where("is_match").collect()}
    took = time.time() - began
    used, least = bytearray(n), 0
    for k in range(n):
        own = n - 1 - k
        if k % 3 < 2 and not used[own]:
            want = (own, 1.0 if k % 3 == 0 else 0.0, True)
        else:  # only the label is left: the least index of all, whatever it would suit better later
            while used[least]:
                least += 1
            want = (least, 0.0, False)
        used[want[0]] = 1
        assert got[k] == want, k
    assert len(got) == n and took < 60


def test_large_page_equals_a_plain_loop_in_spark(spark):
    rng = np.random.default_rng(5)
    rows = lambda n: some_rows(rng, n, 40, 60, 10.0)
    gt, ext = [], []
    for job, page, n in (("a", 1, 700), ("a", 2, 3), ("b", 1, 40), ("b", 2, 0), (None, 1, 4)):
        gt += [(job, page, k, x[0], x[2], "c", k % 5 == 0, *x[3:7]) for k, x in enumerate(rows(n))]
        ext += [(job, page, 2 * k + 1, x[0], x[2], "d", *x[3:7]) for k, x in enumerate(rows(n + 3))]
    g, x = frames(spark, gt, ext)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = evaluate.matched_pages(g, x).collect()
        g2, x2 = frames(spark, [("z", 1, *r[2:]) for r in gt if r[0] == "a" and r[1] == 1], [("z", 1, *r[2:]) for r in ext if r[0] == "a" and r[1] == 1])
        pairs = evaluate.match_candidates(g2, x2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == len(gt) + len(ext) - sum(r.is_match for r in out)
    for job, page in {(r[0], r[1]) for r in gt + ext}:
        side = lambda rows, v, l, b: [(None if r[v] is None else r[v].lower(), float(r[v]) if r[v] and r[v][0].isdigit() else None, r[l], *r[b : b + 4]) for r in rows if (r[0], r[1]) == (job, page)]  # noqa: E731, E741
        items, records = side(gt, 3, 4, 7), side(ext, 3, 4, 6)
        want = {(k, 2 * r + 1 if r >= 0 else None) for k, (r, _, _) in enumerate(plain(items, records, 0.5))}
        assert {(r.item_pos, r.record_index) for r in out if (r.job_id, r.page) == (job, page) and r.item_pos is not None} == want
        if (job, page) == ("a", 1):
            can = {(i, 2 * r + 1) for i, a in enumerate(items) for r, b in enumerate(records) if matching.overlap(a[3:7], b[3:7]) >= 0.5 or matching.equal_values(a, b) or (a[2] is not None and a[2] == b[2])}
            assert len(pairs) == len(can) and {(p.item_pos, p.record_index) for p in pairs} == can
    empty = frames(spark, [], [])
    assert evaluate.item_diffs(*empty).count() == 0 and evaluate.match_candidates(*empty).count() == 0


def test_candidates_of_small_pages_take_one_join(spark):
    """Each side is sent once; pages of more items go by keys and give the same pairs."""
    gt = spark.createDataFrame([("a", 1 + i % 2, i, ["10", "(10)", "x", None][i % 4], f"L{i % 3}", "c", False, 0.0, i * 5.0, 60.0, i * 5.0 + 15) for i in range(40)], "job_id string, page int, item_pos int, gt_value string, gt_label string, gt_class string, is_optional boolean, gx0 double, gy0 double, gx1 double, gy1 double")
    ext = spark.createDataFrame([("a", 1 + i % 2, i, ["10.0005", "-10", "X ", None][i % 4], f"l{i % 5}", "c", 0.0, i * 5.0, 60.0, i * 5.0 + 14) for i in range(50)], "job_id string, page int, record_index int, value string, label string, class string, x0 double, y0 double, x1 double, y1 double")
    small = evaluate.match_candidates(gt, ext)
    got = sorted(map(repr, small.collect()))
    assert got and got == sorted(map(repr, evaluate.match_candidates(gt, ext, most=1).collect()))
    some = gt.where("page = 1 or item_pos < 10")  # one page by keys, one whole
    assert sorted(map(repr, evaluate.match_candidates(some, ext, most=10).collect())) == sorted(map(repr, evaluate.match_candidates(some, ext).collect()))
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
