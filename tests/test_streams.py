"""Streams against the batch forms of the same work."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tallyspan.operators import drift, review, review_log
from tallyspan.plans import stream_queries
from tallyspan.streaming import jobs

ACTIONS = "item_id string, seq int, action string, new_value string, new_label string, add_to_taxonomy boolean"
ITEMS = "item_id string, status string, value string, label string, normalized_label string, band string, taxonomy_status string"


def test_review_batch_equals_stream(spark, tmp_path):
    rng = random.Random(5)
    starts = [
        (str(i), rng.choice(["extraction_error", "pending_taxonomy", "needs_review", "locked"]), rng.choice(["", "1", None]), f"l{i}", rng.choice([None, "n"]), rng.choice(["needs_review", "manual_required", "auto_accepted"]), rng.choice(["pending", "matched", None]))
        for i in range(30)
    ]
    log = [
        (str(rng.randrange(30)), s, rng.choice(["edit", "confirm", "batch_confirm", "flag", "unlock", "edit", "other"]), rng.choice(["2", " ", None]), rng.choice(["new", " ", "", None, None]), rng.choice([True, False, None]))
        for s in range(600)
    ]
    items = spark.createDataFrame(starts, ITEMS)
    acts = spark.createDataFrame(log, ACTIONS)
    want = {r.item_id: tuple(r)[1:] for r in review_log.review_action_replay(items, acts).collect()}

    source = str(tmp_path / "in")
    seen = {}
    for lo in (0, 200, 400):  # three starts of one query: state must outlive each
        acts.where(f"seq >= {lo} and seq < {lo + 200}").coalesce(1).write.mode("append").parquet(source)
        out = jobs.review(spark.readStream.schema(ACTIONS).parquet(source), items)
        target = str(tmp_path / f"out{lo}")
        q = out.writeStream.foreachBatch(lambda b, n, t=target: b.write.mode("overwrite").parquet(f"{t}/{n}")).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        for r in spark.read.parquet(f"{target}/*").collect():
            seen[r.item_id] = tuple(r)[1:]
    assert {k: seen.get(k) for k in seen} == {k: want[k] for k in seen} and set(seen) == {a[0] for a in log}


def test_review_cases(spark):
    """Cases of one item each: start, actions, end."""
    cases = [
        # a corrected value mends an extraction error, an empty one does not; the label may stay
        (("extraction_error", "", "l", None, "needs_review", None), [("edit", "5", None, None)], ("needs_review", "5", "l", None, None, 1, [])),
        (("extraction_error", "", "l", None, "auto_accepted", None), [("edit", "5", None, None)], ("manual_required", "5", "l", None, None, 1, [])),
        (("extraction_error", "", "l", None, "needs_review", None), [("edit", None, "m", None)], ("extraction_error", "", "m", None, None, 1, [])),
        # a refused edit writes neither value nor label
        (("needs_review", "1", "l", None, "needs_review", None), [("edit", "5", " ", None)], ("needs_review", "1", "l", None, None, 0, ["label is empty"])),
        # a pending label needs the word of the reviewer; a flagged one does not
        (("pending_taxonomy", "1", "l", None, "needs_review", "pending"), [("confirm", None, None, None)], ("pending_taxonomy", "1", "l", None, "pending", 0, ["label is not in the taxonomy"])),
        (("pending_taxonomy", "1", "l", None, "needs_review", "pending"), [("confirm", None, None, True)], ("locked", "1", "l", "l", "matched", 1, [])),
        (("flagged", "1", "l", None, "needs_review", "pending"), [("confirm", None, None, None)], ("locked", "1", "l", None, "pending", 1, [])),
        # flags toggle, locks stop them, unlocking returns to the first status
        (("needs_review", "1", "l", "n", "auto_accepted", "matched"), [("flag",) + (None,) * 3, ("flag",) + (None,) * 3], ("auto_accepted", "1", "l", "n", "matched", 2, [])),
        (("locked", "1", "l", "n", "needs_review", "matched"), [("flag",) + (None,) * 3, ("edit", "2", "x", None), ("unlock",) + (None,) * 3], ("needs_review", "1", "l", "n", "matched", 1, ["item is locked"] * 2)),
        (("pending_taxonomy", "1", "l", None, "needs_review", "pending"), [("batch_confirm",) + (None,) * 3], ("locked", "1", "l", "l", "matched", 1, [])),
        (("pending_taxonomy", "1", "l", None, "needs_review", "pending"), [("batch_confirm", None, None, False)], ("locked", "1", "l", None, "pending", 1, [])),
        (("needs_review", "1", "l", None, "needs_review", None), [], ("needs_review", "1", "l", None, None, 0, [])),
    ]
    items = spark.createDataFrame([(str(i), *c[0]) for i, c in enumerate(cases)], ITEMS)
    acts = spark.createDataFrame([(str(i), k, *a) for i, c in enumerate(cases) for k, a in enumerate(c[1])], ACTIONS)
    whys = {}
    for r in sorted(review_log.review_rejects(items, acts).collect(), key=lambda r: r.seq):
        whys.setdefault(r.item_id, []).append(r.reason)
    out = review_log.review_action_replay(items, acts).collect()
    got = {r.item_id: (r.status, r.value, r.label, r.normalized_label, r.taxonomy_status, r.applied, whys.get(r.item_id, [])) for r in out}
    assert got == {str(i): c[2] for i, c in enumerate(cases)}
    assert {r.item_id: r.rejected for r in out} == {str(i): len(c[2][6]) for i, c in enumerate(cases)}


def folded(state, log):
    """One action after the other."""
    state, applied, whys = tuple(state), 0, []
    for seq, *action in log:
        state, why = review_log.act(state, *action)
        applied += why is None
        whys += [(seq, why)] if why else []
    return (*state[:4], state[5], applied), whys


@pytest.mark.parametrize("parts", [1, 7])
def test_composed_slices_equal_the_fold(spark, parts):
    """Every case of the start, logs cut anywhere, statuses and bands that are not known, repeated seq, an action without item."""
    rng = random.Random(parts)
    pick = lambda *x: rng.choice(x)
    starts = [(str(i), pick(*review_log.STATUSES, "odd", None), pick("", "1", None), pick("l", None), pick(None, None, "n"), pick("needs_review", "auto_accepted", "x", None), pick("pending", "matched", None)) for i in range(120)]
    action = lambda: (pick("edit", "confirm", "batch_confirm", "flag", "unlock", "other", None), pick("2", " ", "é", None), pick("new", "m", " ", None), pick(True, False, None))
    log = [(str(rng.randrange(118)), s, *action()) for s in range(2500)] + [(None, 1, *action())]
    items, acts = spark.createDataFrame(starts, ITEMS), spark.createDataFrame(log, ACTIONS)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.item_id: tuple(r)[1:] for r in review_log.review_action_replay(items, acts).collect()}
        whys = sorted((r.item_id, r.seq, r.reason) for r in review_log.review_rejects(items, acts).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, refused = {}, []
    for i, *start in starts:
        mine = sorted((a[1:] for a in log if a[0] == i), key=lambda a: a[0])
        order = lambda s: (s[0], s[1], s[2], s[3], s[4], s[5])
        end, no = folded(order(start), mine)
        want[i] = (*end, len(no))
        refused += [(i, *x) for x in no]
    assert got == want and whys == sorted(refused)
    empty = review_log.review_action_replay(items, acts.limit(0)).collect()
    assert len(empty) == 120 and all(r.applied == r.rejected == 0 for r in empty) and review_log.review_rejects(items.limit(0), acts).count() == 0


def test_a_million_actions_of_one_item(spark):
    n = 1_000_000
    items = spark.createDataFrame([("hot", "extraction_error", None, "l", None, "needs_review", "pending"), ("cold", "needs_review", "1", "l", None, "needs_review", None)], ITEMS)
    kinds = "array('edit', 'confirm', 'flag', 'unlock', 'batch_confirm', 'flag', 'edit')"
    acts = spark.range(n, numPartitions=8).selectExpr(
        "if(id = 77, 'cold', 'hot') as item_id", "int(id) as seq", f"{kinds}[int(xxhash64(id) & 7) % 7] as action", "if(id % 3 = 0, 'v' || id, null) as new_value", "case id % 5 when 0 then 'n' || id when 1 then ' ' end as new_label", "id % 2 = 0 as add_to_taxonomy"
    )
    began = time.time()
    got = {r.item_id: tuple(r)[1:] for r in review_log.review_action_replay(items, acts).collect()}
    took = time.time() - began
    log = {"hot": [], "cold": []}
    for r in acts.toLocalIterator():
        log[r.item_id].append(tuple(r)[1:])
    for i, *start in items.collect():
        end, no = folded(start, log[i])
        assert got[i] == (*end, len(no))
    assert took < 120


def test_batch_confirm(spark):
    rows = [("a", "needs_review", "la", "n", "matched", True), ("b", "pending_taxonomy", "lb", None, "pending", True), ("c", "extraction_error", "lc", None, None, True), ("d", "needs_review", "ld", "n", "matched", False), ("e", "locked", "le", "n", "matched", False), ("f", "flagged", "lb", "", "pending", False)]
    items = spark.createDataFrame(rows, "id string, status string, label string, normalized_label string, taxonomy_status string, is_candidate boolean")

    def run(*args, **kw):
        out, terms, ids = review.batch_confirm(items, *args, **kw)
        return {r.id: (r.status, r.taxonomy_status, r.normalized_label) for r in out.collect()}, sorted(r.term for r in terms.collect()), sorted(r.id for r in ids.collect())

    out, terms, ids = run()
    assert (terms, ids) == (["lb"], ["a", "b", "e"]) and out["b"] == ("locked", "matched", "lb") and out["c"][0] == "extraction_error" and out["d"][0] == "needs_review"
    assert run(candidates_only=False)[1:] == (["lb"], ["a", "b", "d", "e", "f"])
    out, terms, ids = run(spark.createDataFrame([("b",), ("b",), ("c",)], "id string"), auto_add=False)
    assert (terms, ids) == ([], ["b", "e"]) and out["b"] == ("locked", "pending", None)


def test_intake_stream(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (folder / "b.pdf").write_bytes(b"")
    args = (str(folder), str(tmp_path / "done"), str(tmp_path / "ck"))
    jobs.intake(spark, *args).awaitTermination(120)
    (folder / "c.txt").write_bytes(b"\xff\xfehello")
    jobs.intake(spark, *args).awaitTermination(120)
    jobs.intake(spark, *args).awaitTermination(120)
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.parquet(str(tmp_path / "done")).collect()}
    assert got == {"a.pdf": None, "c.txt": "file is not a PDF"}  # Spark's file sources list no empty files


def test_drift_by_metric(spark):
    rows = [("e", m, y, x) for m, y, xs in (("A", 1, "ab"), ("B", 1, "c"), ("A", 2, "ab"), ("B", 2, "cd"), ("A", 3, "b")) for x in xs]
    keys = ("entity", "metric")
    sets = drift.locked_labels(spark.createDataFrame(rows, "entity string, metric string, eval_seq int, normalized_label string"), keys)
    compared = drift.drift_compare(sets, keys)
    out = {(r.metric, r.eval_seq): (r.node, r.kind) for r in drift.drift_export(compared).collect()}
    assert out == {("A", 1): (1, "baseline"), ("A", 2): (1, "continuation"), ("A", 3): (2, "redefinition"), ("B", 1): (1, "baseline"), ("B", 2): (2, "redefinition")}
    assert {r.metric for r in drift.drift_export(compared, "e", "B").collect()} == {"B"} and drift.drift_export(compared, "x").count() == 0
    assert {(r.metric, r.eval_seq, r.from_node, r.to_node) for r in drift.drift_edges(compared, keys).collect()} == {("A", 2, 1, 1), ("A", 3, 1, 2), ("B", 2, 1, 2)}


def test_run_available_twice(spark):
    """Two runs have folders of their own; a sink that is run again replaces its keys alone."""
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "k int, b int")
    from tallyspan.sources import intake, snapshots
    from tallyspan.sources.scratch import scratch_dir

    root = f"{scratch_dir(spark)}/sink-{uuid.uuid4().hex}"
    rows.write.parquet(root + "/in")
    for _ in range(2):
        out = jobs.run_available(spark.readStream.schema(rows.schema).parquet(root + "/in").where("b = 1"))
        assert sorted(r.k for r in out.collect()) == [1, 4, 7]
    intake.stage_sink(rows, root + "/t", "stage", "b")
    intake.stage_sink(rows.where("b = 1").selectExpr("k + 100 AS k", "b"), root + "/t", "stage", "b")
    assert sorted(r.k for r in snapshots.read(spark, root + "/t", "stage").collect()) == [0, 2, 3, 5, 6, 8, 101, 104, 107]


def test_run_available_with_a_chain(spark, tmp_path):
    """Each batch goes through batch operators; a source of several files is read in several batches, and an empty one gives no rows."""
    rows = spark.range(40).select((F.col("id") % 5).alias("k"), "id").repartition(4, "k")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_available(stream, process=lambda batch: batch.groupBy("k").agg(F.sum("id").alias("total")))
    assert {r.k: r.total for r in out.collect()} == {k: sum(range(k, 40, 5)) for k in range(5)}
    assert out.select("_batch").distinct().count() > 1 and out.columns == ["k", "total", "_batch"]


def test_sliding_counts_take_times_in_whole_milliseconds(spark, tmp_path):
    """An event 0.4 ms before a window's start is in that window, as in the SQL; one 0.6 ms before it is not."""
    rows = [(2, "2024-01-01 00:00:19.999601"), (3, "2024-01-01 00:05:19.999499")]
    spark.createDataFrame(rows, "event_id long, ts string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "'click' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.start.strftime("%M:%S") for r in stream_queries.stream_decision_counts_sliding(spark, str(tmp_path)).collect()}
    assert got == {"59:30", "59:40", "59:50", "00:00", "00:10", "00:20"} | {"04:20", "04:30", "04:40", "04:50", "05:00", "05:10"}
