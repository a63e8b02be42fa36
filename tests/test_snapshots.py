"""Tables replaced together or not at all."""

import pytest
from pyspark.sql import functions as F

from tallyspan.sources import corpus, intake, snapshots

NODES = "entity string, metric string, eval_seq int, node int"


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    root = str(tmp_path / "drift")
    old = spark.createDataFrame([("e", "m", 1, 1), ("e", "n", 1, 1)], NODES)
    corpus.drift_store(old, old.limit(1), root)
    new = spark.createDataFrame([("e", "m", 1, 7), ("e", "m", 2, 8), ("f", "m", 1, 9)], NODES)
    fails = new.withColumn("node", F.when(F.col("node") < 9, F.col("node")).otherwise(F.raise_error(F.lit("no more"))).cast("int"))
    with pytest.raises(Exception, match="no more"):
        corpus.drift_store(new, fails, root)
    state = lambda: [sorted(map(tuple, t.collect())) for t in corpus.drift_load(spark, root)]
    was = [[("e", "m", 1, 1), ("e", "n", 1, 1)], [("e", "m", 1, 1)], [("e", "m", 1), ("e", "n", 1)]]
    assert state() == was
    held = corpus.drift_load(spark, root)  # a reader that began before the next commit
    assert corpus.drift_store(new, new.limit(0), root) == 2
    assert [sorted(map(tuple, t.collect())) for t in held] == was
    assert state() == [[("e", "m", 1, 7), ("e", "m", 2, 8), ("f", "m", 1, 9)], [], [("e", "m", 8), ("f", "m", 9)]]
    assert sorted(map(tuple, snapshots.read(spark, root, "edges", 1).collect())) == was[1]
    assert snapshots.vacuum(spark, root) == 5 and state()[2] == [("e", "m", 8), ("f", "m", 9)]  # three folders of the first commit, two of the failed


def test_a_stage_is_replaced_by_job(spark, tmp_path):
    root = str(tmp_path / "stages")
    rows = lambda jobs, n, run: spark.createDataFrame([(j, k, run) for j in jobs for k in range(n)], "job_id string, record_index int, run string")
    jobs = [f"j{k}" for k in range(300)] + [None]
    intake.stage_sink(rows(jobs, 3, "a"), root, "scored")
    intake.stage_sink(rows(jobs[:5] + ["new", None], 1, "b"), root, "scored")
    fails = rows(jobs[:50], 3, "c").withColumn("run", F.when(F.col("job_id") != "j49", F.col("run")).otherwise(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        intake.stage_sink(fails, root, "scored")
    got = {}
    for r in snapshots.read(spark, root, "scored").collect():
        got.setdefault(r.job_id, []).append(r.run)
    assert got == {**{j: ["a"] * 3 for j in jobs[5:-1]}, **{j: ["b"] for j in jobs[:5] + ["new", None]}}
    with pytest.raises(ValueError):
        intake.stage_sink(rows(jobs, 1, "x").drop("run"), root, "scored")
    intake.stage_sink(rows(["a"], 1, "b").limit(0), root, "other")
    assert snapshots.read(spark, root, "other").count() == 0 and snapshots.read(spark, root, "scored").count() == 295 * 3 + 7


def test_of_two_commits_on_one_state_one_fails(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(3)
    assert snapshots.latest(spark, root) == 0 and snapshots.commit(spark, root, {"x": df}) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots._publish(spark, root, 1, {})
    assert snapshots.read(spark, root, "x").count() == 3
