"""Structured Streaming forms: intake, decision counts with late data, drift and review with keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspan.operators.filing import filing_states, write_filing_rows
from tallyspan.operators.review_log import act
from tallyspan.sources.intake import intake_gate
from tallyspan.sources.scratch import scratch_dir


def decision_counts(log: DataFrame, late: str = "2 minutes", width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """(start, state, n) of each window; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = log.withWatermark("ts", late).groupBy(w.alias("w"), "state").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "state", "n")


#: transformWithState needs a state store with column families.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Histories(StatefulProcessor):
    """The last set and node number of each entity and metric of a bucket: one call and one state row for many histories."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "entity array<string>, metric array<string>, labels array<string>, node array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        last = {(e, m): (labels, node) for e, m, labels, node in zip(*held)} if held else {}
        out = []
        arrived = pd.concat(list(rows)).sort_values("eval_seq")
        for entity, metric, seq, now in zip(*(arrived[c].tolist() for c in ("entity", "metric", "eval_seq", "labels"))):
            labels, node = last.get((entity, metric), ("", 0))
            changed = node == 0 or now != labels
            last[entity, metric] = (now, node + int(changed))
            out.append((entity, metric, int(seq), node + int(changed), changed))
        self.last.update(tuple(map(list, zip(*[(*k, *v) for k, v in last.items()]))))
        yield pd.DataFrame(out, columns=["entity", "metric", "eval_seq", "node", "changed"])

    def close(self) -> None:
        pass


def drift(sets: DataFrame, buckets: int = 256) -> DataFrame:
    """(entity, metric, eval_seq, node, changed) as filings arrive, as drift_nodes() gives them; state is one small entry a history
    and never expires. Histories are dealt to so many buckets, for calls into Python cost far more than their rows: a batch makes at
    most one call a bucket, however many histories it has. sets (entity, metric, eval_seq, labels): a filing's sorted labels. Sets
    the session's state store."""
    sets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    bucket = F.pmod(F.xxhash64("entity", "metric"), F.lit(buckets)).cast("int").alias("bucket")
    rows = sets.select(bucket, "entity", "metric", "eval_seq", F.to_json("labels").alias("labels"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Histories(), "entity string, metric string, eval_seq int, node int, changed boolean", "Append", "None")


FILE = "path string, modificationTime timestamp, length long, content binary"
REVIEWED = "item_id string, status string, value string, label string, normalized_label string, taxonomy_status string, applied int, rejected int"
REVIEW_STATE = "status string, value string, label string, normalized string, band string, taxonomy string, applied int, rejected int"


def intake(spark: SparkSession, path: str, done: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Files that arrive under path pass the gate; each batch's rows, after process, are written to done/batch=N.

    A batch that is tried again replaces its own folder, so a lost driver leaves neither gaps nor doubles.
    """
    files = spark.readStream.format("binaryFile").schema(FILE).load(path)
    gated = intake_gate(files.select("path", "length", F.substring("content", 1, 4).cast("string").alias("head")))

    def write(batch: DataFrame, number: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{done}/batch={number}")

    return gated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATES = "job_id string, phase int, status string, reason string, batch int"


def intake_filings(files: DataFrame, root: str, process: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Filings as they arrive, from the file gate to tagged rows, with the state of each job; start() runs it.

    files (job_id, length, head and what process needs) is the stream; process turns accepted files into rows as
    filing_rows() gives them. Each batch appends to the status table: queued (or failed at the gate), extracting, then done or
    failed; its rows go to the table of records by outcome, so those that fail are the dead letters. A filing without
    any usable row fails alone. Where process itself raises, the batch's filings are marked failed and the stream stops. Every
    folder carries the batch's number: a batch that is tried again replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        gated = intake_gate(batch)
        accepted, none = gated.where("reason is null").drop("reason"), F.lit(None).cast("string")

        def states(df: DataFrame, phase: int) -> None:
            df.write.mode("overwrite").parquet(f"{root}/status/batch={number}/phase={phase}")

        at_gate = F.when(F.col("reason").isNull(), "queued").otherwise("failed")
        states(gated.select("job_id", at_gate.alias("status"), "reason"), 0)
        states(accepted.select("job_id", F.lit("extracting").alias("status"), none.alias("reason")), 1)
        try:
            found, errors = write_filing_rows(process(accepted), f"{root}/records/batch={number}")
            states(filing_states(accepted, found.union(errors)).select("job_id", "status", "reason"), 2)
        except Exception as e:
            states(accepted.select("job_id", F.lit("failed").alias("status"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("reason")), 2)
            raise

    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)


def filing_jobs(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, status, reason): the latest state of each filing that intake_filings() has seen."""
    seen = spark.read.schema(STATES).option("basePath", f"{root}/status").parquet(f"{root}/status")
    return seen.groupBy("job_id").agg(F.max_by(F.struct("status", "reason"), F.struct("batch", "phase")).alias("s")).select("job_id", "s.*")


def dropped(query: StreamingQuery) -> int:
    """Rows that a stream has dropped as later than its watermark, as its state operators count them: after counts of one batch and window are added up."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


START = {"status": "_s", "value": "_v", "label": "_l", "normalized_label": "_n", "band": "_b", "taxonomy_status": "_t"}


def review(actions: DataFrame, items: DataFrame) -> DataFrame:
    """Items that a batch acted on, as REVIEWED; state is one small row an item.

    actions (item_id, seq, action, new_value, new_label, add_to_taxonomy) is the stream; items
    (item_id, status, value, label, normalized_label, band, taxonomy_status), a table, gives each
    item's start. Within a batch, actions go by seq. The same fold as review_action_replay().
    """
    start = items.select("item_id", *[F.col(c).alias(a) for c, a in START.items()])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq").astype(object)
        rows = rows.where(rows.notna(), None)
        now = tuple(state.get) if state.exists else (*rows.iloc[0][list(START.values())], 0, 0)
        for action in zip(*[rows[c] for c in ("action", "new_value", "new_label", "add_to_taxonomy")]):
            after, why = act(now[:6], *action)
            now = (*after, now[6] + (why is None), now[7] + (why is not None))
        state.update(now)
        yield pd.DataFrame([(key[0], *now[:4], *now[5:])], columns=["item_id", "status", "value", "label", "normalized_label", "taxonomy_status", "applied", "rejected"])

    return actions.join(start, "item_id").groupBy("item_id").applyInPandasWithState(step, REVIEWED, REVIEW_STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(out: DataFrame, mode: str = "append", process: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what its source holds now; the rows of all its batches, with the number of each as _batch.

    process, a chain of batch operators, turns each batch into the rows to write; a batch that is tried again replaces
    its own folder. Batches and checkpoint lie in the shared folder, so a restarted task or driver goes on from there.
    """
    root = f"{scratch_dir(out.sparkSession)}/tallyspan-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{root}/out/_batch={number}")

    q = out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = process(out.sparkSession.createDataFrame([], out.schema)).schema if process else out.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return out.sparkSession.read.schema(f"{kinds}, _batch int").option("basePath", f"{root}/out").parquet(f"{root}/out/*")
