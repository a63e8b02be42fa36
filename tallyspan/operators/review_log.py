"""Review actions of any log length: slices of a log become functions of the state, composed in order.

What an action does depends on little: the item's status, band, whether its label is pending and whether its
value is blank - at most CONTROLS cases - and on a few facts of the action. A slice of a log is therefore a
function on those cases, with the last value and label that it set: cases with one outcome are one entry. Actions
are dealt to tasks by ranges of (item, seq), so a long log lies in many tasks; each task folds its slices for all cases
at once, and a second aggregation applies an item's few slices to its state, in order.

The rules stand once, in act(); the tables of the cases are made from it, and the stream uses it as it is.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.functions.exprs import is_blank
from tallyspan.sources.scratch import stored

STATUSES = ("auto_accepted", "needs_review", "manual_required", "extraction_error", "pending_taxonomy", "locked", "flagged")
BANDS, ACTIONS = ("auto_accepted", "needs_review"), ("edit", "confirm", "batch_confirm", "flag", "unlock")
OTHER = len(STATUSES)  # a status that is none of these
CONTROLS = (OTHER + 1) * 2 * 2 * (len(BANDS) + 1)


def act(state: tuple, action: str, new_value: str | None, new_label: str | None, add: bool | None) -> tuple[tuple, str | None]:
    """State (status, value, label, normalized, band, taxonomy) after one action, and why it is refused, if it is."""
    status, value, label, normalized, band, taxonomy = state
    add = action == "batch_confirm" if add is None else add
    why = None
    if action in ("edit", "flag") and status == "locked":
        why = "item is locked"
    elif action == "edit" and new_label is not None and not new_label.strip():
        why = "label is empty"
    elif action in ("confirm", "batch_confirm") and status == "extraction_error":
        why = "item has an extraction error"
    elif action == "confirm" and status == "pending_taxonomy" and not add:
        why = "label is not in the taxonomy"
    elif action == "unlock" and status != "locked":
        why = "item is not locked"
    elif action not in ACTIONS:
        why = "action is unknown"
    if why:
        return state, why
    if action == "edit":
        label = label if new_label is None else new_label
        value = value if new_value is None else new_value
        if status == "extraction_error" and (value or "").strip():
            status = "needs_review" if band == "needs_review" else "manual_required"
    elif action == "flag" and status != "flagged":
        status = "flagged"
    elif action in ("flag", "unlock"):
        by_band = band if band in BANDS else "manual_required"
        status = "pending_taxonomy" if taxonomy == "pending" else by_band
    else:
        if add and (action == "confirm" or status == "pending_taxonomy" or taxonomy == "pending"):
            taxonomy, normalized = "matched", label if normalized is None else normalized
        status = "locked"
    return (status, value, label, normalized, band, taxonomy), None


def _case(control: int) -> tuple:
    """A state of the case."""
    rest, band = divmod(control, len(BANDS) + 1)
    rest, blank = divmod(rest, 2)
    status, pending = divmod(rest, 2)
    return ((*STATUSES, "another")[status], " " if blank else "v", "l", None, (*BANDS, "another")[band], "pending" if pending else None)


def _control(state: tuple) -> int:
    status, value, _, _, band, taxonomy = state
    place = lambda x, names: names.index(x) if x in names else len(names)
    return ((place(status, STATUSES) * 2 + (taxonomy == "pending")) * 2 + (not (value or "").strip())) * (len(BANDS) + 1) + place(band, BANDS)


@functools.cache
def _table(action: str, value: int, label: int, add: bool | None) -> tuple:
    """For every case: the next one, the refusal (0 for none), and whether value, label and normalized label are set."""
    new_value, new_label = (None, " ", "w")[value], (None, " ", "m")[label]
    after = [act(_case(c), action, new_value, new_label, add) for c in range(CONTROLS)]
    reasons = sorted({why for _, why in after if why})
    refused = np.array([reasons.index(why) + 1 if why else 0 for _, why in after], np.int8)
    done = refused == 0
    edits = done & (action == "edit")
    matched = np.array([s[5] == "matched" for s, _ in after]) & done
    return np.array([_control(s) for s, _ in after]), refused, reasons, edits & (value > 0), edits & (label > 0), matched


def _kind(text: str | None) -> int:
    return 0 if text is None else 2 if text.strip() else 1


class _Slice:
    """The cases after the actions of one item so far."""

    def __init__(self):
        self.now, self.applied, self.n = np.arange(CONTROLS), np.zeros(CONTROLS, np.int64), 0
        self.value, self.label, self.named = (np.full(CONTROLS, -1) for _ in range(3))  # which action set it last; for named, the label of the first match after an edit
        self.matched, self.first = np.zeros(CONTROLS, bool), np.zeros(CONTROLS, bool)  # first: a match under the label that the item came with
        self.texts: dict[int, tuple] = {}

    def add(self, action: str, new_value: str | None, new_label: str | None, add: bool | None) -> tuple[np.ndarray, list[str]]:
        """Refusals by case, and their reasons."""
        following, refused, reasons, sets_value, sets_label, matches = _table(action if action in ACTIONS else "", _kind(new_value), _kind(new_label), add)
        at, k = self.now, self.n
        no = refused[at]
        self.applied += no == 0
        if action == "edit":
            if len(self.texts) > 1000:
                used = {*self.value.tolist(), *self.label.tolist(), *self.named.tolist()}
                self.texts = {i: t for i, t in self.texts.items() if i in used}
            self.texts[k] = new_value, new_label
            self.value[sets_value[at]] = k
            self.label[sets_label[at]] = k
        elif (m := matches[at]).any():
            self.matched |= m
            self.first |= m & (self.label < 0)
            new = m & (self.label >= 0) & (self.named < 0)
            self.named[new] = self.label[new]
        self.now, self.n = following[at], k + 1
        return no, reasons

    def outcomes(self) -> list[dict]:
        found: dict[tuple, list[int]] = {}
        # a status that is none of the known ones stays the item's own; the other parts of the case follow from the fields
        status = self.now // (4 * (len(BANDS) + 1))
        facts = zip(*(x.tolist() for x in (status, self.value, self.label, self.named, self.matched, self.first, self.applied)))
        for case, fact in enumerate(facts):
            found.setdefault(fact, []).append(case)
        text = lambda k, i: self.texts[k][i] if k >= 0 else None
        return [
            {"starts": cases, "status": STATUSES[s] if s < OTHER else None, "value": text(v, 0), "label": text(b, 1), "named": text(n, 1), "matched": m, "first": f, "applied": a, "rejected": self.n - a}
            for (s, v, b, n, m, f, a), cases in found.items()
        ]


_OUTCOME = "starts array<tinyint>, status string, value string, label string, named string, matched boolean, first boolean, applied int, rejected int"
_OUTCOMES = pa.list_(
    pa.struct(
        [("starts", pa.list_(pa.int8())), ("status", pa.string()), ("value", pa.string()), ("label", pa.string()), ("named", pa.string()), ("matched", pa.bool_()), ("first", pa.bool_()), ("applied", pa.int32()), ("rejected", pa.int32())]
    )
)
FIELDS = ("action", "new_value", "new_label", "add_to_taxonomy")


def _slices(refusals: bool):
    """Sorted actions -> a row (item_id, part, outcomes) for each item, and, if asked for, one (item_id, part, seq, reason, starts) for each refusal."""

    def run(batches):
        now, item, part = None, None, None

        def table(ids, parts, outcomes, seqs, reasons, starts, like):
            cols = [pa.array(ids, like["item_id"].type), pa.array(parts, pa.int32()), pa.array(outcomes, _OUTCOMES), pa.array(seqs, like["seq"].type), pa.array(reasons, pa.string()), pa.array(starts, pa.list_(pa.int8()))]
            return pa.RecordBatch.from_arrays(cols, names=["item_id", "part", "outcomes", "seq", "reason", "starts"])

        like = None
        for batch in batches:
            like = {c: batch.column(c) for c in ("item_id", "seq")}
            ids, seqs, part = batch.column("item_id").to_pylist(), batch.column("seq"), batch.column("part")[0].as_py() if batch.num_rows else part
            done, no_ids, no_at, no_why, no_starts = [], [], [], [], []
            for k, (i, *action) in enumerate(zip(ids, *(batch.column(c).to_pylist() for c in FIELDS))):
                if now is None or i != item:
                    if now is not None:
                        done.append((item, now.outcomes()))
                    now, item = _Slice(), i
                refused, reasons = now.add(*action)
                if refusals:
                    for n, why in enumerate(reasons, 1):
                        if len(cases := np.flatnonzero(refused == n)):
                            no_ids.append(i)
                            no_at.append(k)
                            no_why.append(why)
                            no_starts.append(cases.tolist())
            if done:
                yield table([i for i, _ in done], [part] * len(done), [o for _, o in done], [None] * len(done), [None] * len(done), [None] * len(done), like)
            if no_ids:
                yield table(no_ids, [part] * len(no_ids), [None] * len(no_ids), seqs.take(pa.array(no_at)), no_why, no_starts, like)
        if now is not None:
            yield table([item], [part], [now.outcomes()], [None], [None], [None], like)

    return run


def log_slices(actions: DataFrame, refusals: bool = False) -> DataFrame:
    """(item_id, part, outcomes, seq, reason, starts): parts of an item in order of seq; actions of equal seq go by their other fields."""
    rows = actions.where("item_id is not null").select("item_id", "seq", *FIELDS).repartitionByRange("item_id", "seq").sortWithinPartitions("item_id", "seq", *FIELDS)
    kind = lambda c: actions.schema[c].dataType.simpleString()
    return rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        _slices(refusals), f"item_id {kind('item_id')}, part int, outcomes array<struct<{_OUTCOME.replace(' ', ':').replace(',:', ',')}>>, seq {kind('seq')}, reason string, starts array<tinyint>"
    )


def _case_of(s: Column) -> Column:
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)) - 1, F.lit(len(names)))
    pending = F.coalesce(s["taxonomy"] == "pending", F.lit(False)).cast("int")
    return (((place(s["status"], STATUSES) * 2 + pending) * 2 + is_blank(s["value"]).cast("int")) * (len(BANDS) + 1) + place(s["band"], BANDS)).cast("tinyint")


def _after(s: Column, part: Column) -> Column:
    case = _case_of(s)
    o = F.get(F.filter(part["outcomes"], lambda o: F.array_contains(o["starts"], case)), F.lit(0))
    return F.struct(
        F.coalesce(o["status"], s["status"]).alias("status"), F.coalesce(o["value"], s["value"]).alias("value"), F.coalesce(o["label"], s["label"]).alias("label"),
        F.coalesce(s["normalized"], F.when(o["first"], s["label"]), o["named"]).alias("normalized"), s["band"].alias("band"), F.when(o["matched"], "matched").otherwise(s["taxonomy"]).alias("taxonomy"),
        (s["applied"] + o["applied"]).alias("applied"), (s["rejected"] + o["rejected"]).alias("rejected"),
    )


def _with_parts(items: DataFrame, slices: DataFrame) -> tuple[DataFrame, Column]:
    """items with their parts in order, and the state they start from."""
    parts = slices.where("outcomes is not null").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("part", "outcomes"))).alias("parts"))
    rows = items.join(parts, "item_id", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.array().cast(parts.schema["parts"].dataType)))
    start = F.struct("status", "value", "label", F.col("normalized_label").alias("normalized"), "band", F.col("taxonomy_status").alias("taxonomy"), F.lit(0).alias("applied"), F.lit(0).alias("rejected"))
    return rows, start


def review_action_replay(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Each item after its actions in order of seq, however many: (item_id, status, value, label, normalized_label, taxonomy_status, applied, rejected).

    items (item_id, status, value, label, normalized_label, band, taxonomy_status); actions (item_id, seq,
    action, new_value, new_label, add_to_taxonomy). A refused action changes nothing and is counted. In an edit a
    null value or label stays as it was; where add_to_taxonomy is null, a batch confirm adds a pending label and a
    single confirm does not.
    """
    rows, start = _with_parts(items, log_slices(actions))
    end = rows.select("item_id", F.aggregate("parts", start, _after).alias("e"))
    return end.select("item_id", "e.status", "e.value", "e.label", F.col("e.normalized").alias("normalized_label"), F.col("e.taxonomy").alias("taxonomy_status"), "e.applied", "e.rejected")


def review_rejects(items: DataFrame, actions: DataFrame) -> DataFrame:
    """(item_id, seq, reason): one row for each refused action. Slices are stored, as both their functions and their refusals are read."""
    slices = stored(log_slices(actions, refusals=True))
    rows, start = _with_parts(items, slices)
    at = F.struct(start.alias("s"), F.array().cast("array<struct<part:int,case:tinyint>>").alias("cases"))
    step = lambda acc, part: F.struct(_after(acc["s"], part).alias("s"), F.array_append(acc["cases"], F.struct(part["part"].alias("part"), _case_of(acc["s"]).alias("case"))).alias("cases"))
    begun = rows.select("item_id", F.explode(F.aggregate("parts", at, step)["cases"]).alias("c")).select("item_id", "c.part", "c.case")
    refused = slices.where("reason is not null").select("item_id", "part", "seq", "reason", "starts")
    return refused.join(begun, ["item_id", "part"]).where(F.array_contains("starts", F.col("case"))).select("item_id", "seq", "reason")
