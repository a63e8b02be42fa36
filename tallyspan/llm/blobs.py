"""Counting 64-bit keys as packed arrays: a few large rows in place of one row for each key.

Tasks gather (key, owner, weight), deal them to buckets by key and send each bucket one row of
packed arrays; a bucket's rows meet in one task, which sees every key with all its owners.
Bucket sizes follow the data divided by the number of buckets, whatever single keys weigh.

Beyond LANES buckets a row goes two ways: gathering tasks deal to lanes, each a set of buckets, and tasks
that hold rows of one lane deal these to its buckets. So a row keeps about FLUSH / LANES keys at any number of buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import ship

ship(__name__)

SCHEMA = "bucket int, keys binary, checks binary, owner_of binary, owners binary, weights binary"
#: Keys that a task gathers before it sends them.
FLUSH = 2_000_000
#: Buckets that a task deals to at once.
LANES = 1000


class Gather:
    """Collects keys of owners; batches() yields packed rows."""

    def __init__(self, buckets: int, flush: int = FLUSH, lanes: int = LANES):
        self.buckets, self.flush, self.lanes = buckets, flush, lanes
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.owner_of, self.owners, self.weights, self.n = [], [], [], [], [], 0
        self.n_owners = 0

    def add(self, keys: np.ndarray, checks: np.ndarray | None, owner_of: np.ndarray, owners: np.ndarray, weights: np.ndarray) -> None:
        """keys[i] belongs to owners[owner_of[i]], which stands for weights[...] equal texts."""
        self.keys.append(keys)
        self.checks.append(np.zeros(0, "<u4") if checks is None else checks)
        self.owner_of.append(owner_of.astype("<u4") + np.uint32(self.n_owners))
        self.owners.append(owners)
        self.weights.append(weights)
        self.n, self.n_owners = self.n + len(keys), self.n_owners + len(owners)

    def batches(self, last: bool = False):
        if not self.n or (self.n < self.flush and not last):
            return
        keys, owner_of = np.concatenate(self.keys), np.concatenate(self.owner_of)
        checks = np.concatenate(self.checks)
        owners, weights = np.concatenate(self.owners).astype("<i8"), np.concatenate(self.weights).astype("<u1")
        self.clear()
        bucket = (keys % np.uint64(self.buckets)).astype(np.int32)
        if self.lanes and self.buckets > self.lanes:
            bucket %= np.int32(self.lanes)
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)].tolist()
        rows: dict[str, list] = {k: [] for k in ("bucket", "keys", "checks", "owner_of", "owners", "weights")}
        for x, y in zip(cuts, cuts[1:]):
            take = order[x:y]
            b = int(bucket[take[0]])
            own, local = np.unique(owner_of[take], return_inverse=True)
            one = (b, keys[take].tobytes(), checks[take].tobytes() if len(checks) else b"", local.astype("<u4").tobytes(), owners[own].tobytes(), weights[own].tobytes())
            for k, v in zip(rows, one):
                rows[k].append(v)
        kinds = {"bucket": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()], names=list(rows))


def _to_buckets(buckets: int, flush: int):
    """Rows of lanes, sorted by lane -> rows of buckets."""

    def run(batches):
        out, lane = Gather(buckets, flush, 0), None
        for batch in batches:
            for k, of in enumerate(batch.column("bucket").to_pylist()):
                if of != lane:
                    yield from out.batches(last=True)
                    lane = of
                row = {c: batch.column(c)[k].as_py() for c in ("keys", "checks", "owner_of", "owners", "weights")}
                kinds = {"keys": "<u8", "checks": "<u4", "owner_of": "<u4", "owners": "<i8", "weights": "<u1"}
                got = {c: np.frombuffer(v, kinds[c]) for c, v in row.items()}
                out.add(got["keys"], got["checks"] if len(got["checks"]) else None, got["owner_of"], got["owners"], got["weights"])
                yield from out.batches()
        yield from out.batches(last=True)

    return run


def by_bucket(gathered: DataFrame, buckets: int, flush: int = FLUSH, lanes: int = LANES) -> DataFrame:
    """Packed rows of buckets from what Gather(buckets) has dealt: a second hop where there are more buckets than lanes. Tasks of the
    hop hold about a bucket's share of one lane each, so a hot lane is split, too."""
    if buckets <= lanes:
        return gathered
    share = F.pmod(F.xxhash64("keys"), F.lit(-(-buckets // lanes)))
    return gathered.repartition("bucket", share).sortWithinPartitions("bucket").mapInArrow(_to_buckets(buckets, flush), SCHEMA)


def unpack(table: pa.Table):
    """keys, checks (or None), owners and weights, one entry for each key."""
    cols = {c: table.column(c).to_pylist() for c in ("keys", "checks", "owner_of", "owners", "weights")}
    keys = np.concatenate([np.frombuffer(x, "<u8") for x in cols["keys"]])
    checks = np.concatenate([np.frombuffer(x, "<u4") for x in cols["checks"]])
    owners = np.concatenate([np.frombuffer(o, "<i8")[np.frombuffer(i, "<u4")] for o, i in zip(cols["owners"], cols["owner_of"])])
    weights = np.concatenate([np.frombuffer(w, "<u1")[np.frombuffer(i, "<u4")] for w, i in zip(cols["weights"], cols["owner_of"])])
    return keys, checks if len(checks) else None, owners, weights


def repeated_keys(table: pa.Table) -> pa.Table:
    """(owner, key): each owner's keys of a bucket that occur twice or more in all."""
    keys, checks, owners, weights = unpack(table)
    order = np.lexsort((checks, keys)) if checks is not None else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if checks is not None:
        c = checks[order]
        new[1:] |= c[1:] != c[:-1]
    run = np.cumsum(new) - 1
    total = np.bincount(run, weights[order])
    many = order[total[run] >= 2]
    own, key = owners[many], keys[many]
    o = np.lexsort((key, own))
    own, key = own[o], key[o]
    if len(own):
        keep = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
        own, key = own[keep], key[keep]
    return pa.table({"owner": pa.array(own, pa.int64()), "key": pa.array(key.view(np.int64), pa.int64())})


REPEATED = "owner long, key long"


def key_lists(column: pa.ListArray) -> list[np.ndarray]:
    """The keys of each row of an array<long> column."""
    values, at = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at - at[0], at[1:] - at[0])]
