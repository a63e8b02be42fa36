"""SimHash near-dedup with a segment-popcount embedding.

A document's fingerprint takes each of 64 bits by majority over the hashes of its word
shingles. The 64 bits are cut into 32 segments of two; the segments' bit counts are a point
in {0, 1, 2}^32, and the Manhattan distance of two points never exceeds the Hamming
distance of their fingerprints. The range join under that distance is a grid join: the 32
coordinates are dealt to g sub-grids, and of two points at distance four or less at least g - 4
sub-grids hold both at the same place, so they share the cell of some g - 4 sub-grids. More
sub-grids make smaller cells and more of them; g follows from the number of fingerprints, and
every choice finds every pair. There are two more of them than bits at least: cells of one sub-grid hold
too many fingerprints even of a small corpus. Within a cell the bound (first on the whole count, then by byte)
leaves few pairs, which are verified on the bits themselves.

Equal fingerprints are one node. Cells of any size are cut into blocks that meet pairwise,
and a block gives the links of a spanning forest, so neither a task nor a result holds all
pairs of a group; distributed connected components join the forests.

Defined results: null or wordless texts have fingerprint zero, linked like any other; fewer
words than a shingle are one shingle; repeated rows and ties share their fingerprint's
component; rows with a null doc_id get an answer but never name a component unless it has no
other row; an empty table gives an empty result; columns other than doc_id and text are
ignored by fingerprints().
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspan.llm.common import connected_components, in_cells, join_by_class, least_linked, least_reachable, mix, ship, small_and_large_runs, stored, texts

ship(__name__)

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENT_BITS, BLOCK = 2, 1500
#: What sending a fingerprint to one more cell costs, in pairs compared.
SEND = 200
#: Cells of so few rows are compared together, row by row's neighbours, in place of one by one.
FEW = 64
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())], "<u8")
    # votes of all 64 bits from counts of each byte's 256 values
    cells = h.view(np.uint8).reshape(n, 8).astype(np.int64) + np.arange(8) * 256
    votes = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int(np.packbits((2 * votes > n).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray, bits: int = SEGMENT_BITS) -> np.ndarray:
    """(n, 64 / bits) bit counts of the segments."""
    one = np.unpackbits(fp.view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little")
    return one.reshape(len(fp), 64 // bits, bits).sum(axis=2, dtype=np.uint8)


def sub_grids(n: int, distance: int = DISTANCE) -> int:
    """The number of sub-grids for which n fingerprints take the least work.

    A cell of k segments holds a share of about (3 / 8) ^ k of all: two random segments of two bits have the
    same count with that probability.
    """
    segments = 64 // SEGMENT_BITS

    def work(g: int) -> float:
        return math.comb(g, distance) * (SEND + n * (3 / 8) ** (segments * (g - distance) / g))

    return min(range(distance + 2, segments + 1), key=work)


def cell_rows(fps: DataFrame, grids: int, distance: int = DISTANCE) -> DataFrame:
    """(grid, cell, fp): each fingerprint once for each choice of grids - distance sub-grids."""
    chosen = list(combinations(range(grids), grids - distance))

    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64)
            counts = segment_counts(fp.view(np.uint64)).astype(np.uint64)
            parts = [counts[:, g::grids] for g in range(grids)]
            # a sub-grid's coordinates as one number, base 3; a choice of sub-grids as a 64-bit name of theirs
            parts = [p @ np.uint64(SEGMENT_BITS + 1) ** np.arange(p.shape[1], dtype=np.uint64) for p in parts]
            for g, of in enumerate(chosen):
                cell = parts[of[0]]
                for k in of[1:]:
                    cell = mix(cell, parts[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), g, np.int32)), pa.array(cell.view(np.int64)), pa.array(fp)], names=["grid", "cell", "fp"])

    return fps.mapInArrow(run, "grid int, cell long, fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Boolean matrix of the pairs at most distance bits apart; the Manhattan bounds come first."""
    pa_, pb = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    near = np.abs(pa_[:, None] - pb[None, :]) <= distance
    i, j = np.nonzero(near)
    for first in range(0, len(i), 1 << 20):
        x, y = i[first : first + (1 << 20)], j[first : first + (1 << 20)]
        ca, cb = np.bitwise_count(a.view(np.uint8).reshape(-1, 8)), np.bitwise_count(b.view(np.uint8).reshape(-1, 8))
        bound = np.abs(ca[x].view(np.int8) - cb[y].view(np.int8)).sum(axis=1) <= distance
        x0, y0 = x[bound], y[bound]
        exact = np.bitwise_count(a[x0] ^ b[y0]) <= distance
        near[x, y] = False
        near[x0[exact], y0[exact]] = True
    return near


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK, grids: int | None = None) -> DataFrame:
    """(src, dst): a spanning forest of each block's links between distinct fingerprints."""
    grids = grids or sub_grids(fps.count(), distance)

    def few(fp: np.ndarray, run: np.ndarray) -> np.ndarray:
        i, j, ones = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.bitwise_count(fp).astype(np.int16)
        for k in range(1, FEW):  # each row against the k-th after it, while any run is as long
            a = np.flatnonzero(run[:-k] == run[k:])
            if not len(a):
                break
            a = a[np.abs(ones[a] - ones[a + k]) <= distance]  # the Manhattan bound comes first
            near = np.bitwise_count(fp[a] ^ fp[a + k]) <= distance
            i.append(a[near])
            j.append(a[near] + k)
        return least_linked(len(fp), np.concatenate(i), np.concatenate(j))

    def run(batches):
        for t, number in small_and_large_runs(batches, ["grid", "cell", "lo", "hi"], FEW):
            fp = t.column("fp").to_numpy().view(np.uint64)
            if number is not None:
                label = few(fp, number)
                own = np.flatnonzero(label != np.arange(len(fp)))
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)[own]), pa.array(fp.view(np.int64)[label[own]])], names=["src", "dst"])
                continue
            chunk, lo, hi = (t.column(c).to_numpy() for c in ("chunk", "lo", "hi"))
            if lo[0] == hi[0]:
                near = close_pairs(fp, fp, distance)
                if not (near.sum() > len(fp)):
                    continue
                label = least_reachable(near)
            else:
                left, right = np.flatnonzero(chunk == lo[0]), np.flatnonzero(chunk == hi[0])
                near = close_pairs(fp[left], fp[right], distance)
                if not near.any():
                    continue
                whole = np.zeros((len(fp), len(fp)), bool)
                whole[np.ix_(left, right)] = near
                label = least_reachable(whole | whole.T)
            own = label != np.arange(len(fp))
            out = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[own]), pa.array(out[label[own]])], names=["src", "dst"])

    dealt = in_cells(cell_rows(fps.select("fp"), grids, distance), ["grid", "cell"], "fp", block)
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def components(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component): each distinct fingerprint of nodes with the least fingerprint of its component."""
    component = connected_components(links(nodes, distance))
    return nodes.join(component, nodes.fp == component.node, "left").select(*nodes.columns, F.coalesce("component", "fp").alias("component"))


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    marked = stored(fingerprints(documents, shingle))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    of = stored(components(nodes, distance))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_by_class(of.select("fp", "component", F.col("n").alias("copies")), least, "component", "fp", of.count())
    of = of.select("fp", "component_id", F.col("copies").alias("n"))
    # spread by partition and place: copies of one text share all their values
    marked = marked.withColumn("_place", F.monotonically_increasing_id())
    return join_by_class(marked, of, "fp", "_place", marked.count()).select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One document of each component: the one with the least doc_id, columns unchanged.

    Null ids come last; ties fall to the lower fingerprint, then the lower hash of the text. Rows are
    told apart by a number of their own, so neither null nor repeated ids join components; a row travels
    as one value, so its columns may have any names.
    """
    cols = documents.columns

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = batch.column("row")
            raw = [x or b"" for x in rows.field("text").cast(pa.binary()).to_pylist()]
            fp = np.array([fingerprint(t, shingle) for t in raw], np.uint64).view(np.int64)
            digest = np.array([xxhash.xxh64_intdigest(t) for t in raw], np.uint64).view(np.int64)
            own = np.arange(at, at + len(raw), dtype=np.int64)
            at += len(raw)
            yield pa.RecordBatch.from_arrays([rows, rows.field("doc_id"), pa.array(fp), pa.array(digest), pa.array(own)], names=["row", "doc_id", "fp", "digest", "n"])

    whole = documents.select(F.struct(*cols).alias("row"))
    kinds = {"row": whole.schema["row"].dataType, "doc_id": documents.schema["doc_id"].dataType, **dict.fromkeys(("fp", "digest", "n"), T.LongType())}
    marked = stored(whole.mapInArrow(run, T.StructType([T.StructField(k, v) for k, v in kinds.items()])))
    # the first row of each fingerprint, then of each component
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "digest", "n")
    nodes = stored(marked.groupBy("fp").agg(F.min(order).alias("first")))
    first = components(nodes, distance).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.n").alias("n"))
    kept = marked.select("row", "n").join(first, "n", "left_semi")
    return kept.select(*[F.col("row")[c].alias(c) for c in cols])
