"""Embedding near-dedup: random-hyperplane sign hashing.

Each of several tables hashes a vector to the signs of its products with random hyperplanes;
vectors at a small angle share a table's cell with probability (1 - angle / pi) ^ bits. Bits grow
with the number of vectors, so that a cell of unrelated ones stays at about CELL of them, and
tables with the bits, so that a pair at the threshold is found with probability RECALL at every
size (pairs nearer than that more often). Vectors of a cell meet in blocks; each pair's cosine is
computed in double precision, and a pair counts in the first table that holds it, so that it is
counted once. A block returns each vector's number of links and a spanning forest of its links,
never its pairs; distributed connected components join the forests.

Equal vectors are one class with a weight, so copies cost nothing beyond their rows.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or infinite component
link with nothing; vectors of different lengths don't link; repeated rows and repeated ids are
vectors of their own that link when near; a component is named by its least id, null ids last;
very long vectors are one value each; an empty table gives an empty result. Labels and extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import connected_components, in_cells, join_by_class, least_reachable, runs, ship, stored

ship(__name__)

COSINE, RECALL, CELL, SEED, BLOCK = 0.95, 0.995, 16, 11, 1500
LEAST_BITS, MOST_BITS = 6, 30


def bits_and_tables(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits to a table and tables for n vectors: cells of about CELL, and the recall at the threshold."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) / CELL))))
    share = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def _usable(column: str):
    """The vector, or null where it can't link."""
    e = F.col(column)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(e.isNotNull() & (F.size(e) > 0) & ~odd & F.exists(e, lambda x: x != 0), e)


def classes(vectors: DataFrame, ident: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows (id, node), nodes (node, vector, weight); equal vectors are one node."""
    node = F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.transform("v", lambda x: F.hex(x.cast("double").cast("string"))), ",")))
    rows = vectors.select(F.col(ident).alias("id"), _usable(column).alias("v")).withColumn("node", node)
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"))
    return rows.select("id", "node"), nodes


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, as unit vectors in double precision."""
    x = np.array([np.frombuffer(b, kind) for b in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hashed(nodes: DataFrame, bits: int, tables: int, seed: int = SEED, cells_only: bool = False) -> DataFrame:
    """(tab, cell, node, weight, vec, signs): each node once in each table; vec is as the table holds it."""
    kind = "<f4" if "float" in nodes.schema["v"].dataType.simpleString() else "<f8"

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("v").to_pylist()
            dims = np.array([len(x) for x in lists])
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng((seed, d)).standard_normal((d, bits * tables))
                take = np.flatnonzero(dims == d)
                raw = [np.array(lists[i], kind).tobytes() for i in take]
                signs = ((units(raw, kind) @ planes[d]) > 0).reshape(len(raw), tables, bits) @ (1 << np.arange(bits))
                packed = [s.tobytes() for s in signs.astype("<i4")]
                part = batch.take(pa.array(take))
                for k in range(tables):
                    at = [pa.array(np.full(len(raw), k, np.int32)), pa.array(signs[:, k].astype(np.int64) | d << 32)]
                    if cells_only:
                        yield pa.RecordBatch.from_arrays(at, names=["tab", "cell"])
                    else:
                        of = [part.column("node"), part.column("weight"), pa.array(raw, pa.binary()), pa.array(packed, pa.binary())]
                        yield pa.RecordBatch.from_arrays(at + of, names=["tab", "cell", "node", "weight", "vec", "signs"])

    schema = "tab int, cell long" if cells_only else "tab int, cell long, node string, weight long, vec binary, signs binary"
    return nodes.select("node", "v", "weight").mapInArrow(run, schema)


def links(dealt: DataFrame, kind: str, cosine: float = COSINE) -> DataFrame:
    """(src, n, dst): partial link counts of src (dst null) and forest edges (n null); kind is the vectors' number type."""

    def run(batches):
        for t in runs(batches, ["tab", "cell", "lo", "hi"]):
            if t.num_rows < 2:
                continue
            x = units(t.column("vec").to_pylist(), kind)
            sig = np.array([np.frombuffer(b, "<i4") for b in t.column("signs").to_pylist()])
            weight, node = t.column("weight").to_numpy(), t.column("node").to_pylist()
            k, lo, hi = t.column("tab")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            near = x @ x.T >= cosine
            np.fill_diagonal(near, False)
            if lo != hi:
                chunk = t.column("chunk").to_numpy()
                near &= chunk[:, None] != chunk[None, :]
            if not near.any():
                continue
            i, j = np.nonzero(near)
            for a in range(0, len(i), 1 << 20):  # pairs that an earlier table holds are counted there
                p, q = i[a : a + (1 << 20)], j[a : a + (1 << 20)]
                seen = np.zeros(len(p), bool)
                for s in range(k):
                    seen |= sig[p, s] == sig[q, s]
                near[p[seen], q[seen]] = False
            if not near.any():
                continue
            n = near @ weight
            label = least_reachable(near)
            own, linked = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(n)
            src = [node[a] for a in linked] + [node[a] for a in own]
            dst = [None] * len(linked) + [node[label[a]] for a in own]
            counts = [*n[linked].tolist(), *[None] * len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(counts, pa.int64()), pa.array(dst, pa.string())], names=["src", "n", "dst"])

    return dealt.mapInArrow(run, "src string, n long, dst string")


def near_duplicates(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    rows, nodes = classes(vectors, ident, column)
    rows, nodes = stored(rows.withColumn("place", F.monotonically_increasing_id())), stored(nodes)
    bits, tables = bits_and_tables(nodes.count(), cosine, recall)
    kind = "<f4" if "float" in nodes.schema["v"].dataType.simpleString() else "<f8"
    dealt = in_cells(hashed(nodes, bits, tables), ["tab", "cell"], "node", block, hashed(nodes, bits, tables, cells_only=True))
    found = stored(links(dealt, kind, cosine))
    n = found.where("n is not null").groupBy("src").agg(F.sum("n").alias("other")).withColumnRenamed("src", "node")
    component = connected_components(found.where("dst is not null").select("src", "dst"))
    of = nodes.select("node", "weight", "first_id").join(n, "node", "left").join(component, "node", "left")
    of = stored(of.withColumn("component", F.coalesce("component", "node")))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of = join_by_class(of, least, "component", "node", of.count())
    of = of.select("node", (F.col("weight") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), "component_id", F.col("weight").alias("n"))
    out = join_by_class(rows, of, "node", "place", rows.count()).select(
        F.col("id").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col(ident).eqNullSafe(F.col("component_id")))
