"""Centroid clustering with an equal-average equal-variance nearest-centroid search.

Vectors become integer vectors, floor(scale * x). The centroids of a round are sorted by component
sum (their mean, times the dimension). A vector's search begins at its own sum and goes outward,
the nearer side first. With d components, sums S and deviations V = |x - mean(x)|,

    d |x - c|^2  >=  (S(x) - S(c))^2 + d (V(x) - V(c))^2,

so the first centroid whose sum alone is too far ends the search, and one whose sum and deviation
are too far together is passed over without a distance. What is left gets its exact squared distance
in 64-bit integers; bounds are taken a little low, so rounding never rejects the nearest or a tie.

A round is one reading of the vectors: each task searches for its own and returns a count and a
component sum for each centroid it met; Spark adds these up, and k * dim numbers reach the driver,
which divides them exactly. Centroids are the only thing sent to tasks: k * dim at most LARGEST_MODEL.

Defined results: a vector of another dimension, null, or with a null or non-finite component is left
out, and so is one with a scaled component beyond 2 ** 27, whose distances would not fit 64 bits (dim up to 64).
A null vec_id sorts after all others as a starting centroid; repeated rows and equal vectors are clustered
each, and ties between equal hashes go by components. Fewer vectors than k give as many centroids; an
empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import drop_stored, ship, stored

ship(__name__)

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Scaled components are at most so large, and k * dim is.
LARGEST, LARGEST_MODEL = 1 << 27, 1 << 22


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that can be clustered, scaled and floored."""
    e = F.col(embedding)
    unfit = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) > LARGEST))
    fit = vectors.where(e.isNotNull() & (F.size(e) == dim) & ~unfit)
    return fit.select(F.col(vec_id).alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest sha256 of ``seed:vec_id``."""
    if k * DIM > LARGEST_MODEL:
        raise ValueError(f"{k} centroids are more than every task can hold")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


def deviation(x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and the number of distances taken."""
    n, (k, d) = len(x), centroids.shape
    order = np.argsort(centroids.sum(axis=1), kind="stable")
    c = centroids[order]
    c_sum, c_dev = c.sum(axis=1), deviation(c)
    x_sum, x_dev = x.sum(axis=1), deviation(x)
    best, which, taken = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0
    right = np.searchsorted(c_sum, x_sum)
    left, at = right - 1, np.arange(n)
    for _ in range(k):
        low = np.where(left >= 0, (x_sum[at] - c_sum[left]).astype(float), np.inf)
        high = np.where(right < k, (c_sum[np.minimum(right, k - 1)] - x_sum[at]).astype(float), np.inf)
        down = low <= high
        place, by_mean = np.where(down, left, right), np.minimum(low, high) ** 2
        left, right = left - down, right + ~down
        go = by_mean * (1 - 1e-9) <= d * best[at].astype(float)  # sums only get farther: the others are done
        left, right, at, place, by_mean = left[go], right[go], at[go], place[go], by_mean[go]
        if not len(at):
            break
        bound = by_mean + d * (x_dev[at] - c_dev[place]) ** 2
        near = bound * (1 - 1e-4) - 1e-4 <= d * best[at].astype(float)
        rows, to = at[near], place[near]
        taken += len(rows)
        dist = ((x[rows] - c[to]) ** 2).sum(axis=1)
        better = (dist < best[rows]) | ((dist == best[rows]) & (order[to] < which[rows]))
        best[rows[better]], which[rows[better]] = dist[better], order[to[better]]
    return which, best, taken


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    def run(batches):
        k, d = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                which = nearest(x, centroids)[0]
                n += np.bincount(which, minlength=k)
                np.add.at(total, which, x)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": n[met], "total": pa.array(total[met].tolist(), pa.list_(pa.int64()))})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                which, dist, _ = nearest(_matrix(batch, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which, pa.int32()), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's floored mean of its vectors; one without vectors stays."""
    parts = kept.mapInArrow(_sums(centroids), "cluster int, n long, total array<long>")
    by_part = parts.select("cluster", "n", F.posexplode("total").alias("i", "x"))
    out = centroids.copy()
    for r in by_part.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k * dim rows at most
        out[r.cluster, r.i] = r.x // r.n
    return out


def cluster(kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every integer vector after so many rounds, stored; the final centroids."""
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    return stored(kept.mapInArrow(_assigned(centroids), f"vec_id {id_type}, cluster int, distance long")), centroids


def cluster_table(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that can be clustered."""
    out, centroids = cluster(integer_vectors(vectors))
    sums = {r.cluster: int(r.d) for r in out.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    if not rows:
        drop_stored(out)
        out = out.sparkSession.createDataFrame([], out.schema)
    about = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    fit = f"len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x) or abs(x::double * {SCALE}) > {LARGEST})) = 0"
    gap = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))::bigint"
    sql = f"""with a as materialized (
        select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where {fit}),
    c0 as materialized (
        select (row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) - 1)::int as c, v from a
        order by c limit {CENTROIDS})"""
    for k in range(ROUNDS + 1):
        sql += f""",
    d{k} as materialized (select r, min((d, c)) as best from (select a.r, c.c, {gap} as d from a, c{k} c) group by r)"""
        if k < ROUNDS:
            sql += f""",
    m{k} as (select c, i, floor(sum(v[i])::double / count(*))::bigint as x from (select d.best[2] as c, a.v, unnest(range(1, {DIM + 1})) as i from d{k} d join a using (r)) group by c, i),
    c{k + 1} as materialized (select c.c, coalesce(m.v, c.v) as v from c{k} c left join (select c, list(x order by i) as v from m{k} group by c) m using (c))"""
    return (
        sql
        + f"""
    select a.vec_id, d.best[2] as cluster, d.best[1] as distance, sum(d.best[1]) over (partition by d.best[2])::bigint as cluster_inertia,
        sum(d.best[1]) over ()::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
    from a join d{ROUNDS} d using (r) join c{ROUNDS} c on c.c = d.best[2]"""
    )


ORACLE = _oracle()
