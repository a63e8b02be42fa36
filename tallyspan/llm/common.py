"""What the training-data operators share: scratch tables, text bytes, cells, components."""

from __future__ import annotations

import itertools
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Task functions of this module travel with the job, wherever the executors' Python path points."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only in local mode and where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyspan-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_stored(df: DataFrame | None) -> None:
    """Remove a table of stored() that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for the ordered pair of two names."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def in_cells(df: DataFrame, cell: list[str], ident: str, block: int, counted: DataFrame | None = None) -> DataFrame:
    """Deal rows to cells so that no task holds more than about two blocks of one cell.

    A cell of more than ``block`` rows is cut into chunks by a hash of ``ident``; a row goes to
    each pair of chunks that holds its own. Adds ``chunk``, ``lo`` and ``hi``: rows of chunk lo
    meet those of chunk hi, and every two rows of a cell meet in exactly one (lo, hi).
    Rows of small cells are not copied. ``counted`` has the cells of df's rows, where they are had for less.
    """
    large = (df if counted is None else counted).groupBy(*cell).count().where(F.col("count") > block)
    large = large.select(*cell, F.ceil(F.col("count") / block).cast("int").alias("_k"))
    k = F.coalesce("_k", F.lit(1))
    dealt = df.join(large, cell, "left").withColumn("chunk", F.pmod(F.xxhash64(ident), k).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), k - 1)))
    dealt = dealt.withColumns({"lo": F.least("chunk", "_other"), "hi": F.greatest("chunk", "_other")}).drop("_k", "_other")
    return dealt.repartition(*cell, "lo", "hi").sortWithinPartitions(*cell, "lo", "hi")


def runs(batches, keys: list[str]):
    """Record batches sorted by keys -> one pa.Table for each run of equal keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        cuts = np.flatnonzero(new)
        edges = [0, *cuts.tolist(), t.num_rows]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if i and held:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(t.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.concat_tables(held)


def small_and_large_runs(batches, keys: list[str], small: int):
    """Record batches sorted by keys -> (table, run of each row) for all runs of at most small rows that a
    batch ends, and (table, None) for each longer run. Runs of one row are left out."""
    held: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
        elif held is None:
            return
        else:
            t = held
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in (t.column(k).to_numpy() for k in keys):
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        if batch is not None:  # the last run may go on
            held = t.slice(int(starts[-1]))
            t, new = t.slice(0, int(starts[-1])), new[: starts[-1]]
            starts = starts[:-1]
        sizes = np.diff(np.r_[starts, t.num_rows])
        for k in np.flatnonzero(sizes > small).tolist():
            yield t.slice(int(starts[k]), int(sizes[k])), None
        run = np.cumsum(new) - 1
        few = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= small)) if len(run) else run
        if len(few):
            yield t.take(pa.array(few)), run[few]


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows, the least row reachable over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def least_reachable(adjacent: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the least index in its component."""
    n = len(adjacent)
    near = adjacent | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: A key with more than this share of all rows is hot: there are at most so many such keys, the inverse of it.
HOT = 1000


def join_by_class(rows: DataFrame, classes: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """rows left-joined with classes, which has one row for each key and the number ``n`` of rows that hold it.

    The keys of more than total / HOT rows, at most HOT of them, are broadcast; their rows are spread by a
    hash of ``spread`` over the exchange, so that no task holds a large class.
    """
    values = [c for c in classes.columns if c not in (key, "n")]
    hot = classes.where(F.col("n") > total / HOT).select(F.col(key).alias("_hot"), F.struct(*values).alias("_of_hot"))
    # one struct is the join key: a constant of its own would be folded away, and the spreading with it
    at = lambda k, salt: F.struct(k.alias("key"), salt.cast("int").alias("salt"))
    cold = classes.where(F.col("n") <= total / HOT).select(at(F.col(key), F.lit(0)).alias("_at_cold"), F.struct(*values).alias("_of"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    alone = at(F.lit(None).cast(rows.schema[key].dataType), 1 + F.pmod(F.xxhash64(spread), F.lit(HOT)))
    out = out.withColumn("_at", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), at(F.col(key), F.lit(0))).otherwise(alone))
    out = out.join(cold, F.col("_at") == F.col("_at_cold"), "left")
    of = F.coalesce("_of_hot", "_of")
    return out.select(*rows.columns, *[of[c].alias(c) for c in values])


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) of any orderable type -> (node, component), component being the least node.

    Large-star and small-star contractions, each a grouped minimum and a join; a table in the
    shared folder ends each round. Edges with a null end and loops are left out; nodes without
    an edge do not appear.
    """
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = stored(e.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())

    def stamp(df: DataFrame):
        mark = F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 32)))
        return tuple(df.agg(F.count(F.lit(1)), mark).first())

    was = stamp(e)
    while was[0]:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_by_class(both.where("v > u"), low, "u", "v", 2 * was[0]).select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_by_class(large, least, "a", "b", 2 * was[0]).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        )
        new = stored(small.select("x.*").where("a <> b").distinct())
        drop_stored(e)
        e, now = new, stamp(new)
        if now == was:
            break
        was = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
