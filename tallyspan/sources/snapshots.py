"""Tables of one folder that are replaced together or not at all.

A commit writes its rows to new folders first and then a numbered manifest, which names the folders of every table;
writing it is one rename that fails where the number is taken. Readers take the highest manifest, so a commit
that fails halfway, or a reader in the midst of one, sees the state before it whole. Folders that no manifest
of the last few names are removed by vacuum().
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of keys: a commit rewrites those that its keys fall into.
BUCKETS = 64
_MANIFEST = re.compile(r"^(\d{9})\.json$")


class Conflict(RuntimeError):
    """Another commit was first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := _MANIFEST.match(n)))


def _manifest(spark: SparkSession, root: str, version: int) -> dict:
    if not version:
        return {}
    row = spark.read.text(f"{root}/_manifests/{version:09d}.json", wholetext=True).first()
    return json.loads(row.value)


def latest(spark: SparkSession, root: str) -> int:
    """Number of the last commit; 0 before the first."""
    return max(_versions(spark, root), default=0)


def _publish(spark: SparkSession, root: str, version: int, tables: dict) -> None:
    fs, folder = _fs(spark, f"{root}/_manifests")
    fs.mkdirs(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    draft, final = path(f"{root}/_manifests/.{uuid.uuid4().hex}"), path(f"{root}/_manifests/{version:09d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(tables).encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(draft, final, no_overwrite)
    except Exception as e:
        fs.delete(draft, False)
        if "AlreadyExists" in str(e):
            raise Conflict(f"version {version} of {root} is taken") from None
        raise


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Replace the named tables, all of them or none; tables that are not named stay. Returns the number of the commit."""
    was = latest(spark, root)
    now = dict(_manifest(spark, root, was))
    for name, df in tables.items():
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{root}/{folder}")
        now[name] = {"schema": df.schema.jsonValue(), "key": None, "folders": [[folder]]}
    _publish(spark, root, was + 1, now)
    return was + 1


def _buckets(spark: SparkSession, path: str) -> set[int]:
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {int(n.removeprefix("_bucket=")) for n in names if n.startswith("_bucket=")}


def replace_keys(df: DataFrame, root: str, name: str, key: str = "job_id", buckets: int = BUCKETS) -> int:
    """Replace the rows of the keys that df holds, all of them or none; rows of other keys stay. df is read once.

    A table is cut into buckets by a hash of its key. df's rows go to a new folder; of the buckets that they fall into, the rows of
    other keys are written anew beside them, and the other buckets keep their folders. The number of buckets is
    that of a table's first commit.
    """
    spark = df.sparkSession
    was = latest(spark, root)
    now = dict(_manifest(spark, root, was))
    old = now.get(name)
    if old and (old["key"] != key or df.schema.jsonValue()["fields"] != old["schema"]["fields"]):
        raise ValueError(f"{name} has the key {old['key']} and the columns of its first commit")
    buckets = len(old["folders"]) if old else buckets
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def written(rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        # a large bucket is split over tasks; a task writes whole runs of buckets
        rows = rows.withColumn("_bucket", bucket).repartition("_bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(8)))
        rows.sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
        return folder

    new = written(df)
    touched = _buckets(spark, f"{root}/{new}")
    folders = [list(f) for f in old["folders"]] if old else [[] for _ in range(buckets)]
    before = [f"{root}/{f}" for b in sorted(touched) for f in folders[b]]
    kept, stays = None, set()
    if before:
        mine = spark.read.schema(df.schema).parquet(f"{root}/{new}").select(key).distinct()
        others = spark.read.schema(df.schema).parquet(*before)
        kept = written(others.join(mine, others[key].eqNullSafe(mine[key]), "left_anti"))
        stays = _buckets(spark, f"{root}/{kept}")
    for b in touched:
        folders[b] = [f"{new}/_bucket={b}", *([f"{kept}/_bucket={b}"] if b in stays else [])]
    now[name] = {"schema": df.schema.jsonValue(), "key": key, "folders": folders}
    _publish(spark, root, was + 1, now)
    return was + 1


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of the last commit, or of an earlier one that vacuum() has left."""
    from pyspark.sql.types import StructType

    about = _manifest(spark, root, latest(spark, root) if version is None else version)[name]
    schema, folders = StructType.fromJson(about["schema"]), [f for bucket in about["folders"] for f in bucket]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove the folders that none of the last manifests names, and older manifests; how many folders went. Not beside a commit."""
    versions = _versions(spark, root)
    used = {"/".join(f.split("/")[:2]) for v in versions[-keep:] for t in _manifest(spark, root, v).values() for bucket in t["folders"] for f in bucket}
    fs, top = _fs(spark, root)
    gone = 0
    for table in fs.listStatus(top):
        if table.getPath().getName() != "_manifests":
            for folder in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{folder.getPath().getName()}" not in used:
                    gone += fs.delete(folder.getPath(), True)
    for v in versions[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifests/{v:09d}.json"), False)
    return gone
