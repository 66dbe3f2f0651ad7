"""Keyed tables that are brought up to date in place of their changed parts only.

A snapshot is a table in buckets by the hash of its keys. A batch rewrites the buckets that its keys fall into and leaves the files of
all others as they are; a manifest, written last, says which folder holds each bucket and which batch was the last. So
readers see whole batches, and a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.tables import upsert

BUCKETS = 64
_MANIFEST = "batch long, buckets int, bucket int, folder string, fields string"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all finished manifests, in order."""
    at, files = _folder(spark, f"{root}/_manifest")
    if not files.exists(at):
        return []
    whole = [x.getPath() for x in files.listStatus(at) if files.exists(_folder(spark, f"{x.getPath().toString()}/_SUCCESS")[0])]
    return sorted(int(p.getName().rpartition("=")[2]) for p in whole)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> list:
    """Rows (batch, buckets, bucket, folder, fields) of a version, the latest if none is said; one for each filled bucket."""
    known = versions(spark, root)
    if not known:
        return []
    return spark.read.schema(_MANIFEST).json(f"{root}/_manifest/version={known[-1] if version is None else version}").collect()


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version; None where nothing was ever applied."""
    rows = manifest(spark, root, version)
    if not rows:
        return None
    schema = StructType.fromJson(json.loads(rows[0]["fields"]))
    folders = [r["folder"] for r in rows if r["folder"]]
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def apply_batch(spark: SparkSession, root: str, keys: DataFrame, merge: Callable[[DataFrame | None], DataFrame], batch: int, buckets: int = BUCKETS) -> bool:
    """Rewrite the buckets that the rows of ``keys`` fall into with what ``merge`` makes of their present rows; False if the batch was there before.

    ``keys`` has the key columns only; ``merge`` gets the present rows of the touched buckets (None at first) and returns what
    they are to be; its rows carry the key columns. The first batch fixes the number of buckets. The driver sees bucket
    numbers, never rows.
    """
    now = manifest(spark, root)
    if now and now[0]["batch"] >= batch:
        return False
    buckets = now[0]["buckets"] if now else buckets
    bucket = F.pmod(F.xxhash64(*keys.columns), F.lit(buckets)).cast("int")
    touched = {r["_b"] for r in keys.select(bucket.alias("_b")).distinct().collect()}
    held = {r["bucket"]: r["folder"] for r in now if r["folder"]}
    schema = StructType.fromJson(json.loads(now[0]["fields"])) if now else None
    old = [f"{root}/{held[b]}" for b in sorted(touched & set(held))]
    present = None if schema is None else (spark.read.schema(schema).parquet(*old) if old else spark.createDataFrame([], schema))
    rows = merge(present)
    folder = f"data/batch={batch}"
    rows.withColumn("_bucket", bucket).repartition(max(1, len(touched)), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/{folder}")
    at, files = _folder(spark, f"{root}/{folder}")
    made = {int(x.getPath().getName().rpartition("=")[2]) for x in files.listStatus(at) if x.getPath().getName().startswith("_bucket=")}
    held = {b: f for b, f in held.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in made}
    fields = (rows.schema if schema is None else schema).json()
    lines = [(batch, buckets, b, f, fields) for b, f in sorted(held.items())] or [(batch, buckets, -1, None, fields)]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/_manifest/version={batch}")
    return True


def upsert_batch(spark: SparkSession, root: str, changes: DataFrame, keys: Sequence[str], order: str, batch: int, buckets: int = BUCKETS) -> bool:
    """The latest row of each key: ``changes`` against what the snapshot has, of equal times the change; False if the batch was there before."""

    def merged(present: DataFrame | None) -> DataFrame:
        return upsert(changes.limit(0) if present is None else present, changes, keys, order)

    return apply_batch(spark, root, changes.select(*keys), merged, batch, buckets)


def delete_batch(spark: SparkSession, root: str, gone: DataFrame, batch: int) -> bool:
    """Rows whose keys are in ``gone`` (key columns only) leave the snapshot; False if it has none or had the batch before."""
    if not versions(spark, root):
        return False
    return apply_batch(spark, root, gone, lambda present: present.join(gone, gone.columns, "left_anti"), batch)


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the bucket folders that none of the ``keep`` latest versions name, and the older manifests; how many folders went."""
    known = versions(spark, root)
    live = {r["folder"] for v in known[-keep:] for r in manifest(spark, root, v)}
    gone = 0
    for v in known[:-keep]:
        for r in manifest(spark, root, v):
            if r["folder"] and r["folder"] not in live:
                at, files = _folder(spark, f"{root}/{r['folder']}")
                gone += files.exists(at) and files.delete(at, True)
        at, files = _folder(spark, f"{root}/_manifest/version={v}")
        files.delete(at, True)
    return gone
