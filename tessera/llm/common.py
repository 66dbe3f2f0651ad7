"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of one narrow key column (16 bytes at most) that may be broadcast; larger key sets are joined by shuffle.
BROADCAST_KEYS = 500_000

#: Edges that one task may join: a few tens of MB.
ONE_TASK_EDGES = 200_000

_own_scratch: list[str] = []
_within: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_scratch:
        _own_scratch.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own_scratch[0]


def materialize(df: DataFrame, outlives: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors.

    What is written within temporary() goes with it, unless it ``outlives`` it.
    """
    spark = df.sparkSession
    path = "/".join([scratch_dir(spark), *(_within[:-1] if outlives else _within), uuid.uuid4().hex])
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is deleted at the end, through Spark's file system."""
    _within.append(uuid.uuid4().hex)
    path = "/".join([scratch_dir(spark), *_within])
    try:
        yield
    finally:
        _within.pop()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (one narrow column of distinct values).

    The key set is counted first and broadcast only up to BROADCAST_KEYS rows; beyond that Spark shuffles.
    """
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``keys``; the key set is broadcast as in semi_join()."""
    keys = materialize(keys.distinct())
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_anti")


def numbered(df: DataFrame, key: str, order: list[str], into: str = "pos", count: str | None = None) -> DataFrame:
    """``df``, written once, with ``into``: each row's number from 0 among the rows of its ``key`` (not null), by ``order``.

    ``count`` names a column for the rows of the key, if wanted.

    Rows are dealt by ranges of key and order and sorted there; what stands before a partition in its key comes from the
    partitions' counts. So no task holds a whole key, however frequent.
    """
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_at", 33)))
    runs = dealt.groupBy("_part", key).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = [F.sum("_n").over(Window.partitionBy(key)).alias(count)] if count else []
    runs = materialize(runs.select("_part", key, (before - F.col("_first")).alias("_shift"), *whole))
    if runs.count() <= BROADCAST_KEYS // 10:
        runs = F.broadcast(runs)
    return dealt.join(runs, ["_part", key]).withColumn(into, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


class Groups:
    """Things joined to groups; the smallest of a group is its root."""

    def __init__(self) -> None:
        self.top: dict = {}

    def root(self, x):
        top = self.top
        while (up := top.get(x, x)) != x:
            top[x] = x = top.get(up, up)
        return x

    def join(self, x, y) -> bool:
        """False if they were in one group before."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.top[max(x, y)] = min(x, y)
        return x != y


def _components_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups, kind = Groups(), None
    nodes: dict = {}
    for batch in batches:
        kind = batch.schema.field(0).type
        for u, v in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            groups.join(u, v)
            nodes[u] = nodes[v] = None
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(list(nodes), kind), pa.array([groups.root(x) for x in nodes], kind)], names=["node", "component"])


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none that has one itself."""
    if not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").count().where("count > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list.

    Input: long columns a, b (nulls and loops are ignored, repeats are harmless). Output: node, component, where
    component is the smallest node reachable; only nodes with an edge are listed. Large-star and small-star rounds
    (each edge moves to a smaller centre) run until every component is a star; every round is written to the
    shared folder, so no lineage builds up and nothing is collected. Up to ONE_TASK_EDGES edges, which are counted first, one
    task joins them all.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges)
    if edges.count() <= ONE_TASK_EDGES:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_components_of_all, f"node {kind}, component {kind}")
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
