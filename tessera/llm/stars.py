"""What is left of buckets once each member has been compared with one centre: meetings of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tessera.llm.common import Groups, materialize


def unsettled(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, a, rep, c, asks: members of the buckets that lie in several components.

    ``members`` has key, a (a bucket's centre) and rep, ``comp`` node and component; a member without a component is
    its own. Members outside the largest component of a bucket ask; of two members in different components one asks.
    """
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    known = comp.join(sizes, "component").select(F.col("node").alias("rep"), "component", "n")
    placed = members.select("key", "a", "rep").join(known, "rep", "left")
    placed = placed.select("key", "a", "rep", F.coalesce("component", "rep").alias("c"), F.coalesce("n", F.lit(1)).alias("n"))
    tops = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.struct("n", "c")).alias("top")).where("lo < hi")
    tops = materialize(tops.select("key", F.col("top.c").alias("major")))
    return materialize(placed.join(tops, "key").select("key", "a", "rep", "c", (F.col("c") != F.col("major")).alias("asks")))


def in_blocks(docs: DataFrame, order: list, weight: str, limit: int) -> DataFrame:
    """Adds block: neighbours in ``order`` share one until their weights reach ``limit``; a heavier row is alone."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for i, w in enumerate(batch.column(batch.schema.get_field_index(weight)).to_pylist()):
                if held and held + w > limit:
                    block, held = block + 1, 0
                held += w
                out[i] = block
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    docs = materialize(docs)
    total = docs.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).coalesce(1 + total // (16 * limit))  # few blocks end early
    return dealt.mapInArrow(number, StructType([*docs.schema.fields]).add("block", LongType()))


def meetings(dealt: DataFrame) -> DataFrame:
    """q, block: blocks that share a key, where the first one has a member that asks; ``dealt`` has key, block, asks."""
    dealt = materialize(dealt.groupBy("key", "block").agg(F.max("asks").alias("asks")))
    return materialize(dealt.where("asks").select("key", F.col("block").alias("q")).join(dealt.select("key", "block"), "key").select("q", "block").distinct())


def compare_blocks(rows: DataFrame, meet: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Links (a, b) of components that meet; each meeting gets the rows of two blocks.

    ``rows`` has block, asks, rep, c and what ``compare`` needs: given a table and the places of questions and members,
    it returns places of linked ones. Of a meeting's links only those are put out that join components not yet joined.
    """
    asked = rows.where("asks").withColumnRenamed("block", "q").join(meet, "q").withColumn("question", F.lit(True))
    members = rows.join(meet, "block").withColumn("question", F.lit(False))

    def one(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        question = group["question"].to_numpy()
        a, b = compare(group, np.flatnonzero(question), np.flatnonzero(~question))
        c = pa.chunked_array(group["c"]).combine_chunks().dictionary_encode().indices.to_numpy() if len(group) else np.zeros(0, int)
        keep = joining(c[a], c[b])
        return pa.table({"a": group["rep"].take(pa.array(a[keep])), "b": group["rep"].take(pa.array(b[keep]))})

    kind = rows.schema["rep"].dataType.simpleString()
    return asked.unionByName(members).drop("asks").groupBy("q", "block").applyInArrow(one, f"a {kind}, b {kind}")


def joining(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs that join two groups which earlier pairs have not joined."""
    groups = Groups()
    return np.array([i for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)) if groups.join(x, y)], np.int64)
