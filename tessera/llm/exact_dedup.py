"""Exact duplicates of texts, without regard to ASCII white space. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_KEYS, materialize, table

ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text. Inside each group of two or more the bytes
    themselves are compared; groups in which texts differ (collisions) are split by text. Of equal texts the row
    with the most code points in the original text stays, then the smallest id, null ids last. A null text counts as
    empty. A repeated row of the kept id has kept = true as well. Other columns are ignored, whatever their names.
    An empty table gives an empty result.

    Shuffled are hashes, and the texts of groups of two or more, combined before the shuffle, so a group that holds
    a third of all rows sends one row per task. Joins back are on both sides' own exchange, which adaptive execution
    can split.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    norm = base.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("norm"))
    hashed = norm.select("doc_id", "n", F.unhex(F.md5("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    hashed = materialize(hashed)
    many = hashed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    many = materialize(many)
    texts = norm.withColumn("h", F.unhex(F.md5("norm")))
    keys = F.broadcast(many) if many.count() <= BROADCAST_KEYS else many
    texts = texts.join(keys, "h", "left_semi").groupBy("h", "norm").agg(F.min("doc_id").alias("any_id"))
    clash = materialize(texts.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))

    # numbers only in the buffers, so that both aggregates stay in hashed, generated code
    longest = hashed.groupBy("h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("group_size"))
    keep = materialize(longest)
    first = hashed.join(keep, ["h", "n"]).groupBy("h").agg(F.min("doc_id").alias("keep_id"))
    groups = materialize(keep.drop("n").join(first, "h"))
    out = hashed.join(groups, "h")
    if not clash.isEmpty():
        out = out.join(clash, "h", "left_anti")
        apart = norm.withColumn("h", F.unhex(F.md5("norm"))).join(clash, "h", "left_semi")
        own = apart.groupBy("h", "norm").agg(
            F.min(F.struct(-F.col("n"), F.col("doc_id").isNull(), "doc_id")).alias("best"), F.count(F.lit(1)).alias("group_size")
        )
        own = own.select("h", "norm", F.col("best.doc_id").alias("keep_id"), "group_size")
        apart = apart.join(own, ["h", "norm"]).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        out = out.select("doc_id", "keep_id", "group_size", "sha").unionByName(apart.select("doc_id", "keep_id", "group_size", "sha"))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
