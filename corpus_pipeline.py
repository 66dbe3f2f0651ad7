"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents. A null in any column is allowed: a null or empty
text has no language and goes in the first stage; rows with a null id are never taken for copies and stay. Where one id
has several texts, the two stages that drop documents judge each text for itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id
from tessera.llm.common import anti_join, materialize, numbered, semi_join, table, temporary
from tessera.llm.exact_dedup import exact_dedup, normalised
from tessera.llm.minhash import near_dedup
from tessera.llm.packing import default_tokenizer, pack
from tessera.llm.suffix_dedup import suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the documents that have a language; documents of none (``und``) go, a missing lang is filled in."""
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, carry=("lang", "source", "n_chars")).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select("doc_id", "text", F.coalesce("row.lang", "lang_pred").alias("lang"), "row.source", "row.n_chars")


def _ids_of_several_rows(docs: DataFrame) -> DataFrame:
    return materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays; repeated rows of it go as well.

    A row goes by its id and its text: where one id has several texts, those that are no copies stay.
    """
    docs = docs.select(*COLUMNS).withColumn("sha", F.sha2(normalised(F.col("text")), 256))
    copies = exact_dedup(docs).where("not kept and doc_id is not null").select("doc_id", F.col("text_sha256").alias("sha"))
    docs = anti_join(docs, copies, ["doc_id", "sha"])
    again = _ids_of_several_rows(docs)
    if again.isEmpty():
        return docs.select(*COLUMNS)
    row = F.struct(*COLUMNS)
    once = semi_join(docs, again, "doc_id").groupBy("doc_id", "sha").agg(F.max_by(row, F.struct(F.length("text"), row)).alias("row"))
    return anti_join(docs, again, "doc_id").select(*COLUMNS).unionByName(once.select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document of the smallest id stays.

    Where one id has several texts, each is a document of its own (the smaller hash first), so none goes for another's sake.
    """
    docs = docs.select(*COLUMNS)
    if _ids_of_several_rows(docs).isEmpty():
        return anti_join(docs, near_dedup(docs).where("not kept").select("doc_id"), "doc_id")
    docs = docs.withColumn("th", F.coalesce(F.sha2("text", 256), F.lit("")))
    rows = docs.where("doc_id is not null").select(F.lit(0).alias("all"), "doc_id", "th").distinct()
    rows = numbered(rows, "all", ["doc_id", "th"], "nth").select("doc_id", "th", "nth")
    docs = materialize(docs.join(rows, ["doc_id", "th"], "left"))
    return anti_join(docs, near_dedup(docs, id_col="nth").where("not kept").select(F.col("doc_id").alias("nth")), "nth").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out of the texts; every document stays."""
    out = suffix_dedup(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 ids."""
    return pack(docs, default_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: The stages learn, sort suffixes and tokenise; SQL can't express them, tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with temporary(spark):  # what a stage writes on its way goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
