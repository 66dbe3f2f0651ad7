"""Event memory, conversations, incremental embedding and job tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.core import col, r


def memory_type(c: str | Column) -> Column:
    text = F.lower(col(c))
    return F.when(text.rlike("policy|rate|profile|fact|rule"), "semantic").when(text.rlike("procedure|workflow|best_practice|heuristic"), "procedural").otherwise("episodic")


def last_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each key; ``order`` must settle ties."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def lines_of(df: DataFrame, by: str, order: Sequence[str], line: Column, n: int, most: int = 800) -> DataFrame:
    """by, context: one line for each of the last n rows, oldest first, cut to ``most`` characters."""
    rows = last_rows(df, [by], order, n).select(by, F.struct(*order, line.alias("_line")).alias("_e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["_line"]), "\n")
    return rows.groupBy(by).agg(F.substring(text, 1, most).alias("context"))


def entity_index(df: DataFrame, entities: str, order: Sequence[str], summary: str, n: int = 3) -> DataFrame:
    """entity, events, last: number of events and the last n summaries of each entity."""
    rows = df.select(F.explode(entities).alias("entity"), *order, summary)
    whole = rows.groupBy("entity").agg(F.count(F.lit(1)).alias("events"))
    last = last_rows(rows, ["entity"], order, n).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct(*order, summary))).alias("_l"))
    return whole.join(last, "entity").select("entity", "events", F.array_join(F.transform("_l", lambda x: x[summary].cast("string")), "|").alias("last"))


def action_taken(asked: DataFrame, events: DataFrame, entity: str = "entity", phrase: str = "phrase", summary: str = "summary") -> DataFrame:
    """Rows of (entity, phrase) for which the entity has an event whose summary contains the phrase."""
    a = asked.alias("a")
    return a.join(events.alias("e"), (F.col(f"a.{entity}") == F.col(f"e.{entity}")) & F.col(f"e.{summary}").contains(F.col(f"a.{phrase}")), "left_semi")


def session_counters(df: DataFrame, session: str, kind: str, entity: str) -> DataFrame:
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(kind).alias("kinds"), F.count_distinct(entity).alias("entities"))


def tool_audit(df: DataFrame, tool: str, status: str, states: Sequence[str], duration: str) -> DataFrame:
    """Calls per tool and state, and durations, in one aggregate."""
    per = [F.count_if(F.coalesce(F.col(status) == s, F.lit(False))).alias(s) for s in states]
    return df.where(F.col(tool).isNotNull()).groupBy(tool).agg(*per, F.count(F.lit(1)).alias("calls"), r(F.avg(duration)).alias("mean_duration"), r(F.max(duration)).alias("max_duration"))


def cache_key(text: str | Column, model: str, revision: str = "1", width: int = 64, normalised: bool = True) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(revision), F.lit(str(width)), F.lit(str(normalised).lower()), F.coalesce(col(text), F.lit(""))), 256)


def hashing_embedder(width: int = 64) -> Callable[[pd.Series], list]:
    """A small deterministic stand-in for a model: signed counts of hashed character trigrams, scaled to length one; all texts of a batch at once."""
    u = np.uint64

    def embed(texts: pd.Series) -> list:
        whole = [t or "" for t in texts]
        codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(u)
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        row = np.repeat(np.arange(len(whole)), sizes)[: max(0, len(codes) - 2)]
        at = np.flatnonzero(np.arange(len(row)) + 2 < np.cumsum(sizes)[row])
        h = (codes[at] * u(0x9E3779B97F4A7C15) + codes[at + 1]) * u(0xC2B2AE3D27D4EB4F) + codes[at + 2]
        h = (h ^ (h >> u(31))) * u(0x94D049BB133111EB)
        h ^= h >> u(29)
        place = row[at] * width + (h % u(width)).astype(np.int64)
        out = np.bincount(place, np.where(h >> u(40) & u(1), 1.0, -1.0), len(whole) * width).reshape(len(whole), width)
        return (out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-12)).astype(np.float32).tolist()

    return embed


def embed_incrementally(df: DataFrame, cache: DataFrame, embed: Callable[[pd.Series], list], model: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with vector, new cache rows): texts whose key is cached are not embedded, each other distinct text once."""
    keyed = df.withColumn("cache_key", cache_key(text, model))
    new = keyed.select("cache_key", F.col(text).alias("text")).dropDuplicates(["cache_key"]).join(cache, "cache_key", "left_anti")

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"cache_key": f["cache_key"], "vector": embed(f["text"])})

    made = new.mapInPandas(run, "cache_key string, vector array<float>")
    return keyed.join(cache.select("cache_key", "vector").unionByName(made), "cache_key", "left"), made


def job_status(items: DataFrame, job: str = "job_id", status: str = "status") -> DataFrame:
    done, failed, n = F.count_if(F.col(status) == "done"), F.count_if(F.col(status) == "failed"), F.count(F.lit(1))
    state = F.when(done == n, "completed").when(done + failed == n, "failed").when(done > 0, "running").otherwise("pending")
    return items.groupBy(job).agg(n.alias("items"), done.alias("done"), failed.alias("failed"), r(done / n * 100, 2).alias("progress"), state.alias("state"))


def pending(items: DataFrame, status: str = "status") -> DataFrame:
    """What a resumed job still has to do."""
    return items.where(F.coalesce(F.col(status), F.lit("")) != "done")


def timings(df: DataFrame, name: str, seconds: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), r(F.sum(seconds), 2).alias("total"), r(F.max(seconds)).alias("longest"))


def reembed(df: DataFrame, embed: Callable[[pd.Series], list], model: str, text: str = "text", most: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(rows with vector and error, one row of counts) of a move to a new model.

    Texts above ``most`` characters, the model's limit, fail and keep no vector; each other distinct text is embedded once.
    """
    long = F.length(F.coalesce(F.col(text), F.lit(""))) > most
    cache = df.sparkSession.createDataFrame([], "cache_key string, vector array<float>")
    done, made = embed_incrementally(df.where(~long), cache, embed, model, text)
    failed = df.where(long).withColumn("error", F.lit("too long"))
    rows = done.withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)
    counts = df.agg(F.count_if(~long).alias("succeeded"), F.count_if(long).alias("failed"))
    return rows, counts.join(F.broadcast(made.agg(F.count(F.lit(1)).alias("embedded"))))
