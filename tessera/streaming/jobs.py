"""Structured Streaming forms of the incremental jobs. Each takes a streaming (or batch) DataFrame.

Rows later than the watermark are dropped in append mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from tessera.functions.core import in_blocks, r, safe_divide, same
from tessera.operators.chunking import finalize, fixed_windows
from tessera.operators.memory import cache_key
from tessera.sources.snapshots import BUCKETS, apply_batch


def error_rate(df: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n, errors, rate, anomalous (above 5 percent) of each window."""
    per = df.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kind) == "error").alias("errors"))
    out = per.select(F.col("window.start").alias("start"), "n", "errors", r(safe_divide("errors", "n", 100.0)).alias("rate"))
    return out.withColumn("anomalous", F.col("rate") > 5)


def windowed_counts(df: DataFrame, ts: str = "ts", kind: str = "event_type", window: str = "1 day", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return df.withWatermark(ts, late).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(df: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    per = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count(F.lit(1)).alias("events"))
    return per.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def ingest(stream: DataFrame, target: str, checkpoint: str, key: str = "doc_id", updated: str = "ts", buckets: int = BUCKETS) -> StreamingQuery:
    """New and changed documents to chunks in the snapshot ``target`` (read_snapshot() reads it); one checkpoint for each target.

    Repeats by content within the watermark go. A batch replaces all chunks of its documents, unless the snapshot has a later state
    of one, and rewrites only the buckets of their keys; a batch that is run again after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        latest = Window.partitionBy(key).orderBy(F.desc_nulls_last(updated), F.sha2("text", 256))
        docs = batch.where(F.col(key).isNotNull()).withColumn("_i", F.row_number().over(latest)).where("_i = 1").drop("_i")
        chunks = finalize(fixed_windows(docs, key), key).where("reject_reason is null").join(docs.select(key, updated), key)

        def replaced(present: DataFrame | None) -> DataFrame:
            if present is None:
                return chunks
            known = present.groupBy(key).agg(F.max(updated).alias("_known"))
            fresh = docs.select(key, updated).join(known, key, "left").where(f"_known is null or {updated} >= _known").select(key)
            return present.join(fresh, key, "left_anti").unionByName(chunks.join(fresh, key, "left_semi"))

        apply_batch(batch.sparkSession, target, docs.select(key), replaced, number, buckets)
        batch.unpersist()

    hashed = stream.withColumn("_hash", F.sha2("text", 256)).withWatermark(updated, "1 hour").dropDuplicatesWithinWatermark([key, "_hash"]).drop("_hash")
    return hashed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_stream(stream: DataFrame, cache_root: str, checkpoint: str, embed: Callable[[pd.Series], list], model: str, tries: int = 3, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Embed new texts batch by batch into the snapshot ``cache_root`` (cache_key, vector, tries, error); what is there is skipped, so a rerun resumes.

    A task tries a batch of texts ``tries`` times; texts that still fail are kept with their error and no vector, and are taken up
    again with the next batch that has them. A batch rewrites the buckets of its own keys only.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        embed_batch(batch, cache_root, embed, model, number, tries, text)
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_batch(batch: DataFrame, cache_root: str, embed: Callable[[pd.Series], list], model: str, number: int, tries: int = 3, text: str = "text") -> bool:
    """Embed the distinct texts of a batch that the cache has no vector of; False if the batch was there before."""
    wanted = batch.where(F.col(text).isNotNull()).select(cache_key(text, model).alias("cache_key"), F.col(text).alias("text")).dropDuplicates(["cache_key"])

    def merged(present: DataFrame | None) -> DataFrame:
        if present is None:
            return wanted.mapInPandas(embedder(embed, tries), EMBEDDED)
        have = present.where("vector is not null").select("cache_key")
        new = wanted.join(have, "cache_key", "left_anti")
        return new.mapInPandas(embedder(embed, tries), EMBEDDED).unionByName(present.join(new.select("cache_key"), "cache_key", "left_anti"))

    return apply_batch(batch.sparkSession, cache_root, wanted.select("cache_key"), merged, number)


EMBEDDED = "cache_key string, vector array<float>, tries int, error string"


def embedder(embed: Callable[[pd.Series], list], tries: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Vectors of frames (cache_key, text), tried again after OSError; after the last try the rows carry the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors, error, n = [None] * len(f), None, 0
            while n < tries:
                n += 1
                try:
                    vectors, error = embed(f["text"]), None
                    break
                except OSError as e:
                    error = str(e) or type(e).__name__
            yield pd.DataFrame({"cache_key": f["cache_key"], "vector": list(vectors), "tries": n, "error": error})

    return run


STATE = "entity {kind}, events long, last string, recent array<string>, expired boolean"


def running_state(df: DataFrame, entity: str = "user_id", ts: str = "ts", what: str = "event_type", keep: int = 10, idle: str = "7 days", late: str = "10 minutes", time_to_live: int | None = None) -> DataFrame:
    """entity, events, last, recent, expired: a running count, the last event and the last ``keep`` of them, per entity.

    State ends. By event time: when the watermark passes an entity's last event by ``idle``, a timer gives its row once more, with
    expired true, and forgets it. With ``time_to_live`` (milliseconds) state is forgotten by the clock instead,
    silently. Needs the RocksDB state store. running_state_of() is the same over a finished table.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    by_clock = time_to_live is not None
    silence = pd.Timedelta(idle)

    class Running(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            more = {"ttlDurationMs": time_to_live} if by_clock else {}
            self.n = handle.getValueState("n", "n long", **more)
            self.recent = handle.getListState("recent", "at timestamp, what string", **more)

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            new = pd.concat(list(rows))
            n = (self.n.get()[0] if self.n.exists() else 0) + len(new)
            old = [(pd.Timestamp(a), w) for a, w in self.recent.get()] if self.recent.exists() else []
            both = sorted([*old, *zip(map(pd.Timestamp, new[ts]), new[what], strict=True)], key=lambda x: (x[0], str(x[1])))[-keep:]
            self.n.update((n,))
            self.recent.put([(a.to_pydatetime(), w) for a, w in both])
            if not by_clock:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(int((both[-1][0] + silence).timestamp() * 1000))
            yield self.row(key, n, both, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            if self.n.exists():
                yield self.row(key, self.n.get()[0], list(self.recent.get()), True)
            self.n.clear()
            self.recent.clear()

        def row(self, key, n, recent, expired) -> pd.DataFrame:
            names = [w for _, w in recent]
            return pd.DataFrame({"entity": [key[0]], "events": [n], "last": [names[-1] if names else None], "recent": [names], "expired": [expired]})

        def close(self) -> None:
            pass

    rows = df.select(F.col(entity), ts, what)
    rows = rows if by_clock else rows.withWatermark(ts, late)
    kind = df.schema[entity].dataType.simpleString()
    return rows.groupBy(entity).transformWithStateInPandas(Running(), STATE.format(kind=kind), "Update", "ProcessingTime" if by_clock else "EventTime")


def running_state_of(df: DataFrame, entity: str = "user_id", ts: str = "ts", what: str = "event_type", keep: int = 10, idle: str = "7 days") -> DataFrame:
    """entity, events, last, recent: what running_state() knows of each entity after the last row, expired or not: all since its last silence of ``idle``.

    Events of one time are in the order of ``what``. Silences are found in blocks of a series, so a busy entity is many tasks.
    """
    rows = df.where(F.col(ts).isNotNull()).select(F.col(entity).alias("entity"), F.col(ts).alias("at"), F.col(what).alias("what"))
    blocks = in_blocks(rows, "at", ["entity"], 1)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("entity", "_block").orderBy("_pos"))
    starts = blocks.withColumn("_gap", gap).where("not _halo").where(F.col("_gap") > F.expr(f"interval {idle}"))
    starts = starts.groupBy("entity").agg(F.max("at").alias("_from"))
    live = same(rows, starts, ["entity"], "left").where("_from is null or at >= _from")
    count = live.groupBy("entity").agg(F.count(F.lit(1)).alias("events"))
    late = Window.partitionBy("entity").orderBy(F.desc("at"), F.desc("what"))
    few = live.withColumn("_i", F.row_number().over(late)).where(F.col("_i") <= keep)
    few = few.groupBy("entity").agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_i", "what")))), lambda x: x.what).alias("recent"))
    return same(count, few, ["entity"]).select("entity", "events", F.element_at("recent", -1).alias("last"), "recent")
