"""Removal of long repeated byte strings, bucket by bucket, with ranks of a cover sample; ranks are hashes.

A plain difference cover takes the positions whose remainder modulo v lies in a fixed set, 8 of 57 for strings of 100
bytes: a seventh of all suffixes would be shuffled. Here the cover is chosen by content instead: in each window of
``length`` bytes the position whose k bytes hash lowest (the rightmost of equals). Any two equal windows then have a
sampled position at the same distance from their starts, which is the property that the cover is for, and only a
thirty-fifth of all positions is sampled. A sampled position stands for the run of consecutive windows that chose it.

Its rank has two parts: the hash of its k bytes (the suffix bucket) and the hash of the whole stretch of bytes under
its run. Equal ranks settle all windows of a run at once, which is how long ties are resolved without comparing bytes.
Buckets of one member hold no repeat and go. What is left, runs in a common bucket with different stretches, is
sorted bucket by bucket on the windows themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import BROADCAST_KEYS, anti_join, materialize, semi_join, table
from tessera.llm.kernels import BLOCK, U, RollingGrams, column, mix, parts

SAMPLE = 32  #: bytes hashed at a position, for strings of three times as many bytes or more
LONGEST = 4000  #: bytes of a string, at most: offsets in a run are kept in BITS bits
BITS = 12
LOCAL = (1 << BITS) - 1  #: in the place of the offset: a stretch repeated inside its own document
HOT = 2000  #: members of a bucket that one task may sort; larger buckets are spread by window
NO_ID = -(2**63)
_LOW = U(0xFFFFFFFF)


def sample_bytes(length: int) -> int:
    return min(SAMPLE, max(1, length // 3))


def cover_sample(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, position, first window, last window, bucket, rank) of the sampled positions of texts laid end to end."""
    none = np.zeros(0, np.int64)
    windows = len(data) - length + 1
    if windows <= 0:
        return none, none, none, none, none.view(U), none.view(U)
    k = sample_bytes(length)
    width = length - k + 1
    hashes = RollingGrams(data, 0).every(k)
    at = np.arange(len(hashes), dtype=U)
    packed = np.full(-(-len(hashes) // width) * width, ~U(0))
    packed[: len(hashes)] = (hashes & ~_LOW) | (_LOW - at)
    table2 = packed.reshape(-1, width)
    head = np.minimum.accumulate(table2, axis=1).ravel()
    tail = np.minimum.accumulate(table2[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (_LOW - (np.minimum(tail[:windows], head[width - 1 : width - 1 + windows]) & _LOW)).astype(np.int64)
    valid = np.zeros(windows + 1, bool)
    begin = 0
    for end in ends.tolist():
        if end - begin >= length:
            valid[begin : end - length + 1] = True
        begin = end
    new = np.ones(windows + 1, bool)
    new[1:windows] = chosen[1:] != chosen[:-1]
    first = np.flatnonzero(valid[:-1] & (new[:-1] | ~np.concatenate(([False], valid[:-2]))))
    last = np.flatnonzero(valid[:-1] & (new[1:] | ~valid[1:]))
    position = chosen[first]
    shape = ((position - first) << BITS | (last - first)).astype(U)
    rank = mix(RollingGrams(data, 1).ranges(first, last + length) + mix(shape + U(1)))
    return np.searchsorted(ends, first, "right"), position, first, last, hashes[position], rank


def _stretches(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Blocks of (index of text, its offset) with bytes and ends; texts longer than a block overlap by a window."""
    which: list[int] = []
    offsets: list[int] = []
    held: list[bytes] = []
    total = 0
    for i, raw in enumerate(texts):
        if len(raw) < length:
            continue
        for offset in range(0, len(raw) - length + 1, BLOCK):
            piece = raw[offset : offset + BLOCK + length - 1]
            if held and total + len(piece) > BLOCK:
                yield which, offsets, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])
                which, offsets, held, total = [], [], [], 0
            which.append(i)
            offsets.append(offset)
            held.append(piece)
            total += len(piece)
    if held:
        yield which, offsets, np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held])


def _raws(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    ids = np.array([NO_ID if x is None else x for x in column(batch, "doc")], np.int64)
    return ids, [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column(batch, "text")]


def _bucket_keys(docs: DataFrame, length: int) -> DataFrame:
    """The bucket of each sampled position, once for each different rank in a document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kh, *_ in _sampled(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64))], names=["kh"])

    return docs.mapInArrow(keys, "kh long")


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bucket, rank, document, first window, offset, further windows), then local repeats as (document, start, bytes)."""
    for batch in parts(batches):
        ids, raws = _raws(batch)
        for which, offsets, data, ends in _stretches(raws, length):
            text, position, first, last, kh, rank = cover_sample(data, ends, length)
            starts = np.concatenate(([0], ends[:-1]))
            shift = np.array(offsets)[text] - starts[text]
            doc = np.array(which)[text]
            order = np.lexsort((first, rank, kh, doc))
            same = np.zeros(len(order), bool)
            a, b = order[:-1], order[1:]
            same[b] = (doc[a] == doc[b]) & (rank[a] == rank[b]) & (kh[a] == kh[b])
            new = ~same
            doc_id = ids[doc]
            begin, end = (first + shift)[same], (last + shift + length)[same]
            owner, begin, end = merged(doc[same], begin, end)
            yield kh[new], rank[new], doc_id[new], (first + shift)[new], (position - first)[new], (last - first)[new], ids[owner], begin, end


def merged(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges, as disjoint ranges that do not touch, by owner."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    base = np.unique(owner, return_inverse=True)[1] * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.ones(len(owner), bool)
    new[1:] = (begin + base)[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    stops = np.append(heads[1:], len(owner)) - 1
    return owner[heads], begin[heads], reach[stops] - base[heads]


def _members(docs: DataFrame, length: int) -> DataFrame:
    """All sampled positions as (kh, rh, doc, pk); pk packs first window, offset and further windows of the run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kh, rank, doc, first, offset, more, owner, begin, end in _sampled(batches, length):
            own = mix(owner.view(U) + mix(begin.view(U)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (
                    (kh.view(np.int64), own.view(np.int64)), (rank.view(np.int64), end - begin), (doc, owner),
                    (first << 2 * BITS | offset << BITS | more, begin << 2 * BITS | LOCAL << BITS))],
                names=["kh", "rh", "doc", "pk"],
            )

    return docs.mapInArrow(rows, "kh long, rh long, doc long, pk long")


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """(kh, doc, start, bytes) of the wanted runs of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, raws = _raws(batch)
            wanted = column(batch, "runs")
            at = 0
            while at < len(raws):  # about 2 MB of stretches at once
                out: list[tuple] = []
                held = 0
                while at < len(raws) and held < 2 << 20:
                    for run in wanted[at]:
                        start = run["pk"] >> 2 * BITS
                        out.append((run["kh"], int(ids[at]), start, raws[at][start : start + (run["pk"] & LOCAL) + length]))
                        held += length
                    at += 1
                kh, doc, start, piece = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(kh, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(piece, pa.binary())], names=["kh", "doc", "start", "piece"])

    return docs.mapInArrow(cut, "kh long, doc long, start long, piece binary")


def _windows(doc: np.ndarray, start: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(hash, other hash, document, position, row) of every window of the pieces."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    counts = np.maximum(sizes - length + 1, 0)
    row = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (np.cumsum(sizes) - sizes)[row] + within
    one, two = (RollingGrams(data, which).every(length)[at] for which in (0, 1))
    return one, two, doc[row], start[row] + within, row


def _sort_buckets(rows: DataFrame, length: int) -> DataFrame:
    """Ranges to remove, from whole buckets: partitions are by bucket and sorted by it."""

    def flush(kh: list, doc: list, start: list, pieces: list) -> pa.RecordBatch:
        w1, w2, d, i, row = _windows(np.array(doc, np.int64), np.array(start, np.int64), pieces, length)
        order = np.lexsort((i, d, w2, w1))
        w1, w2, d, i, row = w1[order], w2[order], d[order], i[order], row[order]
        head = np.ones(len(order), bool)
        head[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(order) else order
        again = (d != d[first]) | (i != i[first])
        _, begin, end = merged(row[again], i[again], i[again] + length)
        owner = merged(row[again], i[again], i[again] + length)[0]
        return pa.RecordBatch.from_arrays([pa.array(np.array(doc, np.int64)[owner]), pa.array(begin), pa.array(end)], names=["doc", "s", "e"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for batch in parts(batches):
            cols = [column(batch, c) for c in ("kh", "doc", "start", "piece")]
            for values in zip(*cols, strict=True):
                if len(held[0]) >= 8192 and held[0][-1] != values[0]:
                    yield flush(*held)
                    held = [[], [], [], []]
                for column_, v in zip(held, values, strict=True):
                    column_.append(v)
        if held[0]:
            yield flush(*held)

    return rows.repartition("kh").sortWithinPartitions("kh").mapInArrow(sort, "doc long, s long, e long")


def _spread_buckets(rows: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large for a task: windows are grouped by content, combined before the shuffle."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            doc, start = np.array(column(batch, "doc"), np.int64), np.array(column(batch, "start"), np.int64)
            w1, w2, d, i, _ = _windows(doc, start, column(batch, "piece"), length)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1.view(np.int64), w2.view(np.int64), d, i)], names=["w1", "w2", "doc", "i"])

    windows = materialize(rows.mapInArrow(explode, "w1 long, w2 long, doc long, i long"))
    first = materialize(windows.groupBy("w1", "w2").agg(F.min("doc").alias("d0"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    both = windows.join(first, ["w1", "w2"])
    start = materialize(both.where("doc = d0").groupBy("w1", "w2").agg(F.min("i").alias("i0")))
    again = both.join(start, ["w1", "w2"]).where("doc > d0 or i > i0")
    return again.select("doc", F.col("i").alias("s"), (F.col("i") + length).alias("e"))


def repeated_ranges(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc, s, e): byte ranges covered by a string of ``length`` bytes that also starts earlier; they may overlap.

    ``docs`` has doc (never null) and text.
    """
    repeated = materialize(_bucket_keys(docs, length).groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kh", F.lit(True).alias("found")))
    begin, more = F.shiftright("pk", 2 * BITS), F.col("pk").bitwiseAND(F.lit(LOCAL))
    local = F.shiftright("pk", BITS).bitwiseAND(F.lit(LOCAL)) == LOCAL
    members = _members(docs, length).join(repeated, "kh", "left").where(F.col("found") | local).drop("found")
    members = materialize(members)
    own = members.where(local).select("doc", begin.alias("s"), (begin + F.col("rh")).alias("e"))
    members = members.where(~local)
    ranks = materialize(members.groupBy("kh", "rh").agg(F.min("doc").alias("d0")))
    settled = materialize(members.join(ranks, ["kh", "rh"]).select("kh", "doc", "pk", (F.col("doc") == F.col("d0")).alias("leads")))
    ties = settled.where("not leads").select("doc", begin.alias("s"), (begin + more + length).alias("e"))

    leads = settled.where("leads")
    mixed = materialize(leads.groupBy("kh").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    runs = leads.join(mixed, "kh").groupBy("doc").agg(F.collect_list(F.struct("kh", "pk")).alias("runs"))  # as many as the text is long, at most
    runs = materialize(runs)
    pieces = semi_join(docs, runs.select("doc"), "doc").join(runs, "doc")
    pieces = materialize(_contexts(pieces, length))
    hot = materialize(mixed.where(F.col("n") > HOT).select("kh"))
    cold = _sort_buckets(pieces.join(hot, "kh", "left_anti"), length)
    found = own.unionByName(ties).unionByName(cold)
    if not hot.isEmpty():
        found = found.unionByName(_spread_buckets(pieces.join(hot, "kh", "left_semi"), length))
    return found


def _removed(docs: DataFrame) -> DataFrame:
    """doc, n_bytes, spans, kept bytes' hash and text, of texts with their ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, raws = _raws(batch)
            ranges, carried = column(batch, "ranges"), batch.column(batch.schema.get_field_index("row"))
            rows = []
            for doc, raw, found in zip(ids.tolist(), raws, ranges, strict=True):
                begin = np.array([x["s"] for x in found or []], np.int64)
                end = np.minimum(np.array([x["e"] for x in found or []], np.int64), len(raw))
                some = begin < end
                _, begin, end = merged(np.zeros(int(some.sum()), np.int64), begin[some], end[some])
                spans, kept, at, text = list(zip(begin.tolist(), end.tolist(), strict=True)), [], 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    # in the text only whole characters go
                    while s < e and raw[s] & 0xC0 == 0x80:
                        s += 1
                    stop = e
                    while stop > s and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
                        stop -= 1
                    text.append((s, stop))
                    at = e
                kept.append(raw[at:])
                out, at = [], 0
                for s, e in text:
                    out.append(raw[at:s])
                    at = e
                out.append(raw[at:])
                whole = b"".join(kept)
                rows.append((doc, len(raw), len(raw) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), b"".join(out).decode("utf-8", "replace"), [{"start": s, "end": e} for s, e in spans]))
            names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans", "row"]
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), span]
            for at in range(0, len(rows), 1000):
                some = rows[at : at + 1000]
                yield pa.RecordBatch.from_arrays([*[pa.array(x, k) for x, k in zip(zip(*some, strict=True), kinds, strict=True)], carried.slice(at, len(some))], names=names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start: long, end: long>>"
    return docs.mapInArrow(cut, StructType.fromDDL(schema).add(docs.schema["row"]))


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans.

    The columns named in ``carry`` follow in a struct ``row``.

    A byte of a text (UTF-8) is removed when a string of ``length`` bytes that covers it also starts earlier: in a
    document of smaller id, or earlier in the same one. Strings are judged on the input. ``spans`` are the maximal
    removed ranges, kept_sha256 is of the remaining bytes. kept_text is the text without the characters that lie wholly in a span.
    ``length`` is 3 to LONGEST. A null text is empty. Rows that have no place in the order, those with a null id or an id
    that has different texts, are left whole and make no other text lose anything. Equal rows count as one document.
    Other columns are ignored; an empty table gives an empty result.
    """
    if not 3 <= length <= LONGEST:
        raise ValueError(f"length must be 3 to {LONGEST}, not {length}")
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    placed = base.where(F.col("doc") != NO_ID).select("doc", "text")
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    unclear = placed.select("doc", th.alias("th")).groupBy("doc").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("doc")
    unclear = materialize(unclear)
    if not unclear.isEmpty():
        placed = anti_join(placed, unclear, "doc")
    ranges = materialize(repeated_ranges(placed, length).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("ranges")))
    hits = ranges.select("doc")
    if hits.count() <= BROADCAST_KEYS:  # only texts that lose something are shuffled
        touched = _removed(base.join(F.broadcast(hits), "doc", "left_semi").join(ranges, "doc"))
        clean = base.join(F.broadcast(hits), "doc", "left_anti").withColumn("text", F.coalesce("text", F.lit("")))
        clean = clean.select(
            "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
            F.sha2("text", 256).alias("kept_sha256"), F.col("text").alias("kept_text"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"), "row",
        )
        out = touched.unionByName(clean)
    else:
        out = _removed(base.join(ranges, "doc", "left"))
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans", *(["row"] if carry else [])]
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *columns)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text", "spans")
