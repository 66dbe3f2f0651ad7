"""Near-duplicate documents by MinHash with tensored banding, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_KEYS, components, materialize, semi_join, table
from tessera.llm.kernels import U, Words, blocks, column, list_column, mix, parts
from tessera.llm.stars import compare_blocks, in_blocks, meetings, unsettled

SIDE = 8  #: keys in each of the two collections; SIDE * SIDE tables
ROWS = 2  #: minhashes in one key of a collection
LIGHT = 32  #: sets that begin with a shingle, up to which they are joined pair by pair; more are compared in blocks
BLOCK = 1 << 18  #: shingles in a block; a larger set is a block of its own
CELLS = 1 << 19  #: counts held at once when blocks are compared
SEED = 20240229
SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, a array<long>, b array<long>"


def shingle_sets(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text one after the other, and their counts."""
    w = Words(raws)
    salt = mix(np.arange(1, k + 1, dtype=U)) | U(1)
    n = len(w.hash)
    total = np.zeros(max(0, n - k + 1), U)
    for j in range(k if len(total) else 0):
        total += w.hash[j : n - k + 1 + j] * salt[j]
    total = mix(total)
    out = []
    for first, count in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if count >= k:
            out.append(np.unique(total[first : first + count - k + 1]))
        elif count:
            out.append(mix((w.hash[first : first + count] * salt[:count]).sum(keepdims=True) + U(count)))
        else:
            out.append(total[:0])
    counts = np.fromiter(map(len, out), np.int64, len(out))
    return (np.concatenate(out) if out else total[:0]), counts


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    need = 2 * SIDE * ROWS

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        mul, add = rng.integers(1, 1 << 63, (2, need), dtype=np.uint64) * U(2) + U(1)
        for batch in parts(batches):
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for at, raws in blocks(texts):
                flat, counts = shingle_sets(raws, k)
                some = np.flatnonzero(counts)
                offsets = (np.cumsum(counts) - counts)[some]
                least = np.zeros((len(raws), need), U)
                s1, s2 = np.zeros(len(raws), U), np.zeros(len(raws), U)
                if len(some):
                    for j in range(need):
                        least[some, j] = np.minimum.reduceat(flat * mul[j] + add[j], offsets)
                    s1[some] = np.add.reduceat(flat, offsets)
                    s2[some] = np.add.reduceat(mix(flat ^ U(SEED)), offsets)
                keys = np.zeros((len(raws), 2 * SIDE), U)
                for r in range(ROWS):
                    keys = mix(keys + least[:, r::ROWS])
                keys = keys.view(np.int64)
                each = np.full(len(raws), SIDE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + len(raws)], pa.int64()), pa.array(counts), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     list_column(keys[:, :SIDE].ravel(), each, pa.int64()), list_column(keys[:, SIDE:].ravel(), each, pa.int64())],
                    names=["doc_id", "n_shingles", "s1", "s2", "a", "b"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(sign, SIGNATURE)


def shingles(docs: DataFrame, k: int) -> DataFrame:
    """rep, s1, set: the whole sorted shingle set of each text, and the sum of its hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for at, raws in blocks(texts):
                flat, counts = shingle_sets(raws, k)
                total = np.concatenate((np.zeros(1, U), np.cumsum(flat)))
                ends = np.cumsum(counts)
                s1 = (total[ends] - total[ends - counts]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + len(raws)], pa.int64()), pa.array(s1), list_column(flat.view(np.int64), counts, pa.int64())], names=["rep", "s1", "set"])

    return docs.mapInArrow(sets, "rep long, s1 long, set array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, from the whole sets."""
    size = F.size
    left = pairs.join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a")
    both = both.where(100 * F.least(size("sa"), size("sb")) >= percent * F.greatest(size("sa"), size("sb")))
    both = both.withColumn("common", size(F.array_intersect("sa", "sb")))
    return both.where(100 * F.col("common") >= percent * (size("sa") + size("sb") - F.col("common"))).select("a", "b")


def _rest(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket (key, a, rep of ``members``), by an exact prefix filter.

    Shingles of one document only can't be common: where they leave less than ``percent`` of a set, it has no link. The
    others are sorted, rarest first; two linked sets must share one of the first n - ceil(percent * n / 100) + 1. Pairs
    that share one which LIGHT sets or fewer begin with are joined, and confirmed where the place of the last shared
    one leaves room for enough more. Sets that share a more frequent one are compared block against block.
    """
    docs = unsettled(members, comp).groupBy("rep", "c").agg(F.min("a").alias("near"), F.max("asks").alias("asks"))
    full = materialize(docs.join(sets, "rep").withColumn("n", F.size("set")))
    all_ = full.select("rep", "s1", F.explode("set").alias("t"))
    shared = all_.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    ranked = all_.join(shared, "t").groupBy("rep", "s1").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ranked"))
    rows = full.drop("set").join(ranked, ["rep", "s1"]).withColumn("set", F.transform("ranked", lambda x: x["t"])).drop("ranked")
    rows = materialize(rows.where(100 * F.size("set") >= percent * F.col("n")))
    alone = F.col("n") - F.size("set")
    begin = F.slice("set", F.lit(1), (F.floor((100 - percent) * F.col("n") / 100) + 1 - alone).cast("int"))
    first = rows.select("rep", "s1", "c", "asks", "n", alone.alias("alone"), F.posexplode(begin).alias("place", "key"))
    tokens = first.groupBy("key").agg(F.count(F.lit(1)).alias("f"), F.max("asks").alias("asks"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    tokens = materialize(tokens.where("asks and lo < hi").select("key", "f"))
    first = materialize(first.join(tokens, "key"))

    few = first.where(F.col("f") <= LIGHT).withColumn("left", F.col("n") - F.col("alone") - F.col("place") - 1)
    x, y = (few.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("rep", "s1", "c", "n", "left", "asks")]) for i in (1, 2))
    met = x.where("asks1").join(y, "key").where("c1 != c2 and (not asks2 or rep1 < rep2)").where(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    met = met.groupBy("rep1", "s11", "rep2", "s12").agg(F.count(F.lit(1)).alias("k"), F.min("left1").alias("left1"), F.min("left2").alias("left2"), F.min("n1").alias("n1"), F.min("n2").alias("n2"))
    seen = first.where(F.col("f") > LIGHT).select("key", "rep", "asks")
    met = met.where((100 + percent) * (F.col("k") + F.least("left1", "left2")) >= percent * (F.col("n1") + F.col("n2")))
    pairs = materialize(met.select(F.least("rep1", "rep2").alias("a"), F.greatest("rep1", "rep2").alias("b")).distinct())
    links = confirmed(pairs, sets, percent)
    if seen.isEmpty():
        return links

    many = in_blocks(rows.join(seen.select("rep").distinct(), "rep", "left_semi").select("rep", "c", "asks", "n", "near", "set"), ["near", F.desc("asks"), "rep"], "n", BLOCK)
    many = materialize(many)
    meet = meetings(seen.select("key", "rep", "asks").join(many.select("rep", "block").distinct(), "rep"))

    def compare(group: pa.Table, asked: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, c = group["n"].to_numpy(), group["c"].to_numpy()
        sets_ = group["set"].combine_chunks()
        flat, size = sets_.flatten().to_numpy(), sets_.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(size) - size

        def tokens_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.repeat(first[some] - (np.cumsum(size[some]) - size[some]), size[some])
            return flat[at + np.arange(len(at))], np.repeat(np.arange(len(some)), size[some])

        token, owner = tokens_of(all_)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, CELLS // max(1, len(all_)))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            t, o = tokens_of(some)
            lo, hi = np.searchsorted(token, t), np.searchsorted(token, t, "right")
            common = np.zeros(len(some) * len(all_), np.int64)
            ends = np.cumsum(hi - lo)
            cut = 0
            while cut < len(t):
                stop = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CELLS, "right")))
                many_ = (hi - lo)[cut:stop]
                place = np.arange(many_.sum()) + np.repeat(lo[cut:stop] - (np.cumsum(many_) - many_), many_)
                common += np.bincount(np.repeat(o[cut:stop], many_) * len(all_) + owner[place], minlength=len(common))
                cut = stop
            common = common.reshape(len(some), len(all_))
            hit = (c[some][:, None] != c[all_]) & ((100 + percent) * common >= percent * (n[some][:, None] + n[all_]))
            q, m = np.nonzero(hit)
            found.append((some[q], all_[m]))
        a, b = (np.concatenate(v) for v in zip(*found, strict=True))
        return a, b

    return links.unionByName(compare_blocks(many.drop("near"), meet, compare))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Sets of distinct k-word shingles (A-Z lower-cased, words split at ASCII white space); documents are linked when
    100 * intersection >= percent * union, and a component is kept by its smallest id. Fewer than k words: the
    whole sequence is one shingle. Null or wordless texts have an empty set and are linked with nothing.
    Null ids are not linked either (component_id null, kept true). Repeated rows get the same result; rows of one id
    with different texts are one document that has the links of all of them. Other columns are ignored; an empty
    table gives an empty result.

    Tensored banding: two collections of SIDE keys, each of ROWS minhashes; every pair of a key from the first and
    one from the second is a table key, so 2 * SIDE * ROWS = 32 minhashes serve SIDE**2 = 64 tables. At a similarity
    of 0.8 a pair shares a table key with probability (1 - (1 - 0.8**ROWS)**SIDE)**2 = 0.9994.

    Documents with one set are folded first. In each bucket the members are compared with one centre, not with each
    other. Where a bucket then lies in several components, those outside its largest one are compared with the others
    behind an exact prefix filter. So no link that would join two components is lost, and no bucket is expanded into
    pairs.
    """
    signed = materialize(signatures(docs, k, id_col, text_col))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")))
    reps, classes = classes.select("rep", "a", "b"), classes.select("s1", "s2", "rep")

    keys = F.flatten(F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * SIDE + j))))
    tables = reps.select("rep", F.explode(keys).alias("key"))
    buckets = materialize(tables.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("rep").alias("a")).where("k > 1"))
    members = materialize(tables.join(buckets, "key").select("key", "k", "a", "rep"))
    ids = materialize(members.select(F.col("rep").alias("doc_id")).distinct())
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(shingles(semi_join(text, ids, "doc_id"), k).dropDuplicates(["rep", "s1"]))

    tried = members.where("a != rep").select("a", F.col("rep").alias("b")).distinct()
    several = real.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("doc_id")
    several = real.join(F.broadcast(several) if several.count() <= BROADCAST_KEYS else several, "doc_id", "left_semi").join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialize(confirmed(tried, sets, percent).unionByName(several))
    comp = materialize(components(links))
    more = materialize(_rest(members.where("k > 2"), comp, sets, percent))
    if not more.isEmpty():
        comp = materialize(components(links.unionByName(more)))

    whole = signed.join(classes, ["s1", "s2"], "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.withColumn("component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id")))
    return whole.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=4, percent=80)
