"""Toxicity from the nearest labelled examples by TF-IDF cosine, found with a block-max inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.kernels import LOWER, U, Rolling, blocks, column, list_column, mix, parts
from tessera.llm.language_id import remainder

POSITIVE, NEGATIVE = 2000, 4000  #: labelled rows used, at most, of either label
TERMS = 1 << 22  #: places that term hashes are dealt to
SMOOTH = 8  #: texts added to a term's counts, in the labels' shares, before its rates are compared
NEIGHBOURS = 15
BLOCK_SIZE = 64  #: examples in a block of the index
DENSE = 1024  #: terms of the most examples, kept as matrix columns; all others have posting lists
POSTINGS = 1 << 21  #: postings read at once
STEM = 4  #: bytes of a word that make a term of their own, for words of which only the beginning recurs
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of every word and every word's beginning; A-Z lower-cased."""
    data = LOWER[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raws])
    edge = np.diff(_WORD[data].astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    roll = Rolling(data)
    doc = np.searchsorted(ends, start, "right")
    long = end - start > STEM
    whole = mix(roll.ranges(start, end) + (end - start).astype(U))
    head = mix(roll.ranges(start[long], start[long] + STEM) + U(1 << 32))
    return np.concatenate((doc, doc[long])), np.concatenate((whole, head))


def per_text(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the distinct terms of each text; a term is a place below TERMS."""
    doc, term = terms(raws)
    key, times = np.unique(doc * TERMS + (term % U(TERMS)).astype(np.int64), return_counts=True)
    return key // TERMS, key % TERMS, times


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Texts with each term, over all documents, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(TERMS, np.int64), 0
        for batch in parts(batches):
            rows += batch.num_rows
            for _, raws in blocks(column(batch, "text")):
                np.add.at(sums, per_text(raws)[1], 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(sums[some], rows))], names=["term", "n"])

    got = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most TERMS + 1 rows
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(TERMS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, y, terms, times: of every whole text."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for at, raws in blocks(column(batch, "text")):
                doc, term, times = per_text(raws)
                number = np.bincount(doc, minlength=len(raws))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(at, len(raws)) for c in (0, 1)], list_column(term, number, pa.int32()), list_column(times, number, pa.int32())], names=["doc_id", "y", "terms", "times"]
                )

    return docs.select("doc_id", "y", "text").mapInArrow(look, "doc_id long, y int, terms array<int>, times array<int>")


@dataclass
class Examples:
    """Labelled vectors and the calibration of their votes."""

    ids: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    idf: np.ndarray
    prior: float
    known: np.ndarray | None = None  # the examples' terms, sorted; row, term and idf count these
    scale: np.ndarray | None = None  # weight of every term, other terms than the examples' too
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0


class BlockMaxIndex:
    """Examples cut into blocks; the DENSE most common terms as a matrix with their largest weight per block, the others as postings.

    The postings of a query's other terms are read in full. A block's bound is its best sum of those plus the query's
    product with the matrix's maxima. Blocks whose bound can't beat a query's k-th best similarity are left out for it,
    so the nearest examples are exact.
    """

    def __init__(self, e: Examples, dense: int = DENSE):
        self.e = e
        n, t = len(e.ids), len(e.idf)
        self.blocks = -(-n // BLOCK_SIZE)
        common = np.argsort(-np.bincount(e.term, minlength=t), kind="stable")[:dense]
        self.slot = np.full(t, -1, np.int32)
        self.slot[common] = np.arange(len(common))
        slot = self.slot[e.term]
        self.matrix = np.zeros((self.blocks * BLOCK_SIZE, len(common)), np.float32)
        self.matrix[e.row[slot >= 0], slot[slot >= 0]] = e.weight[slot >= 0]
        self.most = self.matrix.reshape(self.blocks, BLOCK_SIZE, len(common)).max(axis=1)
        rest = np.flatnonzero(slot < 0)
        rest = rest[np.lexsort((e.row[rest], e.term[rest]))]
        self.row, self.weight = e.row[rest].astype(np.int32), e.weight[rest]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(e.term[rest], minlength=t))))

    def search(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, similarity) of the k nearest examples of ``count`` queries with a similarity above 0, ties by row.

        ``doc`` ascends; ``skip`` has an example for each query that is left out for it.
        """
        reads = np.concatenate(([0], np.cumsum(np.where(self.slot[term] < 0, self.first[term + 1] - self.first[term], 0))))
        ends = np.searchsorted(doc, np.arange(count + 1))
        out, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))], 0
        while at < count:
            to = int(np.searchsorted(reads[ends], reads[ends[at]] + POSTINGS, "right")) - 1
            to = min(max(to, at + 1), at + 256, count)
            s = slice(ends[at], ends[to])
            q, row, sim = self._some(doc[s] - at, term[s], weight[s], to - at, k, None if skip is None else skip[at:to])
            out.append((q + at, row, sim))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _some(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, m: int, k: int, skip: np.ndarray | None) -> tuple:
        n, slot = self.blocks * BLOCK_SIZE, self.slot[term]
        query = np.zeros((m, self.matrix.shape[1]), np.float32)
        query[doc[slot >= 0], slot[slot >= 0]] = weight[slot >= 0]
        few = slot < 0
        first, number = self.first[term[few]], self.first[term[few] + 1] - self.first[term[few]]
        place = np.arange(number.sum()) + np.repeat(first - (np.cumsum(number) - number), number)
        cell = np.repeat(doc[few] * n, number) + self.row[place]
        sims = np.bincount(cell, np.repeat(weight[few], number) * self.weight[place], m * n).astype(np.float32).reshape(m, n)
        if skip is not None:
            sims[np.arange(m), skip] = -np.inf
        best = sims.reshape(m, self.blocks, BLOCK_SIZE).max(axis=2)
        bound = best + query @ self.most.T
        floor = np.zeros(m, np.float32)  # no more than the k-th best similarity
        for i, b in enumerate(np.argsort(-bound.sum(axis=0), kind="stable").tolist()):
            if i % 4 == 0 and self.blocks >= k:
                floor = np.maximum(np.partition(best, self.blocks - k, axis=1)[:, self.blocks - k], 0) * np.float32(1 - 1e-5)
            s = slice(b * BLOCK_SIZE, (b + 1) * BLOCK_SIZE)
            may = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= floor))
            if len(may):
                sims[may, s] += query[may] @ self.matrix[s].T
                best[may, b] = sims[may, s].max(axis=1)
        if self.blocks >= k:
            floor = np.maximum(np.partition(best, self.blocks - k, axis=1)[:, self.blocks - k], 0) * np.float32(1 - 1e-5)
        q, row = np.nonzero((sims > 0) & (sims >= floor[:, None]))
        sim = sims[q, row]
        order = np.lexsort((row, -np.round(sim, 6), q))
        q, row, sim = q[order], row[order], sim[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], row[keep], sim[keep]

    def nearest(self, terms_: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k nearest examples of one query."""
        _, rows, sims = self.search(np.zeros(len(terms_), np.int64), terms_, weights, 1, k, np.array([skip]) if skip >= 0 else None)
        return rows, sims

    def votes(self, q: np.ndarray, row: np.ndarray, sim: np.ndarray, count: int) -> np.ndarray:
        """Share of each query's labels, weighted by similarity over distance, with the prior as one far example."""
        w = sim / (1.05 - np.minimum(sim, 1))
        return (np.bincount(q, w * self.e.labels[row], count) + 0.5 * self.e.prior) / (np.bincount(q, w, count) + 0.5)


def weighted(doc: np.ndarray, term: np.ndarray, times: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length per text."""
    w = (1 + np.log(times)) * scale[term]
    return (w / np.maximum(np.sqrt(np.bincount(doc, w * w)), 1e-9)[doc]).astype(np.float32)


def _marking(label: np.ndarray, once: np.ndarray, row: np.ndarray, term: np.ndarray, known: int) -> np.ndarray:
    """1 and more for each term: how far its rates in the two labels are apart, in powers of two, smoothed, in the rows of ``once``."""
    ones, zeros = max(1, int(label[once].sum())), max(1, int((1 - label)[once].sum()))
    row, term = row[once[row]], term[once[row]]
    share = SMOOTH / (ones + zeros)
    a, both = np.bincount(term, label[row], known), np.bincount(term, minlength=known)
    return 1 + np.abs(np.log2((a / ones + share) / ((both - a) / zeros + share)))


def fit(labelled: DataFrame, docs: DataFrame, positives: int = POSITIVE, negatives: int = NEGATIVE) -> Examples:
    """Examples from labelled rows (doc_id, y) and all documents (doc_id, text).

    At most so many ``positives`` and ``negatives`` of the labelled rows, by a hash of their ids, are the examples. Document frequencies are of
    all terms of all documents.
    """
    one = labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    one = one.withColumn("h", F.xxhash64("doc_id", F.lit("toxic")))
    totals = one.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    kept = one.where("y = 1").orderBy("h", "doc_id").limit(positives).unionByName(one.where("y = 0").orderBy("h", "doc_id").limit(negatives))
    kept = materialize(kept.select("doc_id", F.col("y").cast("int").alias("y")))
    examples = docs.join(F.broadcast(kept), "doc_id").groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    got = vectors(examples).toArrow().sort_by("doc_id").combine_chunks()  # the examples' distinct terms only
    df, size = frequencies(docs)
    ids, y = got["doc_id"].to_numpy(), got["y"].to_numpy().astype(np.int64)
    flat = [got[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times")]
    number = got["terms"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
    full = number > 0
    row = np.repeat(np.arange(int(full.sum())), number[full])
    known, term = np.unique(flat[0], return_inverse=True)
    scale = np.log1p(max(1, size) / np.maximum(df, 1))
    ends = np.cumsum(number[full])
    texts = [flat[0][a:b].tobytes() + flat[1][a:b].tobytes() for a, b in zip(ends - number[full], ends, strict=True)]
    once = np.zeros(len(texts), bool)
    once[list({t: i for i, t in enumerate(texts)}.values())] = True  # a copied text counts once
    scale[known] *= _marking(y[full], once, row, term, len(known))
    scale = scale.astype(np.float32)
    prior = totals[0] / max(1, totals[0] + totals[1])
    e = Examples(ids[full], y[full].astype(np.float32), row, term, weighted(row, flat[0], flat[1], scale), scale[known], prior, known, scale)
    _calibrate(e, y, y[~full], totals)
    return e


def _calibrate(e: Examples, labels: np.ndarray, bare: np.ndarray, totals: tuple) -> None:
    """Platt scaling of leave-one-out votes; the sample's labels are weighed back to their shares."""
    ones = int(labels.sum())
    weight = np.array([totals[1] / max(1, len(labels) - ones), totals[0] / max(1, ones)])
    e.empty = float((weight[1] * bare.sum() + e.prior) / (weight[bare].sum() + 1)) if len(labels) else 0.0
    if not len(e.ids):
        return
    index, n = BlockMaxIndex(e), len(e.ids)
    raw = index.votes(*index.search(e.row, e.term, e.weight, n, NEIGHBOURS, np.arange(n)), n)
    x = np.log(np.clip(raw, 1e-4, 1 - 1e-4) / (1 - np.clip(raw, 1e-4, 1 - 1e-4)))
    y = e.labels.astype(float)
    w = weight[e.labels.astype(np.int64)]
    goal = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - goal) * x).sum() + 0.1 * (a - 1), (w * (p - goal)).sum() + 0.1 * b])
        s = w * p * (1 - p)
        hess = np.array([[(s * x * x).sum() + 0.1, (s * x).sum()], [(s * x).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    e.slope, e.shift = max(a, 0.05), b


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVE, negatives: int = NEGATIVE) -> DataFrame:
    """One row per input row: doc_id, score, evidence (ids of the nearest labelled examples, at most five).

    ``labelled`` has doc_id and y (1 toxic); rows with a null of either are left out and the highest label of a
    repeated id holds. Terms are all words and beginnings of words; a term's inverse document frequency is of all
    documents, and its weight is multiplied by how far its rates in the labels are apart, by 1 at least. A whole text's
    TF-IDF vector is compared by cosine with the examples', exactly, and the NEIGHBOURS nearest vote by closeness. Texts
    without any word, null and empty ones too, get the toxic share of examples without any. Without labels every
    score is 0. Of equally near examples the one of the smaller id votes. Ids may be null or repeated; other columns are
    ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    e = fit(labelled, base, positives, negatives)
    shared = docs.sparkSession.sparkContext.broadcast(e)  # bounded by POSITIVE + NEGATIVE examples and TERMS weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, index = shared.value, None
        for batch in parts(batches):
            index = index or BlockMaxIndex(e)
            for at, raws in blocks(column(batch, "text")):
                doc, term, times = per_text(raws)
                m = len(raws)
                scores, why = np.full(m, e.empty), np.zeros(0, np.int64)
                number = np.zeros(m, np.int64)
                if len(e.ids):
                    weight = weighted(doc, term, times, e.scale)
                    place = np.minimum(np.searchsorted(e.known, term), len(e.known) - 1)
                    hit = e.known[place] == term
                    q, row, sim = index.search(doc[hit], place[hit], weight[hit], m, NEIGHBOURS)
                    raw = np.clip(index.votes(q, row, sim, m), 1e-4, 1 - 1e-4)
                    some = np.bincount(doc, minlength=m) > 0
                    scores[some] = (1 / (1 + np.exp(-(e.slope * np.log(raw / (1 - raw)) + e.shift))))[some]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < 5
                    why, number = e.ids[row[first]], np.bincount(q[first], minlength=m)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, m), pa.array(scores, pa.float64()), list_column(why, number, pa.int64())], names=["doc_id", "score", "evidence"])

    return base.mapInArrow(score, "doc_id long, score double, evidence array<long>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").cast("int").alias("y"))
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
