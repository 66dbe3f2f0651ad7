"""Document quality from pooled random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.kernels import SPACE, U, Rolling, blocks, column, list_column, mix, parts
from tessera.llm.language_id import remainder

BUCKETS = 1 << 14  #: words share so many vectors, by their hash
WIDTH = 24  #: of a vector
NONZERO = 4  #: entries of +1 or -1 in a word's index vector
HIDDEN = 32
LABELLED = 20_000  #: labelled rows that the network learns from, at most, by a hash of their ids
SEED = 7
_KIND = np.ones(256, np.uint8)
_KIND[SPACE] = 0
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 2


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word: a run of letters and digits, or of ASCII punctuation."""
    data = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    kind = _KIND[data]
    cut = np.flatnonzero(np.diff(kind, prepend=0) != 0)
    start = cut[kind[cut] > 0]
    end = np.append(cut, len(data))[np.searchsorted(cut, start) + 1]
    h = mix(Rolling(data).ranges(start, end) + (end - start).astype(U))
    return np.searchsorted(ends, start, "right"), (h % U(BUCKETS)).astype(np.int64)


def index_vectors() -> np.ndarray:
    """The sparse random vector of each bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, WIDTH), np.int64)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    return out


def context_sums(docs: DataFrame) -> DataFrame:
    """bucket, v0, v1, ...: sums of the index vectors of each word's two neighbours, over all documents.

    The sums are whole numbers, so they don't depend on the order of rows. A task sends at most BUCKETS rows.
    """
    names = ["bucket", *[f"v{i}" for i in range(WIDTH)]]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((BUCKETS, WIDTH), np.int64)
        for batch in parts(batches):
            for _, raws in blocks(column(batch, "text")):
                doc, word = words(raws)
                near = np.flatnonzero(doc[1:] == doc[:-1])
                pair, times = np.unique(np.concatenate((word[near] * BUCKETS + word[near + 1], word[near + 1] * BUCKETS + word[near])), return_counts=True)
                mine = pair // BUCKETS
                sums = np.add.reduceat(index[pair % BUCKETS] * times[:, None], at := np.flatnonzero(np.diff(mine, prepend=-1)), axis=0) if len(pair) else index[:0]
                if len(pair):
                    total[mine[at]] += sums
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, i]) for i in range(WIDTH)]], names=names)

    sums = docs.select("text").mapInArrow(add, ", ".join(f"{n} long" for n in names))
    return sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One unit vector per bucket (zero if no word of it occurs); BUCKETS rows reach the driver."""
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for r in context_sums(docs).toLocalIterator():
        v = np.array(r[1:], float)
        out[r["bucket"]] = v / max(np.sqrt(v @ v), 1e-9)
    return out


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id, features: mean and mean square of the word vectors, how alike all words and neighbouring words are, size."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in parts(batches):
            for at, raws in blocks(column(batch, "text"), 1 << 19):
                doc, word = words(raws)
                n = np.bincount(doc, minlength=len(raws))
                some = np.flatnonzero(n)
                first = (np.cumsum(n) - n)[some]
                x = v[word]
                out = np.zeros((len(raws), 2 * WIDTH + 3), np.float32)
                if len(some):
                    each = n[some, None].astype(np.float32)
                    out[some, :WIDTH] = np.add.reduceat(x, first, axis=0) / each
                    out[some, WIDTH : 2 * WIDTH] = np.add.reduceat(x * x, first, axis=0) / each
                    out[:, 2 * WIDTH] = (out[:, :WIDTH] ** 2).sum(axis=1)
                    next_ = np.zeros(len(x), np.float32)
                    next_[:-1] = np.einsum("ij,ij->i", x[:-1], x[1:]) * (doc[:-1] == doc[1:])
                    out[some, 2 * WIDTH + 1] = np.add.reduceat(next_, first) / np.maximum(n[some] - 1, 1)
                    out[:, 2 * WIDTH + 2] = np.log1p(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), list_column(out.ravel(), np.full(len(raws), out.shape[1]), pa.float32())], names=["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(pool, "doc_id long, features array<float>")


@dataclass
class Network:
    """Two layers; scores are sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the temperature is the one of least log loss on the other fifth."""
    rng = np.random.default_rng(SEED)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (x - mean) / scale
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    b2, step = np.zeros(1), 0
    for epoch in range(epochs):
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), 128):
            some = mixed[at : at + 128]
            h = np.tanh(z[some] @ net.w1 + net.b1)
            d = (1 / (1 + np.exp(-(h @ net.w2 + b2))) - y[some]) / len(some)
            back = np.outer(d, net.w2) * (1 - h * h)
            step += 1
            slow = rate * (1 - epoch / epochs)
            for p, g, (m, s) in zip((net.w1, net.b1, net.w2, b2), (z[some].T @ back + decay * net.w1, back.sum(axis=0), h.T @ d + decay * net.w2, d.sum(keepdims=True)), state, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= slow * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    if len(held):
        raw = net.logits(x[held])
        tries = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -np.where(y[held] > 0, raw, -raw) / t).mean() for t in tries]
        net.temperature = float(tries[int(np.argmin(loss))])
    return net


def quality(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = LABELLED) -> DataFrame:
    """One row per input row: doc_id, score (probability of label 1).

    ``labelled`` has doc_id and y; rows with a null of either are left out and the highest label of a repeated id
    holds. Word vectors come from all documents, the network from at most ``most_labelled`` labelled rows, the first by a hash of their ids. Null and empty
    texts have no words and are scored from zero vectors. Without labels of both kinds every text gets one score.
    Ids may be null or repeated; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = materialize(pooled(base, word_vectors(base)))
    one = labelled.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    kept = one.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(most_labelled)
    rows = features.join(F.broadcast(kept), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("features", "y").toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(len(rows), 2 * WIDTH + 3)
    net = docs.sparkSession.sparkContext.broadcast(train(x, rows["y"].to_numpy(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.value.scores(x))], names=["doc_id", "score"])

    return features.mapInArrow(score, "doc_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").cast("int").alias("y"))
    out = quality(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
