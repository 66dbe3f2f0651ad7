"""Vector search: exact by block matrix products, approximate by cells and product codes.

No pair of a query and a row is ever a row of a plan. A task multiplies a batch of vectors with the queries in one go and keeps
the k best of each query; what tasks keep meets in a second top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.scratch import settled

#: Queries of a set that is sent to every task (32 MB at a width of 1024); larger sets are dealt in blocks of so many.
QUERY_LIMIT = 4096
#: Scores held at once.
SCORE_CELLS = 1 << 22
#: Pieces that the rows of a search are dealt to for each block of queries.
PIECES = 64
#: Rows of the sample that a coarse quantiser and its codes are fitted on.
FIT_ROWS = 20_000
#: Pairs whose vectors are multiplied at once.
PAIRS = 1 << 16


def top(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each query; Spark keeps k rows per query and task before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the whole vectors of a list column: not null, finite and of one width (that of the first, if none is given)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    width = width or next((int(n) for n in sizes if n), 0)
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros((0, width))
    flat = pc.fill_null(column.take(pa.array(at)).flatten().cast(pa.float64()), float("nan"))
    values = flat.to_numpy(zero_copy_only=False).reshape(len(at), width)
    good = np.isfinite(values).all(axis=1)
    return at[good], values[good]


def products(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores (query, row), rounded to six places so that ties are ties in any order of adding up."""
    score = queries @ rows.T
    if metric == "cosine":
        norms = [np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12) for x in (queries, rows)]
        score = score / norms[0][:, None] / norms[1]
    elif metric == "l2":
        gap = (queries * queries).sum(axis=1)[:, None] + (rows * rows).sum(axis=1) - 2 * score
        score = 1 / (1 + np.maximum(gap, 0))
    return np.round(score, 6)


def best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of each query's k highest scores and of all that tie with the last of them."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        return np.nonzero(score >= least[:, None])
    return np.nonzero(np.isfinite(score))


class Kept:
    """The k best of each query, and of each kind of rows in it, over the batches of a task."""

    def __init__(self, k: int):
        self.k, self.tables, self.size = k, [], 0

    def add(self, queries: pa.Array, keys: pa.Array, kinds: pa.Array, scores: np.ndarray) -> None:
        self.tables.append(pa.table({"query_id": queries, "key": keys, "kind": kinds, "score": scores}))
        self.size += len(scores)
        if self.size > 1 << 18:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.tables:
            return None
        t = pa.concat_tables(self.tables)
        t = t.take(pc.sort_indices(t, [("query_id", "ascending"), ("kind", "ascending"), ("score", "descending"), ("key", "ascending")]))
        group = [t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("query_id", "kind")]
        new = np.ones(t.num_rows, bool)
        new[1:] = (group[0][1:] != group[0][:-1]) | (group[1][1:] != group[1][:-1])
        begin = np.flatnonzero(new)
        within = np.arange(t.num_rows) - np.repeat(begin, np.diff(np.append(begin, t.num_rows)))
        t = t.filter(pa.array(within < self.k))
        self.tables, self.size = [t], 0
        return t


def _scan(batches: Iterator[pa.RecordBatch], ids: pa.Array, asked: np.ndarray, metric: str, k: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, kind, vector) against the queries; the k best of each query and kind."""
    kept = Kept(k)
    for batch in batches:
        at, values = matrix(batch.column(2), asked.shape[1])
        if not len(at) or not len(asked):
            continue
        keys, kinds = batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))
        kind = kinds.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        step = max(1, SCORE_CELLS // len(values))
        for one in np.unique(kind):
            own = np.flatnonzero(kind == one)
            for first in range(0, len(asked), step):
                score = products(values[own], asked[first : first + step], metric)
                q, row = best(score, k)
                kept.add(ids.take(pa.array(q + first)), keys.take(pa.array(own[row])), kinds.take(pa.array(own[row])), score[q, row])
    found = kept.cut()
    if found is not None:
        yield from found.to_batches()


def in_pieces(rows: DataFrame, asked: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], out: str) -> DataFrame:
    """What ``meet`` makes of each piece of the rows (key and more) and each block of about QUERY_LIMIT queries (query_id and more)."""
    blocks = -(-asked.count() // QUERY_LIMIT)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("piece", every(PIECES))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("key"), F.lit(PIECES)).cast("int")).withColumn("block", every(blocks))
    return rows.groupBy("block", "piece").cogroup(asked.groupBy("block", "piece")).applyInArrow(meet, out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str, key: str, vector: str, kind: str | None = None) -> DataFrame:
    """query_id, key, kind, score: every query against every vector; the k best of each query and kind, and no more than k a task.

    The query set is fetched once, up to QUERY_LIMIT rows; such a set goes to all tasks and the vectors are read where
    they are. A larger one is dealt in blocks, which meet pieces of the vectors by shuffle. Vectors that are null, of another width
    than the queries or not finite are nobody's neighbours.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), (F.col(kind) if kind else F.lit(0)).alias("kind"), F.col(vector).alias("vector"))
    asked = queries.select("query_id", "query_vector")
    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    out = f"query_id {types['query_id']}, key {types['key']}, kind {types['kind']}, score double"
    held = asked.limit(QUERY_LIMIT + 1).toArrow()
    if held.num_rows <= QUERY_LIMIT:
        at, values = matrix(held["query_vector"])
        sent = spark.sparkContext.broadcast((held["query_id"].combine_chunks().take(pa.array(at)), values))
        found = rows.mapInArrow(lambda batches: _scan(batches, *sent.value, metric, k), out)
    else:

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            at, values = matrix(right["query_vector"])
            ids = right["query_id"].combine_chunks().take(pa.array(at))
            batches = left.select(["key", "kind", "vector"]).to_batches(max_chunksize=10_000)
            found = list(_scan(iter(batches), ids, values, metric, k))
            empty = pa.schema([("query_id", ids.type), ("key", left.schema.field("key").type), ("kind", left.schema.field("kind").type), ("score", pa.float64())])
            return pa.Table.from_batches(found) if found else empty.empty_table()

        found = in_pieces(rows, asked, meet, out)
    return found


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, key, score, rank: the k most similar vectors of each (query_id, query_vector), exact.

    ``where`` is applied before the search. Scores (dot, cosine, or l2 as 1 / (1 + squared distance)) have six places; equal
    ones go by key. Vectors that are null, of another width or not finite aren't found.
    """
    found = nearest(vectors if where is None else vectors.where(where), queries, k, metric, key, vector)
    return top(found.select("query_id", F.col("key").alias(key), "score"), "query_id", "score", key, k)


def recall(vectors: DataFrame, queries: DataFrame, kind: str, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the k nearest memories of each kind by 1 / (1 + squared distance), and of those the best k."""
    found = nearest(vectors, queries, k, "l2", key, vector, kind)
    of_kind = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "key")
    per = found.withColumn("_i", F.row_number().over(of_kind)).where(F.col("_i") <= k)
    return top(per.select("query_id", F.col("key").alias(key), "score"), "query_id", "score", key, k)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of Lloyd's rounds; a centre that has lost its rows starts again at the row farthest from its own."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        gaps = (centres * centres).sum(axis=1) - 2 * (x @ centres.T)
        own = gaps.argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        far = np.argsort(-gaps[np.arange(len(x)), own])[: int((n == 0).sum())]
        centres[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


#: Below any score of a row that is looked at.
LOWEST = -1e300


@dataclass
class Quantiser:
    """Cells of unit vectors, codes of what is left in each cell, and how far a query has to look."""

    centres: np.ndarray  # (cell, width)
    books: list[np.ndarray]  # of each part of the width: (code, columns)
    bounds: np.ndarray  # columns where parts begin and end
    probes: int  # nearest cells that hold the target share of the sample's true neighbours
    refine: float  # share of rows, in order of code scores, that holds it
    sample: tuple[np.ndarray, np.ndarray]  # cells and codes of the rows it was fitted on

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T).argmax(axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest, out = x - self.centres[cell], np.empty((len(x), len(self.books)), np.uint8)
        for i, book in enumerate(self.books):
            part = rest[:, self.bounds[i] : self.bounds[i + 1]]
            out[:, i] = ((book * book).sum(axis=1) - 2 * (part @ book.T)).argmin(axis=1)
        return out

    def scores(self, queries: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of the queries with the coded rows: with their cells' centres and with each part's entry, looked up."""
        out = (queries @ self.centres.T)[:, cell]
        for i, book in enumerate(self.books):
            out += (queries[:, self.bounds[i] : self.bounds[i + 1]] @ book.T)[:, codes[:, i]]
        return out

    def probed(self, queries: np.ndarray) -> np.ndarray:
        """(query, cell): whether the query looks into the cell."""
        order = np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order[:, : self.probes], True, axis=1)
        return out

    def looked_up(self, queries: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """scores() as (row, query), a row of each table at a time; -inf in cells that the query doesn't look into."""
        out = np.where(self.probed(queries).T, self.centres @ queries.T, -np.inf)[cell]
        for i, book in enumerate(self.books):
            out += (book @ queries[:, self.bounds[i] : self.bounds[i + 1]].T)[codes[:, i]]
        return out

    def least(self, queries: np.ndarray, k: int) -> np.ndarray:
        """The code score from which a row is scored exactly: what ``refine`` of the sample's rows reach in the query's cells, 4 * k at least."""
        cell, codes = self.sample
        rank, out = max(4 * k, int(np.ceil(self.refine * len(cell)))), np.full(len(queries), LOWEST)
        step = max(1, SCORE_CELLS // max(1, len(cell)))
        for first in range(0, len(queries) if len(cell) > rank else 0, step):
            score = self.looked_up(queries[first : first + step], cell, codes)
            out[first : first + step] = np.partition(score, len(cell) - rank, axis=0)[len(cell) - rank] - 5e-7
        return np.maximum(out, LOWEST)


def fit_quantiser(vectors: DataFrame, k: int = 5, target: float = 0.97, cells: int | None = None, parts: int = 16, vector: str = "embedding", most: int = FIT_ROWS, seed: int = 11) -> Quantiser:
    """A quantiser of unit vectors from a sample of at most ``most`` rows, the first by a hash of the vector.

    How many cells to look into, and how many rows to score exactly, is measured on the sample: as few as hold the ``target``
    share of the true k neighbours of 200 of its rows.
    """
    sample = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(most).toArrow()
    x = _unit(matrix(sample[vector])[1])
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    bounds = np.linspace(0, width, min(parts, max(1, width)) + 1).astype(int)
    if not len(x):
        return Quantiser(np.zeros((1, width)), [np.zeros((1, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], bounds, 1, 1.0, (np.zeros(0, np.int64), np.zeros((0, len(bounds) - 1), np.uint8)))
    centres = k_means(x, cells or max(1, round(len(x) ** 0.5 / 2)), 12, rng)
    own = (x @ centres.T).argmax(axis=1)
    rest = x - centres[own]
    books = [k_means(rest[:, a:b], 256, 8, rng) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    q = Quantiser(centres, books, bounds, len(centres), 1.0, (own, np.zeros(0, np.uint8)))
    q.sample = own, q.codes(x, own)
    some = rng.choice(len(x), min(200, len(x)), replace=False)
    true = np.argsort(-(x[some] @ x.T), axis=1, kind="stable")[:, : k + 1]
    near = np.argsort(np.argsort(-(x[some] @ centres.T), axis=1, kind="stable"), axis=1)
    q.probes = int(np.quantile(np.take_along_axis(near, own[true], axis=1), target, method="higher")) + 1
    coded = np.argsort(np.argsort(-q.scores(x[some], *q.sample), axis=1, kind="stable"), axis=1)
    q.refine = min(1.0, (float(np.quantile(np.take_along_axis(coded, true, axis=1), target, method="higher")) + 1) / len(x))
    return q


def coded_vectors(vectors: DataFrame, quantiser: Quantiser, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cell, code of every whole vector: a byte for each part. Written by cell, a search reads only the cells it looks into."""
    sent = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            at, values = matrix(batch.column(1), q.centres.shape[1])
            x = _unit(values)
            cell = q.cells(x)
            raw = q.codes(x, cell)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in raw], pa.binary())], names=[key, "cell", "code"])

    return vectors.select(key, vector).mapInArrow(code, f"{key} {vectors.schema[key].dataType.simpleString()}, cell int, code binary")


def _refined(batches: Iterator[pa.RecordBatch], q: Quantiser, ids: pa.Array, asked: np.ndarray, least: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Batches (key, vector, and cell and code where they have been written) against unit queries; the k best of each query."""
    kept, floor = Kept(k), np.full(len(asked), -np.inf)  # a row below a query's k-th so far isn't kept
    for batch in batches:
        at, values = matrix(batch.column(1), q.centres.shape[1])
        if not len(at) or not len(asked):
            continue
        keys, x = batch.column(0).take(pa.array(at)), _unit(values)
        if batch.num_columns > 2:
            cell = batch.column(2).take(pa.array(at)).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        else:
            cell = q.cells(x)
            codes = q.codes(x, cell)
        step = max(1, min(1024, SCORE_CELLS // len(x)))
        for first in range(0, len(asked), step):
            rows, some = np.nonzero(q.looked_up(asked[first : first + step], cell, codes) >= least[first : first + step])
            some += first
            for i in range(0, len(rows), PAIRS):
                row, a = rows[i : i + PAIRS], some[i : i + PAIRS]
                found = np.round((x[row] * asked[a]).sum(axis=1), 6)
                good = found >= floor[a]
                row, a = row[good], a[good]
                kept.add(ids.take(pa.array(a)), keys.take(pa.array(row)), pa.array(a), found[good])
                if kept.size > max(PAIRS, 4 * k * len(asked)):
                    t = kept.cut()
                    of, score = t["kind"].to_numpy(), t["score"].to_numpy()
                    floor = np.full(len(asked), np.inf)
                    np.minimum.at(floor, of, score)
                    floor[np.bincount(of, minlength=len(asked)) < k] = -np.inf
    found = kept.cut()
    if found is not None:
        yield from found.drop_columns(["kind"]).to_batches()


def approximate_search(vectors: DataFrame, queries: DataFrame, k: int = 5, target: float = 0.97, key: str = "vec_id", vector: str = "embedding", quantiser: Quantiser | None = None, coded: DataFrame | None = None) -> DataFrame:
    """query_id, key, score, rank by cosine, exact scores of few rows.

    A coarse quantiser fitted on a bounded sample gives all vectors a cell and a code of some bytes. A query
    looks into its nearest cells, adds up looked-up products of the codes there, and scores exactly only the best by
    codes. How many cells and rows that are is measured on the sample for the ``target`` recall; from which code score on a row is
    among the best is read off the sample for each query. So a task scores its rows where they are and keeps k of each query.
    ``coded`` is the table of coded_vectors() where it has been written before. Up to QUERY_LIMIT queries go to all tasks, more are dealt
    in blocks that meet pieces of the vectors. Null, wrong and infinite vectors aren't found.
    """
    spark = vectors.sparkSession
    quantiser = quantiser or fit_quantiser(vectors, k, target, vector=vector)
    sent, width = spark.sparkContext.broadcast(quantiser), quantiser.centres.shape[1]
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    if coded is not None:
        rows = rows.join(coded.select(F.col(key).alias("key"), "cell", "code"), "key").select("key", "vector", "cell", "code")
    asked = queries.select("query_id", "query_vector")
    if not width:  # no row to be near to
        asked = asked.limit(0)

    def with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns], pa.array(sent.value.least(_unit(values), k))], names=[*batch.schema.names, "least"])

    types = {f.name: f.dataType.simpleString() for f in [*rows.schema, *asked.schema]}
    asked = settled(asked.mapInArrow(with_least, f"query_id {types['query_id']}, query_vector {types['query_vector']}, least double"))
    out = f"query_id {types['query_id']}, key {types['key']}, score double"

    def whole(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        at, values = matrix(table["query_vector"], width)
        return table["query_id"].combine_chunks().take(pa.array(at)), _unit(values), table["least"].to_numpy()[at]

    held = asked.limit(QUERY_LIMIT + 1).toArrow()
    if held.num_rows <= QUERY_LIMIT:
        few = spark.sparkContext.broadcast(whole(held))
        found = rows.mapInArrow(lambda batches: _refined(batches, sent.value, *few.value, k), out)
    else:
        columns = rows.columns

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = list(_refined(iter(left.select(columns).to_batches(max_chunksize=10_000)), sent.value, *whole(right), k))
            empty = pa.schema([("query_id", right.schema.field("query_id").type), ("key", left.schema.field("key").type), ("score", pa.float64())])
            return pa.Table.from_batches(found) if found else empty.empty_table()

        found = in_pieces(rows, asked, meet, out)
    return top(found.select("query_id", F.col("key").alias(key), "score"), "query_id", "score", key, k)
