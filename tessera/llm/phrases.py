"""Phrases of two to five words that stand together more often than their parts do, by language.

Counts come from suffix subtrees cut off at five words. The suffixes of the corpus (the next five words at each place) are
partitioned vertically: by their first word, where more suffixes begin with it than the memory budget has room for by their
first two words, and so on; prefixes are packed into groups of about a budget. Each group's subtree is built by
itself in one task, and every node's count is the total of the leaves below it.

Only what can be counted often enough is carried: words below the least count become gaps, and a suffix ends at the first pair
below it. Both counts are exact and cover every text, so no phrase of the least count is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import BROADCAST_KEYS, materialize, numbered, table
from tessera.llm.kernels import LOWER, blocks, column, distinct, parts, range_hashes

LEAST = 100  #: occurrences of a candidate
TOP = 2000  #: phrases of each language
WORDS = 5  #: words of the longest phrase; the depth of the subtrees
CHUNK = 8 << 20  #: bytes of text whose words are counted together
LOCAL_WORDS = 200_000  #: frequent words that are sent to every task, some tens of bytes each
BUDGET = 1 << 18  #: suffixes of a subtree, 24 bytes each
W = tuple(f"w{i}" for i in range(1, WORDS + 1))
SUFFIX = ", ".join(f"{w} int" for w in W)
_ZSTD = "zstd"

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


def cut(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, and whether a piece begins with the word."""
    data = LOWER[np.frombuffer(b"\n".join([b"", *raws, b""]), np.uint8)]
    edge = np.diff((~_GAP[data]).astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[start]
    return data, start, end, np.diff(breaks, prepend=-1) > 0


def _local(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the text as numbers of words from 1, 0 between pieces."""
    seen, hashes, starts, ends, gaps, size = [], [], [], [], [], 0
    for _, raws in blocks(texts):  # what is held for every byte is held for one block
        data, start, end, first = cut(raws)
        hashes.append(range_hashes(data, start, end))
        starts.append((start + size).astype(np.int32))
        ends.append((end + size).astype(np.int32))
        gaps.append(first)
        seen.append(data.tobytes())
        size += len(data)
    shown, number = distinct(np.concatenate(hashes))
    del hashes
    times = np.bincount(number, minlength=len(shown))
    whole, start, end, first = b"".join(seen), *map(np.concatenate, (starts, ends, gaps))
    words = [whole[s:e] for s, e in zip(start[shown].tolist(), end[shown].tolist(), strict=True)]
    place = np.arange(len(start), dtype=np.int32) + np.cumsum(first, dtype=np.int32)
    text = np.zeros(len(start) + int(first.sum()) + 1, np.int32)
    text[place] = number + 1
    return words, times, text


def _packed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.astype(np.int32).tobytes(), _ZSTD, asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], 4 * n, _ZSTD, asbytes=True), np.int32)


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(chunk, lang, total, words, times, text): the texts of a task in runs of about CHUNK bytes, as numbers of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0

        def flush(held: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                words, times, text = _local(texts)
                made += 1
                columns = [[task + made], [lang], [int(times.sum())], [words], [times], [_packed(text)]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["chunk", "lang", "total", "words", "times", "text"])

        held, size = {}, 0
        for batch in parts(batches):
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text or "")
                if size >= CHUNK:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    picked = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(count, "chunk long, lang string, total long, words array<binary>, times array<long>, text binary")


def _few(df: DataFrame) -> DataFrame:
    """Narrow rows, counted: broadcast up to BROADCAST_KEYS, joined by shuffle beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _coded(text: bytes, to: np.ndarray) -> bytes:
    """A chunk's text with its words' numbers replaced by ``to``; of the gaps one is left after each run."""
    ids = to[_unpacked(text)]
    keep = ids > 0
    keep[1:] |= ids[:-1] > 0
    return _packed(ids[keep])


def coded(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk, text): the chunks' texts as ids of the frequent words, 0 for what lies between.

    Up to LOCAL_WORDS frequent words, which are counted first, go to all tasks; more are joined to the chunks that have them.
    """
    kind = "chunk long, text binary"
    if words.count() <= LOCAL_WORDS:
        sent = pieces.sparkSession.sparkContext.broadcast(words.select("lang", "word", "id").toArrow())

        def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, dict[bytes, int]] = {}
            for lang, word, i in zip(*(sent.value[c].to_pylist() for c in ("lang", "word", "id")), strict=True):
                known.setdefault(lang, {})[word] = i
            for batch in parts(batches, 1):
                own = known.get(column(batch, "lang")[0], {})
                to = np.array([0, *(own.get(w, 0) for w in column(batch, "words")[0])], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_coded(column(batch, "text")[0], to)], pa.binary())], names=["chunk", "text"])

        return pieces.select("chunk", "lang", "words", "text").mapInArrow(with_all, kind)

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            ids = batch.column(batch.schema.get_field_index("ids")).flatten()
            to = np.zeros(column(batch, "n")[0] + 1, np.int32)
            to[ids.field(0).to_numpy() + 1] = ids.field(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_coded(column(batch, "text")[0], to)], pa.binary())], names=["chunk", "text"])

    own = pieces.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    own = own.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    return pieces.select("chunk", F.size("words").alias("n"), "text").join(own, "chunk").mapInArrow(with_own, kind)


def _pairs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two words that follow one another, and both ids as one number."""
    at = np.flatnonzero((text[:-1] > 0) & (text[1:] > 0))
    return at, text[at].astype(np.int64) << 32 | text[at + 1]


def chunk_pairs(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            pair, n = np.unique(_pairs(_unpacked(column(batch, "text")[0]))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), column(batch, "chunk")[0])), pa.array(pair), pa.array(n)], names=["chunk", "pair", "n"])

    return texts.mapInArrow(count, "chunk long, pair long, n long")


def _chunk_suffixes(text: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct suffixes of three words and more of a chunk, and how often each occurs; ``known``: frequent pairs in order."""
    at, pair = _pairs(text)
    ok = np.zeros(len(text) + WORDS, bool)
    ok[at] = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair
    at = np.flatnonzero(ok[:-1] & ok[1:])
    rows = np.zeros((len(at), WORDS), np.int32)
    on = np.ones(len(at), bool)
    for i in range(WORDS):
        rows[on, i] = text[at[on] + i]
        on &= ok[at + i]
    order, new = _sorted(rows)
    begin = np.flatnonzero(new[:, -1])
    return rows[order[begin]], np.diff(np.append(begin, len(at)))


def suffixes(texts: DataFrame, pairs: DataFrame, often: DataFrame) -> DataFrame:
    """(w1 ... w5, n): the distinct suffixes of three words and more in each chunk, as far as frequent pairs reach; 0 after the end.

    The frequent pairs, counted first, go to all tasks up to BROADCAST_KEYS of them, eight bytes each; more are joined to the
    chunks that have them.
    """

    def rows(text: bytes, known: np.ndarray) -> pa.RecordBatch:
        words, n = _chunk_suffixes(_unpacked(text), known)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)), pa.array(n)], names=[*W, "n"])

    if often.count() <= BROADCAST_KEYS:
        sent = texts.sparkSession.sparkContext.broadcast(np.sort(often.select("pair").toArrow()["pair"].to_numpy()))

        def with_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts(batches, 1):
                if len(sent.value):
                    yield rows(column(batch, "text")[0], sent.value)

        return texts.mapInArrow(with_all, f"{SUFFIX}, n long")

    def with_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            own = batch.column(batch.schema.get_field_index("pairs")).flatten().to_numpy()
            yield rows(column(batch, "text")[0], np.sort(own))

    own = pairs.join(often.select("pair"), "pair").groupBy("chunk").agg(F.collect_list("pair").alias("pairs"))
    return texts.join(own, "chunk").mapInArrow(with_own, f"{SUFFIX}, n long")


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and for each of them and depth whether a node of that depth begins there."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    new = np.ones(rows.shape, bool)
    new[1:] = np.logical_or.accumulate(rows[1:] != rows[:-1], axis=1)
    return order, new


def subtree(rows: np.ndarray, n: np.ndarray, known: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, count) of a subtree's nodes of three words and more; ``known``: words of the prefix that each suffix was dealt by."""
    order, new = _sorted(rows)
    rows, n, known = rows[order], n[order], known[order]
    words, counts = [], []
    for depth in range(3, WORDS + 1):
        begin = np.flatnonzero(new[:, depth - 1])
        total = np.add.reduceat(n, begin) if len(begin) else n
        keep = (total >= least) & (rows[begin, depth - 1] > 0) & (known[begin] <= depth)
        node = rows[begin[keep]].copy()
        node[:, depth:] = 0
        words.append(node)
        counts.append(total[keep])
    return np.concatenate(words), np.concatenate(counts)


def tree_counts(rows: DataFrame, least: int, budget: int = BUDGET) -> DataFrame:
    """(w1 ... w5, n) of all phrases of three words and more with ``least`` occurrences."""
    rest, dealt, counted = rows, [], []
    for depth in range(1, WORDS + 1):
        prefix = list(W[:depth])
        sizes = materialize(rest.groupBy(*prefix).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")))
        fits = F.lit(True) if depth == WORDS else F.col("rows") <= budget
        total = sizes.where(fits).agg(F.sum("rows")).first()[0] or 0
        if total:
            shelf = F.pmod(F.xxhash64(*prefix), F.lit(max(1, total // (64 * budget))))
            upto = F.sum("rows").over(Window.partitionBy("shelf").orderBy(*prefix).rowsBetween(Window.unboundedPreceding, 0))
            groups = sizes.where(fits).withColumn("shelf", shelf).select(*prefix, "shelf", F.floor(upto / budget).alias("slot"))
            dealt.append(rest.join(_few(materialize(groups)), prefix).select(*W, "n", F.lit(depth).alias("known"), "shelf", "slot"))
        heavy = sizes.where(~fits)
        if heavy.isEmpty():
            break
        if depth >= 3:
            counted.append(heavy.where((F.col("n") >= least) & (F.col(prefix[-1]) > 0)).select(*prefix, *[F.lit(0).alias(w) for w in W[depth:]], "n"))
        rest = materialize(rest.join(_few(heavy.select(*prefix)), prefix, "left_semi"))
    if not dealt:
        return rows.select(*W, "n").limit(0)

    def build(group: pa.Table) -> pa.Table:
        words = np.stack([group[w].to_numpy() for w in W], axis=1)
        nodes, n = subtree(words, group["n"].to_numpy(), group["known"].to_numpy(), least)
        return pa.table({**{w: np.ascontiguousarray(nodes[:, i]) for i, w in enumerate(W)}, "n": n})

    found = dealt[0]
    for more in dealt[1:]:
        found = found.unionByName(more)
    found = found.groupBy("known", "shelf", "slot").applyInArrow(build, f"{SUFFIX}, n long")
    for more in counted:
        found = found.unionByName(more)
    return found


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts are split into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A
    phrase of two to five words within a piece is a candidate with ``least`` occurrences or more, overlaps included. Of all
    places to cut it in two, the one with the lowest floor(1000 * a * n / (l * r)) is its score, the first of equal ones. A
    candidate that always stands inside a longer one is left out. Order: score and a descending, then the phrase's bytes.

    A null language is ``und``; a null or empty text has no words. Repeated rows are counted each. Ids aren't read, other
    columns are ignored, and an empty table gives an empty result. Arithmetic is exact for up to 10**17 words a language.
    """
    pieces = materialize(chunks(docs, lang_col, text_col))
    n = pieces.groupBy("lang").agg(F.sum("total").alias("n"))
    words = pieces.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).select("lang", "x.words", "x.times")
    words = words.groupBy("lang", F.col("words").alias("word")).agg(F.sum("times").alias("n")).where(F.col("n") >= least)
    words = numbered(words.withColumn("all", F.lit("all")), "all", ["lang", "word"])
    words = materialize(words.select("lang", "word", "n", (F.col("pos") + 1).cast("int").alias("id")))
    if words.count() >= 1 << 31:
        raise ValueError("more frequent words than 31 bits can number")
    texts = materialize(coded(pieces, words))
    pairs = chunk_pairs(texts)
    often = materialize(pairs.groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    longer = tree_counts(materialize(suffixes(texts, pairs, often)), least, budget)
    two = often.select(F.array(F.shiftright("pair", 32).cast("int"), F.col("pair").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("p"), "n")
    longer = longer.select(F.filter(F.array(*W), lambda w: w > 0).alias("p"), "n")
    found = materialize(two.unionByName(longer).select(F.col("p").cast("array<int>").alias("p"), F.col("n").alias("a")))

    inner = found.where(F.size("p") > 2)
    inner = inner.select(F.slice("p", F.lit(1), F.size("p") - 1).alias("p"), "a").unionByName(inner.select(F.slice("p", F.lit(2), F.size("p") - 1).alias("p"), "a"))
    inner = inner.groupBy("p").agg(F.max("a").alias("most"))
    kept = found.join(inner, "p", "left").where("most is null or most < a").select("p", "a")
    named = kept.select("p", "a", F.posexplode("p").alias("at", "id")).join(_few(words.select("id", "lang", "word")), "id")
    named = named.groupBy("p", "a").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = named.join(n, "lang").withColumn("phrase", F.concat_ws(" ", F.transform("words", lambda x: F.decode(x.word, "UTF-8"))))
    f = words.select(F.array("id").alias("part"), F.col("n").alias("f")).unionByName(found.select(F.col("p").alias("part"), F.col("a").alias("f")))
    f = _few(materialize(f.withColumn("part", F.col("part").cast("array<int>"))))
    cuts = named.select("lang", "phrase", "a", "n", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.join(f.select(F.col("part").alias("left"), F.col("f").alias("l")), F.slice("p", F.lit(1), F.col("k")) == F.col("left"))
    cuts = cuts.join(f.select(F.col("part").alias("right"), F.col("f").alias("r")), F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")) == F.col("right"))
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (_exact("a") * _exact("n"))).withColumn("under", _exact("l") * _exact("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) AS s(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 100),
x AS (
  SELECT c.lang, c.phrase, c.a, n.n, j, l.f AS l, r.f AS r, (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM c JOIN n USING (lang), range(1, 5) AS s(j), f AS l, f AS r
  WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:j], ' ') AND r.phrase = array_to_string(c.w[j + 1 : c.k], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (
  SELECT lang, array_to_string(w[o : o + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS o FROM c, range(2, 5) AS s(m) WHERE m < k) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o WHERE rank <= 2000
"""
