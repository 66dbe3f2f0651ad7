"""Log-probabilities of texts by logistic mixing of hashed-context bit predictors, on exact word counts of the corpus.

A word is spelled bit by bit, a space after its last byte. Several predictors look at the last 1, 2, 3, 4 and 6 bytes of the
word; each context and bit place is hashed to a slot that counts zeros and ones over the distinct training words. Their log-odds
are added with weights from two sets, one gated by the longest context seen before, one by the bit's place; an adaptive map
from the mixed log-odds to the rate of ones refines the result. Weights and map are learned online, word after word in
blocks of the vocabulary, every count without the word itself, and averaged over the blocks.

In a text, a word's probability mixes its discounted share of all training tokens, which backs off to its spelling, the spelling
alone, and what the text itself has said so far; these three weights adapt from token to token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.kernels import U, Words, blocks, column, distinct, grams, mix, parts

CHUNK = 16 << 20  #: bytes of text whose words are counted together
BLOCK_WORDS = 100_000  #: distinct words that weights are learned from one after the other
ORDERS = (1, 2, 3, 4, 6)  #: bytes of the contexts
SLOT_BITS = 21  #: all contexts share 2 ** SLOT_BITS slots, two counts each: 16 MB, whatever the corpus
BLOCKS = 64  #: pieces that slot counts are added up in
PLACES = 1 << 16  #: chunks of a word that stand in one row
TOKENS = 1 << 18  #: tokens scored at once; a longer text by itself
SYMBOLS = 4096  #: bytes spelled at once; weights move after each lot
RATE = 0.6  #: of the weights' moves, on the mean gradient of a lot
SMALL = 0.4  #: added to the counts of a slot
CELLS, STEP = 33, 0.5  #: of the refining map, over log-odds from -8 to 8
HELD = 4.0  #: observations that a cell of the map begins with
DISCOUNT = 0.75  #: taken off the count of each word for those not seen
SHARES = (0.8, 0.15, 0.05)  #: of the corpus, the text so far and the spelling, when a text begins
STRENGTH = 20.0  #: tokens that these shares count for
_SALT = [U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(len(ORDERS))]
_SETS = len(ORDERS) + 1, 8
_INPUTS = len(ORDERS) + 1  # and a constant
_K = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


@dataclass
class Mixer:
    """Weights of both sets and the refining map's rates of ones."""

    by_order: np.ndarray
    by_place: np.ndarray
    refined: np.ndarray

    @classmethod
    def fresh(cls, contexts: int = len(ORDERS)) -> Mixer:
        start = np.append(np.full(contexts, 0.35), 0.0)
        return cls(np.tile(start, (contexts + 1, 1)), np.tile(start, (_SETS[1], 1)), cls.rates(np.zeros((2, contexts + 1, CELLS))))

    @classmethod
    def averaged(cls, rows: DataFrame, contexts: int = len(ORDERS)) -> Mixer:
        """From rows of flat(), whose places are added up."""
        rows = rows.groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if not rows.num_rows:
            return cls.fresh(contexts)
        flat = rows["x"].to_numpy()[np.argsort(rows["at"].to_numpy())]
        if not flat[-1]:
            return cls.fresh(contexts)
        a, b = (contexts + 1) ** 2, _SETS[1] * (contexts + 1)
        seen = flat[a + b : -1].reshape(2, contexts + 1, CELLS)
        return cls((flat[:a] / flat[-1]).reshape(contexts + 1, -1), (flat[a : a + b] / flat[-1]).reshape(_SETS[1], -1), cls.rates(seen))

    def flat(self, seen: np.ndarray, bits: float) -> np.ndarray:
        return np.concatenate([self.by_order.ravel() * bits, self.by_place.ravel() * bits, seen.ravel(), [bits]])

    @staticmethod
    def rates(seen: np.ndarray) -> np.ndarray:
        """From (ones, all) of each cell; few observations leave a cell near its own log-odds."""
        own = 1 / (1 + np.exp(-(np.arange(CELLS) - CELLS // 2) * STEP))
        return (seen[0] + HELD * own) / (seen[1] + HELD)


def spelled(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, slot by context, bit) of every bit of the words and the spaces after them, in lots; eight bits a row."""
    data = np.frombuffer(b" " * 8 + b" ".join([*words, b""]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(sizes) - sizes
    before = grams(data)
    seen = np.arange(8, dtype=np.uint64)
    for lot in range(0, int(sizes.sum()), SYMBOLS):
        at = np.arange(lot, min(lot + SYMBOLS, int(sizes.sum())))
        word = np.searchsorted(start, at, "right") - 1
        depth = at - start[word]
        symbol = data[at + 8].astype(U)[:, None]
        node = (symbol | U(256)) >> (U(8) - seen)
        slots = np.empty((len(ORDERS), len(at), 8), np.int64)
        for i, order in enumerate(ORDERS):
            n = np.minimum(order, depth)
            context = np.where(n > 0, before[at] >> (U(8) * (U(8) - np.maximum(n, 1).astype(U))), U(0))
            hashed = mix(context + _SALT[i] + n.astype(U) * _K[1])[:, None]
            slots[i] = ((hashed + node * _K[0]) * _K[1]) >> U(64 - SLOT_BITS)
        yield word, slots, (symbol >> (U(7) - seen)) & U(1)


def odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of every slot as it is, without one zero and without one one; not a number where nothing is left."""
    out = np.empty((3, counts.shape[1]), np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i, (zero, one) in enumerate(((0, 0), (1, 0), (0, 1))):
            n0, n1 = np.maximum(counts[0] - zero, 0), np.maximum(counts[1] - one, 0)
            out[i] = np.where(n0 + n1 > 0, np.log((n1 + SMALL) / (n0 + SMALL)), np.nan)
    return out


def _inputs(table: np.ndarray, slots: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer and the longest order seen; ``table`` is odds(), ``bit``: without one observation of this bit."""
    inputs = np.empty((_INPUTS, *slots.shape[1:]), np.float32)
    place = slots if bit is None else slots + ((bit.astype(np.int64) + 1) << SLOT_BITS)
    inputs[:-1] = table.ravel()[place]
    inputs[-1] = 1
    longest = np.zeros(slots.shape[1:], np.int64)
    for i in range(len(ORDERS)):
        none = np.isnan(inputs[i])
        longest[~none] = i + 1
        inputs[i][none] = 0
    return inputs, longest


def _mixed(m: Mixer, inputs: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = inputs.reshape(_INPUTS, -1)
    by_order = np.take_along_axis(m.by_order.astype(np.float32) @ flat, longest.reshape(1, -1), axis=0).reshape(longest.shape)
    by_place = np.einsum("bi,isb->sb", m.by_place.astype(np.float32), inputs)
    return by_order, by_place, np.clip((by_order + by_place) / 2, -8, 8)


def _squash(x: np.ndarray) -> np.ndarray:
    x = np.exp(-x)
    x += 1
    return np.reciprocal(x, out=x)


def _ones(m: Mixer, both: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Probability of a one: the mixed log-odds and what the map makes of them, half each."""
    part = both / STEP + CELLS // 2
    cell = np.minimum(part.astype(np.int64), CELLS - 2)
    part -= cell
    cell += longest * CELLS
    one = m.refined.ravel().take(cell)
    cell += 1
    one += (m.refined.ravel().take(cell) - one) * part
    one += _squash(both)
    one /= 2
    return np.clip(one, 1e-6, 1 - 1e-6, out=one)


def learn(words: list[bytes], table: np.ndarray) -> tuple[Mixer, np.ndarray, int]:
    """A mixer after these words, what its map has seen (ones, all), and how many bits it has seen; ``table`` is odds()."""
    m, seen, bits = Mixer.fresh(), np.zeros((2, _SETS[0], CELLS)), 0
    for _, slots, bit in spelled(words):
        inputs, longest = _inputs(table, slots, bit)
        a, b, both = _mixed(m, inputs, longest)
        bit = bit.astype(np.float32)
        cell = np.rint(both / STEP).astype(np.int64) + CELLS // 2
        flat = (longest * CELLS + cell).ravel()
        seen[0] += np.bincount(flat, bit.ravel(), _SETS[0] * CELLS).reshape(_SETS[0], CELLS)
        seen[1] += np.bincount(flat, minlength=_SETS[0] * CELLS).reshape(_SETS[0], CELLS)
        off_a, off_b = bit - _squash(a), bit - _squash(b)
        own = (longest.ravel() == np.arange(_SETS[0])[:, None]).astype(np.float32)
        m.by_order += RATE * ((own * off_a.ravel()) @ inputs.reshape(_INPUTS, -1).T) / (own.sum(axis=1, keepdims=True) + 64)
        m.by_place += RATE * np.einsum("sb,isb->bi", off_b, inputs) / len(bit)
        bits += bit.size
    return m, seen, bits


def spell_scores(words: list[bytes], table: np.ndarray, m: Mixer) -> np.ndarray:
    """log10 of the probability of each word's spelling; ``table`` is odds()."""
    out = np.zeros(len(words))
    for word, slots, bit in spelled(words):
        inputs, longest = _inputs(table[0], slots, None)
        one = _ones(m, _mixed(m, inputs, longest)[2].astype(float), longest)
        out += np.bincount(word, np.log10(np.where(bit > 0, one, 1 - one)).sum(axis=1), len(words))
    return out


def chunks(docs: DataFrame, more: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, kinds: str = "") -> DataFrame:
    """(chunk, words, times, text, ids, learned, sizes, bytes) of docs (doc_id, learn, text): the texts of a task in runs of about CHUNK bytes.

    words: the distinct ones, the first is empty and stands for the end of a text; times: their training tokens; text: their numbers.
    learned: whether a text is learned from;
    sizes and bytes: tokens of each text, and their bytes with one more for each. ``more`` adds columns of these ``kinds`` to a chunk.
    """
    more = more or (lambda chunk: chunk)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0

        def flush(ids: list, learned: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal made
            made += 1
            seen, hashes, starts, ends, counts, held = [], [], [], [], [], 0
            for _, raws in blocks(texts):  # what is held for every byte is held for one block
                w = Words(raws)
                hashes.append(w.hash)
                starts.append((w.start + held).astype(np.int32))
                ends.append((w.end + held).astype(np.int32))
                counts.append(w.count)
                seen.append(w.seen)
                held += len(w.seen)
            shown, number = distinct(np.concatenate(hashes))
            del hashes
            whole, start, end, count = map(np.concatenate, (seen, starts, ends, counts))
            size = end[shown] - start[shown]
            upto = np.concatenate(([0, 0], np.cumsum(size, dtype=np.int64))).astype(np.int32)  # the first word is empty
            at = np.repeat(start[shown] - upto[1:-1], size)
            at += np.arange(len(at), dtype=np.int32)
            words = pa.BinaryArray.from_buffers(pa.binary(), len(size) + 1, [None, pa.py_buffer(upto), pa.py_buffer(whole[at])])
            text = np.insert(number + np.int32(1), np.cumsum(count), 0)
            of = np.repeat(np.array(learned, bool), count + 1)
            times = np.bincount(text[of], minlength=len(words))
            packed = pa.compress(text.astype(np.int32).tobytes(), "zstd", asbytes=True)
            long = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
            upto = np.cumsum(count)
            columns = [[task + made], [times], [packed], [ids], [learned], [count + 1], [long[upto] - long[upto - count] + count + 1]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.list_(pa.int64())] * 2]
            columns = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
            columns.insert(1, pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words))
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "words", "times", "text", "ids", "learned", "sizes", "bytes"])

        ids, learned, texts, size = [], [], [], 0
        for batch in parts(batches):
            for i, yes, text in zip(*(column(batch, c) for c in ("doc_id", "learn", "text")), strict=True):
                texts.append(text)
                ids.append(i)
                learned.append(bool(yes))
                size += len(text or "") + 1
                if size >= CHUNK:
                    yield more(flush(ids, learned, texts))
                    ids, learned, texts, size = [], [], [], 0
        if texts:
            yield more(flush(ids, learned, texts))

    return docs.mapInArrow(count, ", ".join(["chunk long, words array<binary>, times array<long>, text binary, ids array<long>, learned array<boolean>, sizes array<long>, bytes array<long>", *filter(None, [kinds])]))


def added_up(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], bits: int) -> np.ndarray:
    """(zeros, ones) of 2 ** bits slots. A task adds its batches to its counts and sends them in BLOCKS packed pieces, added up by piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 << bits, np.int64)
        for batch in batches:
            add(batch, seen)
        for i, piece in enumerate(seen.reshape(BLOCKS, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(piece.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["piece", "counts"])

    size = (2 << bits) // BLOCKS

    def total(pieces: pa.Table) -> pa.Table:
        whole = np.zeros(size, np.int64)
        for packed in pieces["counts"]:
            whole += np.frombuffer(pa.decompress(packed.as_py(), 8 * size, "zstd", asbytes=True), np.int64)
        return pa.table({"piece": pieces["piece"].slice(0, 1), "counts": pa.array([whole.tobytes()], pa.binary())})

    kind, counts = "piece int, counts binary", np.zeros((BLOCKS, size), np.float32)
    for row in rows.mapInArrow(count, kind).groupBy("piece").applyInArrow(total, kind).toArrow().to_pylist():
        counts[row["piece"]] = np.frombuffer(row["counts"], np.int64)
    return counts.reshape(2, -1)


def slot_counts(words: DataFrame) -> np.ndarray:
    """(zeros, ones) of every slot over the words."""

    def add(batch: pa.RecordBatch, seen: np.ndarray) -> None:
        for some in parts([batch], 20_000):
            for _, slots, bit in spelled(column(some, "word")):
                np.add.at(seen, (slots + (bit.astype(np.int64) << SLOT_BITS)).ravel(), 1)

    return added_up(words, add, SLOT_BITS)


def fit_mixer(words: DataFrame, n: int, table) -> Mixer:
    """Mixers of blocks of words, averaged by their bits; the blocks go by the words' hashes. ``table`` is a broadcast of odds()."""

    def run(block: pa.Table) -> pa.Table:
        m, seen, bits = learn(sorted(block["word"].to_pylist(), key=lambda w: (xxhash.xxh3_64_intdigest(w), w)), table.value)
        flat = m.flat(seen, bits)
        return pa.table({"at": np.arange(len(flat), dtype=np.int32), "x": flat})

    blocks = words.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(max(1, -(-n // BLOCK_WORDS)))))
    return Mixer.averaged(blocks.groupBy("block").applyInArrow(run, "at int, x double"))


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def base_scores(tokens: np.ndarray, sizes: np.ndarray, c: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
    """(known tokens, base score) of texts laid end to end; c by token number."""
    doc, own = np.repeat(np.arange(len(sizes)), sizes), c[tokens]
    base = np.log10((own + 0.5) / (n + 0.5 * (v + 1)))
    return np.bincount(doc, own > 0, len(sizes)).astype(np.int64), np.bincount(doc, base, len(sizes))


def text_scores(tokens: np.ndarray, sizes: np.ndarray, c: np.ndarray, spell: np.ndarray, n: int, v: int) -> tuple[np.ndarray, ...]:
    """(known tokens, base score, score) of texts laid end to end; c and spell (natural logarithm) by token number."""
    ends = np.cumsum(sizes)
    doc, first = np.repeat(np.arange(len(sizes)), sizes), np.repeat(ends - sizes, sizes)
    at = np.arange(len(tokens)) - first
    order = np.lexsort((at, tokens, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (tokens[order][1:] != tokens[order][:-1])
    begin = np.flatnonzero(new)
    earlier = np.empty(len(order))
    earlier[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))

    rest = DISCOUNT * v / n if n else 1.0
    by_corpus = np.logaddexp(_log(np.maximum(c - DISCOUNT, 0) / max(n, 1)), _log(np.array(rest)) + spell)[tokens]
    by_text = np.where(at > 0, _log(earlier / np.maximum(at, 1)), by_corpus)
    ways = np.stack([by_corpus, by_text, spell[tokens]])
    log_shares = np.log(np.array(SHARES))[:, None]
    joint = ways + log_shares
    total = np.logaddexp.reduce(joint, axis=0)
    took = np.exp(joint - total)
    upto = np.cumsum(took, axis=1) - took
    shares = (STRENGTH * np.array(SHARES)[:, None] + upto - upto[:, first]) / (STRENGTH + at)
    score = np.logaddexp.reduce(ways + _log(shares), axis=0) / np.log(10)
    return *base_scores(tokens, sizes, c, n, v), np.bincount(doc, score, len(sizes))


def chosen(docs: DataFrame, learn_col: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(learn_col).cast("boolean").alias("learn"), F.col(text_col).cast("string").alias("text"))


def word_counts(held: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(word, c, places) of all words of the chunks, (word, c), and how many shelves a word's places are dealt to."""
    shelves = -(-held.count() // PLACES)  # more than one only where a word may be in more than PLACES chunks
    words = held.select("chunk", F.posexplode(F.arrays_zip("words", "times")).alias("at", "x"))
    words = words.select(F.col("x.words").alias("word"), F.pmod(F.xxhash64("chunk"), F.lit(max(1, shelves))).alias("shelf"), F.struct("chunk", "at").alias("place"), F.col("x.times").alias("n"))
    types = materialize(words.groupBy("word", "shelf").agg(F.sum("n").alias("c"), F.collect_list("place").alias("places")))
    return types, types if shelves <= 1 else materialize(types.groupBy("word").agg(F.sum("c").alias("c"))), shelves


def training_size(counted: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct ones."""
    return tuple(counted.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first())


def unpacked(packed: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 4 * size, "zstd", asbytes=True), np.int32)


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts with ``most`` in all; a longer text by itself."""
    upto, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + most, "right")))
        yield first, last
        first = last


def score_texts(docs: DataFrame, learn_col: str = "learn", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Rows whose ``learn_col`` is true are learned from, all are scored. Tokens are A-Z lower-cased words between ASCII white
    space and one end. base_score adds up log10((c + 0.5) / (N + 0.5 (V + 1))) with the exact counts of the training tokens. score is
    the model's log10 probability of the tokens, bits_per_byte the same in bits over their bytes, one more for each token.

    A null or empty text is its end alone. Repeated rows are counted and scored each; null ids stay null and can be learned
    from if their ``learn_col`` says so; other columns are ignored; an empty table gives an empty result. Without training rows words are
    scored by a spelling of even bits. The word counts grow with the corpus and are joined to each chunk's distinct words;
    only the slots (a fixed size) and some hundred weights are sent to all tasks.
    """
    spark = docs.sparkSession
    held = materialize(chunks(chosen(docs, learn_col, id_col, text_col)))
    types, counted, shelves = word_counts(held)
    learned = counted.where("c > 0").select("word")
    n, v = training_size(counted)
    table = spark.sparkContext.broadcast(odds(slot_counts(learned)))
    mixer = spark.sparkContext.broadcast(fit_mixer(learned, v, table))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 20_000):
            found = spell_scores(column(batch, "word"), table.value, mixer.value) * np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "spell"])

    place = "places array<struct<chunk:bigint,at:int>>"
    if shelves <= 1:
        scored = types.select("c", "places", "word").mapInArrow(spell, f"c long, {place}, word binary, spell double")
    else:
        scored = types.select("word", "places").join(materialize(counted.select("word", "c").mapInArrow(spell, "word binary, c long, spell double")), "word")
    own = scored.select("c", F.col("spell").cast("float").alias("spell"), F.explode("places").alias("place")).select("place.chunk", "place.at", "c", "spell")

    def score(held: pa.Table, own: pa.Table) -> pa.Table:
        at = own["at"].to_numpy()
        c, spell = np.zeros(len(at), np.int64), np.zeros(len(at), np.float32)
        c[at], spell[at] = own["c"].to_numpy(), own["spell"].to_numpy()
        ids, sizes, n_bytes = (held[x].combine_chunks().flatten() for x in ("ids", "sizes", "bytes"))
        size = sizes.to_numpy()
        tokens, upto, rows = unpacked(held["text"][0].as_py(), int(size.sum())), np.cumsum(size), []
        for first, last in runs(size, TOKENS):
            known, base, found = text_scores(tokens[upto[first] - size[first] : upto[last - 1]], size[first:last], c, spell, n, v)
            rows.append((known, base, found, -found * np.log2(10) / n_bytes.to_numpy()[first:last]))
        known, base, found, bits = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.table({"doc_id": ids, "n_tokens": sizes, "n_known": known, "base_score": base, "score": found, "n_bytes": n_bytes, "bits_per_byte": bits})

    rows = held.select("chunk", "text", "ids", "sizes", "bytes").groupBy("chunk").cogroup(own.groupBy("chunk"))
    out = rows.applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))
