"""Log-probabilities of whole texts by logistic mixing of hashed-context bit predictors that run on across words.

A text is its lower-cased words with a space after each, and one more space for its end. Every byte is spelled bit by bit, and each
bit's probability comes from the mixer alone. Predictors look at the last 1, 2, 3, 4 and 6 bytes, whatever words they belong to, and
at the word so far (its last six bytes at most); each context and bit place is hashed to a slot that counts the zeros and ones
of all training texts, every occurrence. Their log-odds are added with weights from two sets, one gated by the longest context seen before, one by
the bit's place; an adaptive map from the mixed log-odds to the rate of ones refines the result. Weights and map are learned online over all
training bytes, each without its own observation, chunk by chunk, and averaged over the chunks.

A byte's probability depends on itself and the six before it, so equal runs of seven bytes are counted, learned and scored together,
by their occurrences. The distinct runs of a chunk are found once and stored with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table
from tessera.llm.kernels import U, column, grams, mix
from tessera.llm.language_id import remainder
from tessera.llm.lm_scoring import CELLS, STEP, Mixer, _ones, _squash, added_up, base_scores, chosen, chunks, odds, runs, training_size, unpacked, word_counts

ORDERS = (1, 2, 3, 4, 6)  #: bytes of the contexts; the last context is the word so far
CONTEXTS = len(ORDERS) + 1
PAST = 6  #: bytes before a byte that its contexts can hold
SLOT_BITS = 22  #: all contexts share 2 ** SLOT_BITS slots, two counts each: 32 MB, whatever the corpus
SORTED = 1 << 22  #: bytes whose runs are sorted at once, or a piece
PIECE = 1 << 20  #: bytes of text whose runs are laid out at once; a longer text by itself
TEXTS = 256  #: texts in a piece at most: a run of seven bytes and the number of its text are one number
MOST = 8.0  #: of a slot's log-odds, either way
RATE = 0.5  #: of the weights' moves, on the gradient of a lot over the sum of its curvatures, so that they can't run away
FEW = 0.05  #: added to that sum, of a lot's mean
LOT = 1 << 14  #: different runs whose bits are predicted at once; weights move after each lot
RUNS, RUN_KINDS = ["runs", "run_keys", "run_times"], "runs long, run_keys binary, run_times binary"
_SALT = [U((i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(CONTEXTS)]
_K = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_PLACE = np.arange(8)[:, None]
_BITS = (np.arange(256) >> (7 - _PLACE)) & 1  #: by bit and byte
_NODE = (1 << _PLACE % 4) | np.where(_PLACE < 4, np.arange(256) >> 4, np.arange(256) & 15) >> 4 - _PLACE % 4  #: its place among the slots of its half byte
_COUNT = _NODE + (_BITS << SLOT_BITS)  #: the same among the counts of that bit
_WITHOUT = _NODE + ((_BITS + 1) << SLOT_BITS)  #: and among the odds() without that bit


def spell_out(words: list[bytes] | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with a space after each, then the spaces before a text; where each begins; their sizes."""
    words = pa.array(words, pa.binary()) if isinstance(words, list) else words
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_buffer()
    flat = np.concatenate((np.frombuffer(joined, np.uint8), np.full(PAST + 1, 0x20, np.uint8)))
    sizes = np.append(pc.binary_length(words).to_numpy().astype(np.int64) + 1, PAST)
    return flat, np.cumsum(sizes) - sizes, sizes


def runs_of_bytes(spelled: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every byte of the texts (tokens end to end): it and the six before it, spaces where the text begins; and its text."""
    flat, begin, long = spelled
    before = len(long) - 1
    seq = np.insert(tokens, np.cumsum(sizes) - sizes, before)
    size = long[seq]
    at = np.repeat((begin[seq] - (np.cumsum(size) - size)).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    data = flat[at]
    del at
    own = np.repeat(seq != before, size)[PAST:]
    keys = grams(data)[: len(own)]
    keys &= U((1 << 56) - 1)
    return keys[own], np.repeat(np.arange(len(sizes), dtype=np.int32), np.add.reduceat(long[tokens], np.cumsum(sizes) - sizes) if len(sizes) else 0)


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(keys, kind="stable")  # quick, as both are in order
    keys, times = keys[order], times[order]
    del order
    first = heads(keys)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def distinct_runs(some: Iterator[tuple[np.ndarray, np.ndarray]], learned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the pieces in order, and how often each stands there; merged as they come, like with like.

    ``learned``: by text, only those with a one add to how often, so keys may stand there 0 times.
    """
    held, texts, some = [], 0, iter(some)
    while lot := list(_lot(some)):
        if learned is not None:
            for keys, doc in lot:
                keys <<= U(1)
                keys |= learned.take(texts + doc)
                texts += int(doc[-1]) + 1
        keys = np.concatenate([keys for keys, _ in lot]) if len(lot) > 1 else lot[0][0]
        del lot
        keys.sort()
        if learned is None:
            first = heads(keys)
            found = keys[first], np.diff(first, append=len(keys)).astype(np.int32)
        else:
            ones = (keys & U(1)).astype(np.int32)
            keys >>= U(1)
            first = heads(keys)
            found = keys[first], np.add.reduceat(ones, first)
        while held and len(held[-1][0]) < 2 * len(found[0]):
            found = _merged(held.pop(), found)
        held.append(found)
    while len(held) > 1:
        held.append(_merged(held.pop(), held.pop()))
    return (held[0][0], held[0][1].astype(np.int64)) if held else (np.empty(0, U), np.empty(0, np.int64))


def _lot(some: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The next pieces, about SORTED bytes of them."""
    size = 0
    while size < SORTED and (piece := next(some, None)) is not None:
        size += len(piece[0])
        yield piece


class Places:
    """Where distinct keys stand, by tables of their hashes: of keys that share a place the last is there, the others go to the next table."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            table = np.zeros(2 << len(left).bit_length(), np.int32)
            own = self._hashed(keys[left], len(self.tables), len(table))
            table[own] = left
            self.tables.append(table)
            left = left[table[own] != left]

    @staticmethod
    def _hashed(keys: np.ndarray, nth: int, size: int) -> np.ndarray:
        return (keys * U((2 * nth + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> U(65 - size.bit_length())).view(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The places of keys that are all there."""
        out, rest = np.zeros(len(wanted), np.int32), None
        for nth, table in enumerate(self.tables):
            some = wanted if rest is None else wanted[rest]
            got = table.take(self._hashed(some, nth, len(table)))
            missed = np.flatnonzero(self.keys.take(got) != some)
            if rest is None:
                out, rest = got, missed
            else:
                out[rest] = got
                rest = rest[missed]
            if not len(rest):
                break
        return out


def slots_of(keys: np.ndarray, nodes: np.ndarray = _NODE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By context: the first of each group of keys (in order) with the same context and byte, and a row of slots for each of the byte's bits.

    The slots of half a byte stand together, so that they are read at once.
    """
    space = keys.view(np.uint8).reshape(-1, 8)[:, PAST - 1 :: -1] == 0x20
    depth = np.where(space.any(axis=1), space.argmax(axis=1), PAST).astype(U)
    for i in range(CONTEXTS):
        size = np.full(len(keys), ORDERS[i], U) if i < len(ORDERS) else depth
        part = keys >> (U(48) - U(8) * size)  # the byte and its context
        new = np.ones(len(keys), bool)
        new[1:] = (part[1:] != part[:-1]) | (size[1:] != size[:-1])
        head = np.flatnonzero(new)
        context = part[head] & ((U(1) << (U(8) * size[head])) - U(1))
        hashed = mix(context + _SALT[i] + size[head] * _K[1])
        byte = keys[head] >> U(48)
        rows = np.stack([hashed, hashed + ((byte >> U(4)) + U(16)) * _K[0]]) * _K[1]
        rows >>= U(68 - SLOT_BITS)
        rows <<= U(4)
        slots = nodes.take(byte.view(np.int64), axis=1)
        slots.reshape(2, 4, -1)[:] += rows.view(np.int64)[:, None]
        yield head, slots


def bits_of(keys: np.ndarray) -> np.ndarray:
    return _BITS.take((keys >> U(48)).astype(np.int64), axis=1)


def count_runs(keys: np.ndarray, times: np.ndarray, seen: np.ndarray) -> None:
    """Adds the bits of the keys (in order) to the counts (zeros, then ones) of their slots."""
    for lot in range(0, len(keys), LOT):
        some, n = keys[lot : lot + LOT], times[lot : lot + LOT]
        for head, slots in slots_of(some, _COUNT):
            np.add.at(seen, slots.ravel(), np.tile(np.add.reduceat(n, head), 8))


def _inputs(keys: np.ndarray, odds: np.ndarray, learning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the mixer and the longest context seen; ``odds`` as by odds(); ``learning``: without one observation of the bit."""
    inputs, unseen = np.empty((CONTEXTS + 1, 8, len(keys)), np.float32), []
    inputs[-1] = 1
    for i, (head, slots) in enumerate(slots_of(keys, _WITHOUT if learning else _NODE)):
        found = odds.reshape(-1).take(slots)
        none, group = np.isnan(found), None
        np.copyto(found, 0, where=none)
        if len(head) < len(keys):
            group = np.repeat(np.arange(len(head)), np.diff(head, append=len(keys)))
            found.take(group, axis=1, out=inputs[i], mode="clip")
        else:
            inputs[i] = found
        unseen.append((none, group))
    none, group = unseen[-1]
    none = none if group is None else none.take(group, axis=1)
    longest = np.where(none, np.int8(0), np.int8(CONTEXTS))
    rest = np.flatnonzero(none)  # few: the shorter contexts matter only where the last one is new
    for i in range(CONTEXTS - 1, 0, -1):
        none, group = unseen[i - 1]
        place, at = np.divmod(rest, max(1, len(keys)))
        none = none[place, at if group is None else group[at]]
        longest.ravel()[rest[~none]] = i
        rest = rest[none]
    return inputs, longest


def _gates(longest: np.ndarray) -> tuple[int, np.ndarray]:
    """The gate of most bits, and the bits with others."""
    most = int(np.bincount(longest.ravel(), minlength=1).argmax())
    return most, np.flatnonzero(longest != most)


def _mixed(m: Mixer, inputs: np.ndarray, longest: np.ndarray, gates: tuple[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds by each set of weights, and their mean; ``gates`` as by _gates()."""
    flat, (most, rest), weights = inputs.reshape(CONTEXTS + 1, -1), gates, m.by_order.astype(np.float32)
    by_order = weights[most] @ flat
    by_order[rest] = (weights[longest.ravel()[rest]].T * flat[:, rest]).sum(axis=0)
    by_order = by_order.reshape(longest.shape)
    by_place = np.stack([m.by_place[j].astype(np.float32) @ inputs[:, j] for j in range(8)])
    both = by_order + by_place
    both /= 2
    return by_order, by_place, np.clip(both, -8, 8, out=both)


def learn_runs(keys: np.ndarray, times: np.ndarray, odds: np.ndarray, m: Mixer, seen: np.ndarray) -> None:
    """Moves the mixer over the keys (in order), and adds what its map sees (ones, all); each lot is spread over all keys."""
    lots = -(-len(keys) // LOT)
    for lot in range(lots):
        some, n = np.ascontiguousarray(keys[lot::lots]), times[lot::lots]
        inputs, longest = _inputs(some, odds, True)
        most, rest = gates = _gates(longest)
        a, b, both = _mixed(m, inputs, longest, gates)
        bit, one = bits_of(some).astype(np.float32), _squash(both)
        cell = (longest * np.int16(CELLS) + np.rint(both / STEP).astype(np.int16) + np.int16(CELLS // 2)).ravel()
        seen[0] += np.bincount(cell, (bit * n).ravel(), seen[0].size).reshape(seen[0].shape)
        seen[1] += np.bincount(cell, np.tile(n, 8), seen[0].size).reshape(seen[0].shape)
        share = (n / (8 * n.sum())).astype(np.float32)
        bend = inputs[0] * inputs[0]
        for x in inputs[1:]:
            bend += x * x
        bend *= one
        bend *= (1 - one) * share
        off_a, off_b = ((bit - _squash(a)) * share).ravel(), (bit - _squash(b)) * share
        flat, of, bends = inputs.reshape(CONTEXTS + 1, -1), longest.ravel()[rest], bend.ravel()
        for gate in np.unique(of):
            there = rest[of == gate]
            m.by_order[gate] += RATE * (flat[:, there] @ off_a[there]) / (bends[there].sum() + FEW)
        off_a[rest] = 0
        m.by_order[most] += RATE * (flat @ off_a) / (bends.sum(where=(longest == most).ravel()) + FEW)
        for j in range(8):
            m.by_place[j] += RATE * (inputs[:, j] @ off_b[j]) / (bend[j].sum() + FEW)


def run_scores(keys: np.ndarray, odds: np.ndarray, m: Mixer) -> np.ndarray:
    """log10 of the probability of each key's byte after the six before it; keys in order."""
    out = np.empty(len(keys))
    for lot in range(0, len(keys), LOT):
        some = keys[lot : lot + LOT]
        inputs, longest = _inputs(some, odds[0], False)
        one = _ones(m, _mixed(m, inputs, longest, _gates(longest))[2].astype(float), longest.astype(np.int64))
        out[lot : lot + LOT] = np.log10(np.where(bits_of(some) > 0, one, 1 - one).prod(axis=0))
    return out


def text_sums(pieces: Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]], odds: np.ndarray, m: Mixer, shown: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each text of the pieces, which are as by runs_of_bytes(); ``shown``: their distinct keys, if at hand."""
    shown = distinct_runs(pieces())[0] if shown is None else shown
    found, places = run_scores(shown, odds, m), Places(shown)
    out = [np.add.reduceat(found.take(places.find(keys)), heads(doc)) for keys, doc in pieces()]
    return np.concatenate(out)


def pieces(batch: pa.RecordBatch, learned: bool) -> Iterator[tuple[int, Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]]]:
    """(row, what lays out its (keys, text of each) by piece) of the chunks; ``learned``: of the texts learned from only."""
    for row in range(batch.num_rows):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[row]  # noqa: B023, E731
        sizes, n_bytes = (get(x).values.to_numpy() for x in ("sizes", "bytes"))
        tokens, spelled = unpacked(get("text").as_py(), int(sizes.sum())), spell_out(get("words").values)
        if learned:
            yes = get("learned").values.to_numpy(zero_copy_only=False)
            tokens, sizes, n_bytes = tokens[np.repeat(yes, sizes)], sizes[yes], n_bytes[yes]
        upto = np.cumsum(sizes)

        def lay_out(spelled=spelled, tokens=tokens, sizes=sizes, n_bytes=n_bytes, upto=upto) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for first, last in runs(n_bytes, PIECE):
                for i in range(first, last, TEXTS):
                    j = min(i + TEXTS, last)
                    yield runs_of_bytes(spelled, tokens[upto[i] - sizes[i] : upto[j - 1]], sizes[i:j])

        yield row, lay_out


def packed(numbers: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on, compressed."""
    return pa.compress(numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes(), "zstd", asbytes=True)


def numbers(packed: bytes, size: int, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, wide * size, "zstd", asbytes=True), np.uint8).reshape(wide, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def with_runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The chunks and their distinct runs of bytes: how many, the keys in order, and how often each is learned from."""
    found = []
    for row, some in pieces(batch, False):
        learned = batch.column(batch.schema.get_field_index("learned"))[row].values.to_numpy(zero_copy_only=False)
        keys, times = distinct_runs(some(), learned.astype(U))
        found.append((len(keys), packed(keys), packed(times)))
    for name, values, kind in zip(RUNS, zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True):
        batch = batch.append_column(name, pa.array(values, kind))
    return batch


def run_columns(held: DataFrame) -> DataFrame:
    """The chunks' distinct runs, found here where they aren't stored with them."""
    if set(RUNS) <= set(held.columns):
        return held.select(*RUNS)
    return held.select("words", "text", "sizes", "bytes", "learned").mapInArrow(lambda batches: (with_runs(batch).select(RUNS) for batch in batches), RUN_KINDS)


def learned_runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys in order, how often) of each chunk's training texts."""
    for size, keys, times in zip(*(column(batch, c) for c in RUNS), strict=True):
        times = numbers(times, size, np.int64)
        yield numbers(keys, size, U)[times > 0], times[times > 0]


def context_counts(held: DataFrame) -> np.ndarray:
    """(zeros, ones) of every slot over all bytes of the training texts of the chunks."""

    def add(batch: pa.RecordBatch, seen: np.ndarray) -> None:
        for keys, times in learned_runs(batch):
            count_runs(keys, times, seen)

    return added_up(run_columns(held), add, SLOT_BITS)


def fit_contexts(held: DataFrame, odds) -> Mixer:
    """Mixers of the chunks' training texts, averaged by their bits. ``odds`` is a broadcast of odds()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, times in learned_runs(batch):
                m, seen = Mixer.fresh(CONTEXTS), np.zeros((2, CONTEXTS + 1, CELLS))
                learn_runs(keys, times, odds.value, m, seen)
                flat = m.flat(seen, 8 * times.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    return Mixer.averaged(run_columns(held).mapInArrow(run, "at int, x double"), CONTEXTS)


def context_scores(docs: DataFrame, learn_col: str = "learn", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, base_score, score, n_bytes, bits_per_byte, train_tokens.

    As lm_scoring.score_texts(), but score is the log10 probability of the whole text's bytes by the mixed predictors, whose contexts go on
    across its words; it doesn't go by word counts, and nothing moves while a text is scored. base_score has the exact counts of the
    training tokens. bits_per_byte is the score in bits over the bytes, one more for each token.

    A null or empty text is its end alone. Repeated rows are counted and scored each; null ids stay null and can be learned
    from if their ``learn_col`` says so; other columns are ignored; an empty table gives an empty result. Without training rows all
    bits are even. The word counts grow with the corpus and are joined to each chunk's distinct words; only the slots (a
    fixed size) and some hundred weights are sent to all tasks.
    """
    spark = docs.sparkSession
    held = materialize(chunks(chosen(docs, learn_col, id_col, text_col), with_runs, RUN_KINDS))
    types, all_words, _ = word_counts(held)
    n, v = training_size(all_words)
    table = spark.sparkContext.broadcast(np.clip(odds(context_counts(held)), -MOST, MOST))
    mixer = spark.sparkContext.broadcast(fit_contexts(held, table))

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, some in pieces(batch, False):
                shown = numbers(column(batch, "run_keys")[row], column(batch, "runs")[row], U)
                found = text_sums(some, table.value, mixer.value, shown)
                whole = batch.slice(row, 1)
                kept = [whole.column(whole.schema.get_field_index(x)) for x in ("chunk", "text", "ids", "sizes", "bytes")]
                scores = pa.array([found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*kept, scores], names=["chunk", "text", "ids", "sizes", "bytes", "scores"])

    places = types.select("word", "places").join(all_words.select("word", "c"), "word") if types is not all_words else types
    own = places.select("c", F.explode("places").alias("place")).select("place.chunk", "place.at", "c")

    def score(held: pa.Table, own: pa.Table) -> pa.Table:
        c = np.zeros(own.num_rows, np.int64)
        c[own["at"].to_numpy()] = own["c"].to_numpy()
        ids, sizes, n_bytes, found = (held[x].combine_chunks().flatten() for x in ("ids", "sizes", "bytes", "scores"))
        size = sizes.to_numpy()
        known, base = base_scores(unpacked(held["text"][0].as_py(), int(size.sum())), size, c, n, v)
        bits = -found.to_numpy() * np.log2(10) / n_bytes.to_numpy()
        return pa.table({"doc_id": ids, "n_tokens": sizes, "n_known": known, "base_score": base, "score": found, "n_bytes": n_bytes, "bits_per_byte": bits})

    rows = held.select("chunk", "words", "text", "ids", "sizes", "bytes", "runs", "run_keys").mapInArrow(mixed, "chunk long, text binary, ids array<long>, sizes array<long>, bytes array<long>, scores array<double>")
    rows = rows.groupBy("chunk").cogroup(own.groupBy("chunk"))
    out = rows.applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = context_scores(docs.withColumn("learn", F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(False))))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
