"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.llm.common import table
from tessera.llm.kernels import blocks, column, parts

UNKNOWN = "und"
LANE = 512  #: letters of a text after which another lane takes it up
CODES = 1 << 20  #: bytes of text handled at once
SAMPLE_TEXTS = 32  #: labelled texts per language, at most, each of them whole
SAMPLE_CHARS = 4000  #: characters of one of them, at most; of a language that has only longer ones the shortest is taken
EVIDENCE = 48  #: letters whose bits make up a score
CELLS = 1 << 25  #: states times letters up to which all transitions are one full table; beyond, they are hashed
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0."""
    if not _letters:
        found = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _letters.append(found)
    return _letters[0]


@dataclass(frozen=True)
class LanguageModel:
    """Bounded labelled samples; each worker builds the automata from them once."""

    langs: tuple[str, ...]
    samples: tuple[str, ...]
    priors: tuple[float, ...]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``codes``, by state."""
    step: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            to = step[at][c]
            if size[at] + 1 == size[to]:
                link[new] = to
            else:
                twin = len(step)
                step.append(dict(step[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and step[at].get(c) == to:
                    step[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return step


class Parser:
    """The automata of all languages in one transition table, full or hashed."""

    def __init__(self, model: LanguageModel, cells: int = CELLS):
        lower = letters()
        seen = [lower[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)] for s in model.samples]
        alphabet = np.unique(np.concatenate([*seen, [0]]))
        self.pad = len(alphabet) + 1
        self.width = self.pad + 1
        place = np.minimum(np.searchsorted(alphabet, lower), len(alphabet) - 1)
        known = alphabet[place] == lower
        self.code = np.where(known, place, len(alphabet)).astype(np.uint8 if self.pad < 256 else np.int32)  # the last: a letter that no sample has
        codes = [self.codes_of(x) for x in seen]
        automata = [suffix_automaton(x.tolist()) for x in codes]
        self.bits = np.array([np.log2(max(len(x), 2)) for x in codes])
        sizes = [len(x) for x in automata]
        self.roots = (np.cumsum(sizes) - sizes).astype(np.int32).tolist()
        self.root = np.zeros((len(automata), self.width), np.int32)
        for nth, (steps, base) in enumerate(zip(automata, self.roots, strict=True)):
            self.root[nth] = base
            for c, to in steps[0].items():
                self.root[nth, c] = base + to
        self.full = sum(sizes) * self.width <= cells
        (self._fill if self.full else self._hash)(automata)

    def _fill(self, automata: list) -> None:
        tables = []
        for steps, base, root in zip(automata, self.roots, self.root, strict=True):
            own = np.broadcast_to(~root, (len(steps), self.width)).copy()  # no way on, or none yet: a phrase starts here
            for state, ways in enumerate(steps):
                for c, to in ways.items() if state else ():
                    own[state, c] = base + to
            own[:, self.pad] = base + np.arange(len(steps))
            tables.append(own)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)

    def _hash(self, automata: list) -> None:
        """Keys state * width + letter by linear probing, at most half full."""
        key = np.array([(base + state) * self.width + c for steps, base in zip(automata, self.roots, strict=True) for state, ways in enumerate(steps) if state for c in ways], np.int64)
        to = np.array([base + t for steps, base in zip(automata, self.roots, strict=True) for state, ways in enumerate(steps) if state for t in ways.values()], np.int32)
        self.log = max(4, (2 * len(key)).bit_length())
        self.keys, self.to = np.full(1 << self.log, -1, np.int64), np.zeros(1 << self.log, np.int32)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = key[free]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.log) - 1)
        self.to[slot] = to

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def step(self, state: np.ndarray, row: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The next state of each lane, or its complement where a phrase starts."""
        if self.full:
            return self.table[state * self.width + row]
        key = state.astype(np.int64) * self.width + row
        out, slot, left = ~self.root[lang, row], self._slot(key), np.arange(len(key))
        while len(left):
            have = self.keys[slot[left]]
            hit = left[have == key[left]]
            out[hit] = self.to[slot[hit]]
            left = left[(have != key[left]) & (have >= 0)]
            slot[left] = (slot[left] + 1) & ((1 << self.log) - 1)
        return out

    def _run(self, codes: np.ndarray, lang: np.ndarray, at: np.ndarray, stop: np.ndarray, end: np.ndarray, starts: np.ndarray, known: bool) -> tuple[np.ndarray, np.ndarray]:
        """Parse from ``at`` on, up to the first phrase that starts at ``stop`` or later, or to ``end``: (that place, phrases before it).

        ``starts`` marks, language by language, where phrases start; if they are ``known``, a parse ends at one of them.
        """
        over, number = end.copy(), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at < end)
        state, lang, at, stop, end = np.array(self.roots, np.int64)[lang[live]], lang[live], at[live].copy(), stop[live], end[live]
        base = lang * len(codes)
        while len(live):
            got = self.step(state, codes[at], lang)
            new = got < 0
            met = new & ((at >= stop) | starts[base + at]) if known else new & (at >= stop)
            over[live[met]] = at[met]
            new &= ~met
            if known:
                number[live[new]] += 1
            else:
                starts[(base + at)[new]] = True
            state = got ^ (got >> 31)
            at += 1
            go = ~met & (at < end)
            if not go.all():
                live, state, lang, at, stop, end, base = (x[go] for x in (live, state, lang, at, stop, end, base))
        return over, number

    def codes_of(self, lowered: np.ndarray) -> np.ndarray:
        codes = self.code[lowered]
        return codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and its letters."""
        joined = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code[joined]
        owner = np.repeat(np.arange(len(texts)), sizes + 1)[: len(codes)]
        number = np.bincount(owner[codes > 0], minlength=len(texts))
        last = np.cumsum(sizes + 1) - 1  # where the texts were joined
        keep = (codes > 0) | np.concatenate(([True], codes[:-1] > 0))[: len(codes)]
        keep[(last - sizes)[sizes > 0]] = True
        keep[last[:-1]] = False
        codes, owner = codes[keep], owner[keep]
        count = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(count) - count
        lanes = -(-count // LANE)
        text = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first, end = begin[text] + nth * LANE, (begin + count)[text]
        stop = np.minimum(first + LANE, end)
        many, n = len(text), len(codes)
        total = np.zeros((len(self.roots), len(texts)))
        if not many:
            return total, number
        starts = np.zeros(len(self.roots) * n, bool)  # phrases of lanes that each begin with one
        lang = np.repeat(np.arange(len(self.roots)), many)
        text, nth, first, stop, end = (np.tile(x, len(self.roots)) for x in (text, nth, first, stop, end))
        codes = codes.astype(np.int64)
        over, _ = self._run(codes, lang, first, stop, end, starts, False)
        upto = np.concatenate((np.zeros(1, np.int32), np.cumsum(starts, dtype=np.int32)))
        found = upto[lang * n + stop] - upto[lang * n + first]
        # the text's parse enters a lane where the lane before has ended, and goes on there until it meets a start of the lane
        late = np.flatnonzero(nth > 0)
        while len(late):
            enter = over[late - 1]
            inside = enter < stop[late]
            meet, own = np.where(inside, 0, enter), np.zeros(len(late), np.int64)
            some = late[inside]
            meet[inside], own[inside] = self._run(codes, lang[some], enter[inside], stop[some], end[some], starts, True)
            found[late] = own + upto[lang[late] * n + stop[late]] - upto[lang[late] * n + np.minimum(meet, stop[late])]
            changed = (meet >= stop[late]) & (meet != over[late])
            over[late[changed]] = meet[changed]
            after = late[changed] + 1
            late = after[after < len(nth)]
            late = late[nth[late] > 0]
        for k in range(len(self.roots)):
            total[k] = np.bincount(text[lang == k], found[lang == k], len(texts))
        return total, number


_parsers: dict[LanguageModel, Parser] = {}


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> LanguageModel:
    """Samples of the labelled rows: ``sample_texts`` whole texts per language, picked by a hash of their ids.

    They have ``sample_chars`` characters at most; of a language with longer texts only, the shortest is taken. Rows
    without text, language or id are left out. Only the samples reach the driver; all their letters are kept, however
    many. Priors are the shares of all labelled rows.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    named = rows.where("id is not null and lang is not null and text is not null").select("id", "lang", F.length("text").alias("n"), F.xxhash64(F.col("id").cast("string"), F.lit("lang")).alias("h"))
    counts = {r["lang"]: r["k"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
    long = F.when(F.col("n") > sample_chars, F.col("n")).otherwise(0)
    picked = named.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(long, "h", "id"))).where(F.col("i") <= sample_texts).where((F.col("i") == 1) | (long == 0))
    taken = rows.join(F.broadcast(picked.select("id", "lang", "h").distinct()), ["id", "lang"]).where("text is not null").select("lang", "h", "text").distinct().collect()
    parts: dict[str, list[tuple]] = {lang: [] for lang in counts}
    for r in taken:
        parts[r["lang"]].append((r["h"], r["text"]))
    langs = tuple(sorted(lang for lang in parts if parts[lang]))
    total = sum(counts.values())
    return LanguageModel(langs, tuple("\n".join(p for _, p in sorted(parts[lang])) for lang in langs), tuple(counts[lang] / total for lang in langs))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, phrase_bits, and with ``carry`` the columns named there in a struct ``row``, and text.

    Each whole text is parsed from left to right into the longest phrases that occur in a language's sample. With
    phrases times log2(sample length) bits, the language of fewest bits wins; ties go to the language with more
    labelled rows, then by name. ``phrase_bits`` is the winner's bits per letter. ``score`` is the winner's share of
    2 ** -bits over all languages, where the bits of a text of more than EVIDENCE letters are brought down to so many. Null texts and texts without a letter are ``und`` with score 0, and so are all
    texts if the model has no language. Ids may be null or repeated; other columns are ignored.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _parsers:
            _parsers.clear()
            _parsers[model] = Parser(model)
        parser = _parsers[model]
        names = np.array([*model.langs, UNKNOWN], object)
        rank = np.array(model.priors)
        for batch in parts(batches):
            ids, texts = batch.column(0), column(batch, "text")
            for at, raws in blocks(texts, CODES):
                some = [t or "" for t in texts[at : at + len(raws)]]
                phrases, number = parser.phrases(some)
                win, score, rate = np.full(len(some), len(model.langs)), np.zeros(len(some)), np.zeros(len(some))
                if len(model.langs):
                    bits = phrases * parser.bits[:, None]
                    best = bits.min(axis=0)
                    ok = number > 0
                    win[ok] = np.argmax(np.where(bits <= best, rank[:, None], -1.0), axis=0)[ok]
                    share = 1 / np.exp2(np.maximum((best - bits) * (EVIDENCE / np.maximum(number, EVIDENCE)), -1000)).sum(axis=0)
                    score[ok] = share[ok]
                    rate[ok] = (best / np.maximum(number, 1))[ok]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(raws)), pa.array(names[win], pa.string()), pa.array(score), pa.array(rate), *[batch.column(c).slice(at, len(raws)) for c in ((2, 1) if carry else (2,))]], names=["doc_id", "lang_pred", "score", "phrase_bits", "row", "text"][: 5 + bool(carry)])

    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))  # without the text, which passes as it is
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row.alias("row"))
    schema = StructType.fromDDL("doc_id long, lang_pred string, score double, phrase_bits double").add(picked.schema["row"])
    schema = schema.add("text", "string") if carry else schema
    out = picked.mapInArrow(parse, schema)
    return out if carry else out.drop("row")


def remainder(id_col: Column, divisor: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % divisor


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "phrase_bits")
